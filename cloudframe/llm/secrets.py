"""Secret scans through a trigram inverted index, in DataFrame operations only.

1. For each rule a Boolean trigram query (an OR of ANDs) is derived from its regular
   expression; trigrams are taken from the lower-cased text.
2. The index holds one posting (trigram, document key) for each trigram that some rule
   asks for; postings are spread by document key, so a frequent trigram is no hot group.
3. The postings are intersected by document key, and each rule's query is evaluated
   there. Documents that meet a rule's query are its candidates; a rule without mandatory
   trigrams takes every document.
4. Candidates are verified with the regular expression over their whole texts.

The document key is a hash of the text: rows with one text share their postings, and a
collision could only add a candidate, which verification refuses.

Defined results: a null text is empty; null or repeated ``doc_id`` rows are answered row
by row; spans count code points, end exclusive; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import broadcast_if_small, fresh, text_or_empty, write_table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  #: valid for Java and Python alike
    group: int = 0  #: the group whose length counts
    least: int = 0  #: matches with a shorter group are dropped


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.-]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES
#: Sets of exact strings larger than this are closed off and begun anew.
MOST_STRINGS = 32


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of trigram sets of which each match holds one whole set; None if no trigram is mandatory."""
    query, left = _sequence(list(sre_parser.parse(pattern)))
    return _and(query, _of_strings(left))


def _of_strings(strings: set[str]) -> list[frozenset[str]] | None:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not sets or not all(sets) else _least(set(sets))


def _least(sets) -> list[frozenset[str]]:
    """Without the sets that hold another one whole: they add nothing to an OR."""
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    return _least(both) if len(both) <= MOST_STRINGS else a


def _chars(op, arg) -> set[str] | None:
    """The lower-cased characters that one item may match, if they are few."""
    if op == sre.LITERAL:
        return {chr(arg).lower()}
    if op == sre.IN and arg and arg[0][0] != sre.NEGATE:
        out: set[str] = set()
        for kind, value in arg:
            if kind == sre.LITERAL:
                out.add(chr(value).lower())
            elif kind == sre.RANGE and value[1] - value[0] < 4:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None
    return None


def _exact(items) -> set[str] | None:
    """All strings that the items match, if they are few."""
    strings = {""}
    for op, arg in items:
        if op == sre.SUBPATTERN:
            more = _exact(list(arg[3]))
        elif op == sre.BRANCH:
            parts = [_exact(list(x)) for x in arg[1]]
            more = None if any(p is None for p in parts) else set().union(*parts)
        elif op == sre.MAX_REPEAT and arg[1] != sre.MAXREPEAT and arg[1] <= 5:
            one = _exact(list(arg[2]))
            more = None
            if one is not None and len(one) ** arg[1] <= MOST_STRINGS:
                more, run = set(), {""}
                for k in range(arg[1] + 1):
                    if k >= arg[0]:
                        more |= run
                    run = {a + b for a in run for b in one}
        else:
            more = _chars(op, arg)
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _sequence(items):
    """(query of what is closed, strings that end here)."""
    query, strings = None, {""}
    for item in items:
        more = _exact([item])
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in more}
            continue
        query = _and(query, _of_strings(strings))
        strings = more if more is not None else {""}
        op, arg = item
        if more is None and op == sre.SUBPATTERN:
            query = _and(query, trigram_query_of(list(arg[3])))
        elif more is None and op == sre.MAX_REPEAT and arg[0] > 0:
            query = _and(query, trigram_query_of(list(arg[2])))
    return query, strings


def trigram_query_of(items):
    query, left = _sequence(items)
    return _and(query, _of_strings(left))


def vocabulary(rules=RULES) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) or () for g in clause})


def build_index(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Postings (gram, key) of the trigrams that the rules ask for."""
    grams = vocabulary(rules)
    lower = F.lower(text_or_empty(docs[text]))
    row = docs.select(F.xxhash64(text_or_empty(docs[text])).alias("key"), lower.alias("lower"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("lower"), g))
    return row.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Intersect the postings: (key, rules), a bit per rule whose trigram query the document meets."""
    grams = vocabulary(rules)
    bit = {g: i for i, g in enumerate(grams)}
    number = F.map_from_arrays(F.array(*[F.lit(g) for g in grams]), F.array(*[F.lit(i) for i in range(len(grams))]))
    width = 62
    numbered = index.withColumn("no", number[F.col("gram")])
    words = range((len(grams) + width - 1) // width)
    masks = [F.bit_or(F.when(F.floor(F.col("no") / width) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("no", F.lit(width)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words]
    met = numbered.groupBy("key").agg(*masks)

    def clause(c: frozenset[str]) -> Column:
        tests = F.lit(True)
        for w in words:
            need = sum(1 << (bit[g] % width) for g in c if bit[g] // width == w)
            if need:
                tests = tests & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
        return tests

    rule_bits = F.lit(0)
    for k, r in enumerate(rules):
        q = trigram_query(r.pattern)
        if q:
            any_clause = F.lit(False)
            for c in sorted(q, key=sorted):
                any_clause = any_clause | clause(c)
            rule_bits = rule_bits + F.when(any_clause, F.lit(1 << k)).otherwise(F.lit(0))
    return met.select("key", rule_bits.alias("rules")).where("rules > 0")


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Sorted structs (start, rank, end) of a rule's matches: lengths of what lies between and of the matches add up to the places."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), measured.alias("g")), F.slice(between, F.lit(1), F.size(matches)), lambda x, b: F.struct(F.char_length(b).cast("bigint").alias("gap"), F.char_length(x["m"]).cast("bigint").alias("len"), (F.char_length(x["g"]) >= rule.least).alias("ok")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"))

    def step(acc, s):
        begin = acc["at"] + s["gap"]
        end = begin + s["len"]
        one = F.when(s["ok"], F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    return F.when(F.rlike(text, pattern), F.aggregate(steps, start, step)["found"]).otherwise(empty)


#: the columns that ``scan`` adds; they take the place of columns of these names
MARKS = ("secret_base", "secret_spans")


def scan(docs: DataFrame, text: str = "text", rules=RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (start, rank, end) over all rules by start and rule, and ``secret_base`` of the first ``base`` rules.

    They take the place of columns of these names; further columns may have any others.
    """
    index = write_table(build_index(docs, text, rules), "secret-index")
    found = write_table(candidates(index, rules), "secret-candidates")
    rows = found.count()
    key, mine, met = (fresh(docs, name) for name in ("__key", "__text_key", "__rules"))
    found = found.select(F.col("key").alias(key), F.col("rules").alias(met))
    keyed = docs.withColumn(mine, F.xxhash64(text_or_empty(docs[text])))
    joined = keyed.join(broadcast_if_small(found, rows), F.col(mine) == F.col(key), "left")
    body = text_or_empty(docs[text])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(body, rule, k)
        if trigram_query(rule.pattern):
            spans = F.when(F.coalesce(F.col(met), F.lit(0)).bitwiseAND(1 << k) != 0, spans).otherwise(none)
        parts.append(spans)
    first, more = fresh(docs, "__base"), fresh(docs, "__more")
    joined = joined.withColumns({first: F.array_sort(F.concat(*parts[:base])), more: F.concat(none, *parts[base:])})
    kept = [docs[c] for c in docs.columns if c.lower() not in MARKS]
    return joined.select(*kept, F.col(first).alias(MARKS[0]), F.array_sort(F.concat(first, more)).alias(MARKS[1]))


def digest(spans: str, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)

    def of_rank(k: int):
        return lambda s: s["rank"] == k

    counts = [F.size(F.filter("secret_base", of_rank(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(digest("secret_base"), 256).alias("base_sha256"), digest("secret_spans").alias("spans"))


def oracle_sql() -> str:
    """The same spans in DuckDB, every rule scanned over every document."""

    def spans(rank: int, rule: Rule) -> str:
        pat = rule.pattern.replace("'", "''")
        m, g = f"regexp_extract_all(t, '{pat}', 0)", f"regexp_extract_all(t, '{pat}', {rule.group})"
        return f"""list_filter(list_transform(range(1, len({m}) + 1), lambda i: {{'s': coalesce(list_sum(list_transform((string_split_regex(t, '{pat}'))[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(({m})[1:i - 1], lambda x: length(x))), 0)::BIGINT, 'r': {rank}, 'n': length(({m})[i]), 'ok': length(({g})[i]) >= {rule.least}}}), lambda z: z.ok)"""

    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda c: f"coalesce(array_to_string(list_transform(list_sort({c}), lambda z: {kinds}[z.r + 1] || ':' || z.s || ':' || (z.s + z.n)), ','), '')"
    cols = ", ".join(f"{spans(k, r)} AS k{k}" for k, r in enumerate(RULES))
    counts = ", ".join(f"len(k{k})::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    base = "list_concat(k0, list_concat(k1, k2))"
    everything = base
    for k in range(len(BASE_RULES), len(RULES)):
        everything = f"list_concat({everything}, k{k})"
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, {cols} FROM d) SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(everything)} AS spans FROM k"
