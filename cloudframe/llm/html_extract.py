"""The main text of raw pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser is fed a page piece by piece. Its events make lines: a
line ends at every block tag and holds the text since the last one, the number of tags
that stood in it, and where it stands: the containers around it. Lines inside
containers that never hold content (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments; known by tag, role, class or id) are set aside.

A class or id names such a container by its last word that is not mere structure
(cookie-notice, td-footer-wrapper, sidebar-widget); names with has-, no- or with- say
nothing. Names of tools (search, share) hold only where the ratios find no paragraph of
content in them. A header inside a marked region, or of a post or an entry, is content.
A name does not hold for an element around the longest marked region (unless longer
paragraphs stand outside) or around most of the text of its region, or of the page where
none is marked; a discussion must then also hold all headings.

Each line's text-to-tag ratio (characters for each tag) is smoothed with a Gaussian over
the neighbouring lines, and a threshold (the mean less the deviation's share, never over
half the mean) parts content lines from the rest. Lines form regions: an article or main
element where the page marks one, else the whole body. A marked region is kept whole if
any of its lines is content, so headings and short paragraphs stay; of several regions
those are kept whose content lines have half as many characters as those of the one with
the most, so that teasers marked as articles go. In an unmarked body,
the content lines (without those that owe their level to their neighbours alone) choose a
region, the smallest block around them that has more than one line, and it is kept whole,
with headings right before it. Only menus at its edges are left out: blocks before the
first or after the last content line whose text is all links.

Defined results: a null or empty page has an empty text; broken or unclosed markup is
read as far as the parser goes, but a tag cut off by the page's end is left out; null or repeated ids are answered row by row; an empty
table gives an empty table. Work grows with the length of a page however deep its
elements are nested.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import small_batches

SIGMA = 1.5
PIECE = 1 << 16

#: fixed values: elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr label".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu audio video title datalist math".split())
MARKED = frozenset(("article", "main"))
#: fixed values: words in class, id or role that name what is not content
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot "
    "cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended comment comments "
    "comments-area commentlist replies reply respond disqus discussion toolbar pagination pager widget copyright hidden disclaimer complementary contentinfo adsbygoogle author-bio more-stories more-articles more-posts".split()
)
#: fixed values: names of tools that may also name a part of the text
TOOLS = frozenset("search share sharing social toolbar pager".split())
DISCUSSION = frozenset("comment comments comments-area commentlist replies reply respond disqus discussion".split())
#: fixed values: words that turn a name into a property of what holds it, words after the one that names, and words before header
MODIFIERS = frozenset("has no not with without".split())
STRUCTURE = frozenset(
    "area bar block body bottom box button buttons col column container content form group holder icons image info inner item items left links list main media message outer panel policy posts "
    "primary right row secondary section slot text top trail unit wrap wrapper".split()
)
OWN_HEADER = frozenset("article blog content entry post section story".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: fixed values: elements within a block of text, and lists
TEXT_BLOCKS = HEADINGS | frozenset("p pre blockquote ul ol li dl dd dt table thead tbody tfoot tr td th caption figure figcaption address details summary".split())
LISTS = frozenset("ul ol dl table".split())
_NAME = re.compile(r"[^a-z0-9]+")
_CUT = re.compile(r"<[a-zA-Z/!?]")


def set_aside_by(name: str) -> str:
    """The word by which a class, id or role names what is not content, or ''."""
    if name in NEVER_NAMES:
        return name
    words = [w for w in _NAME.split(name) if w]
    if not MODIFIERS.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in STRUCTURE or words[-1] == "widget" or words[-1][0].isdigit()):
        words.pop()
    if not words or words[-1] not in NEVER_NAMES or (words[-1] == "header" and not OWN_HEADER.isdisjoint(words)):
        return ""
    return words[-1]


class Named:
    """An element whose name says that it is no content, which may not hold."""

    __slots__ = ("outer", "region", "discussion", "tool", "talk", "chars", "has_most", "headings", "prose", "gone")

    def __init__(self, outer: Named | None, region: int, word: str):
        self.outer, self.region, self.discussion, self.tool = outer, region, word in DISCUSSION, word in TOOLS
        self.talk = self.discussion or (outer is not None and outer.talk)  #: it or an element around it
        self.chars = self.headings = 0
        self.has_most = self.prose = self.gone = False


class Line:
    __slots__ = ("text", "tags", "skip", "region", "tag", "named", "block", "list", "linked", "length")

    def __init__(self, skip: bool, region: int, named: Named | None, tag: str, block: int, in_list: int):
        self.text: list[str] = []
        self.tags, self.skip, self.region, self.named, self.tag = 0, skip, region, named, tag
        self.block, self.list, self.linked, self.length = block, in_list, 0, 0


class LineParser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, Named | None, int, int]] = []  #: tag, set aside, marked region, innermost named element, block, outermost list in it
        self.named: list[Named] = []  #: outer ones first
        self.count: Counter = Counter()  #: open elements by tag
        self.regions = self.lists = self.links = 0
        self.blocks = [0]  #: the block around each
        self._new_line("")

    def _state(self) -> tuple[bool, int, Named | None, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, None, 0, 0)

    def _close(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.links -= tag == "a"
            self.count[tag] -= 1
        del self.open[k:]

    def _new_line(self, tag: str) -> None:
        skip, region, named, block, in_list = self._state()
        last = self.lines[-1] if self.lines else None
        if last is not None and not last.text:
            self.lines.pop()  # nothing in it: its tags belong to the next one
        line = Line(skip, region, named, tag, block, in_list)
        if last is not None and not last.text:
            line.tags = last.tags
        self.lines.append(line)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.lines[-1].tags += 1
            if tag in ("br", "hr"):
                self.handle_data(" ") if tag == "br" else self._new_line(tag)
            return
        if tag not in INLINE and self.open and self.open[-1][0] == "p":
            self._close(-1)
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self._close(-1)
        skip, region, named, block, in_list = self._state()
        if not skip:
            skip = tag in NEVER or self._hidden(tag, attrs)
            word = "" if skip else self._word(tag, attrs, region)
            if word:
                named = Named(named, region, word)
                self.named.append(named)
            if tag in MARKED or any(k == "itemprop" and v == "articleBody" for k, v in attrs) or any(k == "role" and v in MARKED for k, v in attrs):
                if not region:
                    self.regions += 1
                    region = self.regions
        if tag == "a":
            self.links += 1
        elif tag in LISTS:
            if not in_list:
                self.lists += 1
                in_list = self.lists
        elif tag not in INLINE and tag not in TEXT_BLOCKS:
            self.blocks.append(block)
            block, in_list = len(self.blocks) - 1, 0
        self.open.append((tag, skip, region, named, block, in_list))
        self.count[tag] += 1
        if tag in INLINE and skip == self.lines[-1].skip and named is self.lines[-1].named:
            self.lines[-1].tags += 1
        else:
            self._new_line(tag)
            self.lines[-1].tags += 1

    @staticmethod
    def _hidden(tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        return any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)

    @staticmethod
    def _word(tag: str, attrs: list, region: int) -> str:
        """The word that names the element as no content, or ''. An article may be a reader's comment, but no menu."""
        if tag in ("html", "body", "main"):
            return ""
        if tag == "header" and not region:
            return tag
        for k, v in attrs:
            # the id of a heading is made of its text
            if v and (k in ("class", "role") or (k == "id" and tag not in HEADINGS)):
                for name in v.lower().split():
                    if (word := set_aside_by(name)) and not (word == "header" and region) and (tag != "article" or word in DISCUSSION):
                        return word
        return ""

    def handle_endtag(self, tag: str) -> None:
        before = self._state()
        for k in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():
            if self.open[k][0] == tag:
                self._close(k)
                break
        self.lines[-1].tags += 1
        if tag not in INLINE or self._state()[:3:2] != before[:3:2]:
            self._new_line("")

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        if line.text or not data.isspace():
            line.text.append(data)
            if not data.isspace():
                line.length += 1
                line.linked += self.links > 0


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the kernel renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def levels(lines: list[tuple[Line, str]]) -> tuple[np.ndarray, float, np.ndarray]:
    """Ratios of the lines, the threshold, and which lines the smoothed ratios find to be content."""
    ratio = np.array([len(text) / max(1, line.tags) for line, text in lines])
    level = smooth(ratio)
    threshold = min(level.mean() - 0.5 * level.std(), 0.5 * level.mean())
    return ratio, threshold, level >= threshold


def without_named(lines: list[tuple[Line, str]], named: list[Named]) -> list[tuple[Line, str]]:
    """The lines outside elements whose name holds."""
    if not named or not lines:
        return lines
    # sizes of the page and of its regions without discussions, longest line within them and outside of all regions and names
    chars, longest, outside, headings = Counter(), Counter(), 0, 0
    prose = np.zeros(len(lines), bool)  #: content of its own, not by its neighbours alone
    if any(n.tool for n in named):
        ratio, threshold, content = levels(lines)
        prose = content & (ratio >= threshold)
    for (line, text), strong in zip(lines, prose.tolist(), strict=True):
        heading = line.tag in HEADINGS
        headings += heading
        own = line.named
        if own is not None:
            own.chars += len(text)
            own.headings += heading
            own.prose |= strong and line.tag == "p" and line.linked < line.length
        chars[0] += len(text)
        if line.region:
            chars[line.region] += len(text)
            if own is None or not own.talk:
                longest[line.region] = max(longest[line.region], len(text))
        elif own is None:
            outside = max(outside, len(text))
    most = max(longest, key=lambda r: (chars[r], -r), default=0)
    # whether the longest region begins inside: its lines' names count, and those around them
    for line, _ in lines:
        if most and line.region == most and line.named is not None:
            line.named.has_most = True
    for n in reversed(named):
        if n.outer is not None:
            n.outer.chars += n.chars
            n.outer.headings += n.headings
            n.outer.has_most |= n.has_most
            n.outer.prose |= n.prose
    for n in named:
        around_most = n.has_most and n.region == 0 and longest[most] >= outside
        much = 2 * n.chars > chars[n.region] and (n.region > 0 or not most or around_most)
        holds = not (much and n.headings == headings) if n.discussion else not (much or around_most or (n.tool and n.prose))
        n.gone = holds or (n.outer is not None and n.outer.gone)
    return [(line, text) for line, text in lines if line.named is None or not line.named.gone]


def content_block(outer: list[int], lines: list[Line], strong: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines of an unmarked page are in the smallest block around its content lines, or are its headings."""
    core = strong if len(strong) else content

    # the block around all of them; an outer block has a smaller number, and ``seen`` lies within ``top``
    top = lines[core[0]].block
    seen = {top}
    for k in core[1:]:
        block = lines[k].block
        while block > top and block not in seen:
            seen.add(block)
            block = outer[block]
        while block not in seen and block != top:
            if top > block:
                top = outer[top]
                seen.add(top)
            else:
                seen.add(block)
                block = outer[block]
    sizes = [0] * len(outer)
    for line in lines:
        sizes[line.block] += 1
    for block in range(len(outer) - 1, 0, -1):
        sizes[outer[block]] += sizes[block]
    while top and sizes[top] < 2:
        top = outer[top]
    inner = [False] * len(outer)
    for block in range(top, len(outer)):
        inner[block] = block == top or inner[outer[block]]
    keep = np.array([inner[line.block] for line in lines])
    # menus: child blocks, or lists right in the block, without content
    part_of: dict[int, tuple[int, int]] = {}

    def part(line: Line) -> tuple[int, int]:
        if line.block == top:
            return (0, line.list)
        block, way = line.block, []
        while block not in part_of and outer[block] != top:
            way.append(block)
            block = outer[block]
        found = part_of.setdefault(block, (block, 0))
        part_of.update(dict.fromkeys(way, found))
        return found

    linked: dict[tuple[int, int], bool] = {}
    edges = [k for k in np.flatnonzero(keep).tolist() if k < core[0] or k > core[-1]]
    parts = {k: part(lines[k]) for k in np.flatnonzero(keep).tolist()}
    for k, p in parts.items():
        linked[p] = linked.get(p, True) and lines[k].linked == lines[k].length
    for k in edges:
        if parts[k] != (0, 0) and linked[parts[k]]:
            keep[k] = False
    first = int(np.flatnonzero(keep)[0])
    while first and lines[first - 1].tag in HEADINGS:
        first -= 1
        keep[first] = True
    return keep


def main_text(html: str | None) -> str:
    if not html:
        return ""
    # a tag that the page's end cuts off is no text, and reading it would take time by its square
    end = html.rfind(">") + 1
    if cut := _CUT.search(html, end):
        html = html[: cut.start()]
    parser = LineParser()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    lines = [(line, text) for line in parser.lines if not line.skip and (text := " ".join("".join(line.text).split()))]
    lines = without_named(lines, parser.named)
    if not lines:
        return ""
    ratio, threshold, content = levels(lines)
    regions = np.array([line.region for line, _ in lines])
    if regions.any():
        sizes = Counter()
        for r, (_, text), strong in zip(regions.tolist(), lines, content.tolist(), strict=True):
            sizes[r] += len(text) if strong and r else 0
        full = [r for r, n in sizes.items() if r and n and 2 * n >= max(sizes.values())]
        keep = np.isin(regions, full)
    else:
        keep = content_block(parser.blocks, [line for line, _ in lines], np.flatnonzero(content & (ratio >= 0.5 * threshold)), np.flatnonzero(content))
    return " ".join(text for k, (_, text) in zip(keep, lines, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with the main text and its number of code points."""
    slim = pages.select(*[pages[c] for c in keep], F.coalesce(pages[html], F.lit("")).alias("__html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                texts = [main_text(h) for h in piece.column(piece.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return small_batches(slim).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def html_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
