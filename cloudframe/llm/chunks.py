"""Cutting a text where a byte-level BPE tokenizer always cuts it, so that repeated chunks are encoded once.

The pre-tokenizer's pattern never joins a space that is followed by a non-space to what
stands before it, nor a lone line feed between two non-spaces to either side. A text is
cut at those places only; the ids of the whole are the ids of the chunks in order.

A chunk is named by a word: one that begins with a line feed stands for itself, any other
one for a space and the word. The first chunk of a text has no space and is named apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: cut before a single space followed by a non-space, and before a lone line feed between non-spaces
_CUT = re.compile(r" (?=[^\s᠎])|(?<=[^\s᠎])(?=\n[^\s᠎])")


def words(text: str) -> list[str]:
    """The names of the chunks; the first one is to be taken as it stands."""
    parts = text.split()
    spaces, feeds = text.count(" "), text.count("\n")
    # only single spaces and line feeds between words, none at the ends: plain splitting finds the same cuts
    if parts and len(parts) - 1 == spaces + feeds and sum(map(len, parts)) + spaces + feeds == len(text) and "᠎" not in text:
        return text.replace("\n", " \n").split(" ") if feeds else parts
    return _CUT.split(text)


def chunk(word: str) -> str:
    return word if word[:1] == "\n" else " " + word


#: in the names of an Arrow array: the first chunk of a text or line begins with HEAD; FEED and END stand alone
#: (a head too is what follows a letter or number right away: a comma or stop before white space)
HEAD, FEED, END = "\x01", "\n", "\x02"
STOPS = (",", ".")
#: texts with other white space than single spaces and line feeds between words, with HEAD or END in them, or with a stop after another sign
UNEVEN = r"\A[ \n]|[ \n][ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x01\x02]|(?:\A|[^\pL\pN])[.,](?:[ \n]|\z)"


def names(texts: pa.Array) -> pa.ListArray:
    """The chunks of texts that are not UNEVEN, cut at spaces and line feeds, END after each text."""
    marked = pc.binary_join_element_wise(HEAD, pc.replace_substring(texts, "\n", f" {FEED} {HEAD}"), f" {END}", "")
    for stop in STOPS:
        marked = pc.replace_substring(marked, f"{stop} ", f" {HEAD}{stop} ")
    return pc.split_pattern(marked, " ")


def strings(distinct: pa.Array) -> list[str]:
    """The names of an array as Python strings, turned at once: no name holds a space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().split(" ")


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``most_bytes``; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
