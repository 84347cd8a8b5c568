"""Bodies between balanced delimiters: one linear scan of a text in Arrow batches, for patterns that cannot count.

A regular expression that nests groups to follow brackets recurses in the JVM, once for each character or element, and a
long body ends the process. Here a head pattern finds where a body opens, one pass over the text's delimiters tells where
it closes and which commas are its own, and plain expressions then work on the parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "rel_path string, kind string, name string, line int, body string, parts array<string>"
SCHEMA = pa.schema([
    ("rel_path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("body", pa.string()), ("parts", pa.list_(pa.string())),
])
QUOTED = r"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`|[()\[\]{},]"""
#: Comments, literals and delimiters, by how a language writes its comments.
TOKENS = {
    "--": re.compile(r"(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z))" + QUOTED, re.S),
    "//": re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))" + QUOTED, re.S),
}
PARTNER = {")": "(", "]": "[", "}": "{"}


class Head(NamedTuple):
    """What opens a body: a pattern whose first group is the name and whose match ends with the opening delimiter. A text
    without `word`, in any case, has no match."""

    kind: str
    exts: list[str]
    pattern: str
    comments: str = "//"
    word: str = ""


def nested(open_: str, close: str, depth: int) -> str:
    """Text without an unbalanced delimiter, for Java and Python: possessive, so neither backtracks nor recurses by length."""
    plain = f"[^{re.escape(open_)}{re.escape(close)}]"
    out = f"{plain}*+"
    for _ in range(depth):
        out = f"(?:{plain}++|{re.escape(open_)}{out}{re.escape(close)})*+"
    return out


def delimiters(text: str, comments: str) -> tuple[dict[int, int], dict[int, list[int]], str]:
    """(closing place of each opening delimiter that has one, commas directly inside it, the text without comments)."""
    close: dict[int, int] = {}
    commas: dict[int, list[int]] = {}
    open_: list[int] = []
    kept, at = [], 0
    for m in TOKENS[comments].finditer(text):
        token, place = m[0], m.start()
        if m.lastgroup == "c":
            kept += [text[at:place], re.sub(r"[^\n]", " ", token)]
            at = m.end()
        elif token in "([{":
            open_.append(place)
        elif token == "," and open_:
            commas.setdefault(open_[-1], []).append(place)
        elif token in PARTNER and open_ and text[open_[-1]] == PARTNER[token]:
            close[open_.pop()] = place
    return close, commas, "".join([*kept, text[at:]])


def bodies(text: str, heads: list[tuple[Head, re.Pattern]]) -> Iterator[tuple]:
    """(kind, name, line, body, parts) of each head in a text; a body that never closes is none."""
    read: dict[str, tuple] = {}
    ends = [m.start() for m in re.finditer("\n", text)]
    for head, pattern in heads:
        if not pattern.search(text):
            continue
        if head.comments not in read:
            read[head.comments] = delimiters(text, head.comments)
        close, commas, plain = read[head.comments]
        for m in pattern.finditer(plain):
            start = m.end() - 1
            if start in close:
                cuts = [start, *commas.get(start, []), close[start]]
                parts = [p for a, b in zip(cuts, cuts[1:], strict=False) if (p := plain[a + 1 : b].strip())]
                yield head.kind, m[1], bisect_left(ends, m.start()) + 1, plain[start + 1 : close[start]], parts


def spans(files: DataFrame, heads: list[Head]) -> DataFrame:
    """(rel_path, kind, name, line, body, parts) of the bodies that the heads open in files of their extensions."""
    exts = sorted({e for h in heads for e in h.exts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {e: [(h, re.compile(h.pattern)) for h in heads if e in h.exts] for e in exts}
        for b in batches:
            for i in range(0, b.num_rows, 50):
                part = b.slice(i, 50)
                found = [(p, *x) for p, e, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in bodies(t, ready[e])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    worth = [F.lower("content").contains(h.word.lower()) & F.col("ext").isin(h.exts) for h in heads]
    own = files.where(F.col("ext").isin(exts) & F.col("content").isNotNull()).where(reduce(or_, worth, F.lit(False)))
    return own.select("rel_path", "ext", "content").mapInArrow(run, SPANS)
