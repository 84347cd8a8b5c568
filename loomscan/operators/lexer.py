"""Masked code: one Arrow pass blanks comments and literals, so that patterns on `masked` meet live code only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKED = "rel_path string, ext string, content string, masked string, words string, strings array<struct<value:string,line:int>>"
#: What may start a literal or comment, by language family; strings end at their quote or the file's end.
STRING = r"""(?P<s>"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z))|(?P<t>`(?:[^`\\]|\\.)*(?:`|\\?\Z))"""
PYTHON = re.compile(r'(?P<c>#[^\n]*|"""(?:.*?"""|.*\Z)|' + r"'''(?:.*?'''|.*\Z))|" + STRING, re.S)
OTHER = re.compile(r"(?P<c>//[^\n]*|/\*(?:.*?\*/|.*\Z))|" + STRING + r"|(?P<slash>/)", re.S)
REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
#: Characters and words after which a slash starts a regular expression.
BEFORE_REGEX = frozenset("([{,;:!&|?=+-*%^~<>")
WORDS_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete throw case do else yield await".split())
#: Plain short words, kept in `words`: names of algorithms, encodings, methods.
PLAIN = re.compile(r"[\w-]{1,16}\Z")
LINE = re.compile(r"[^\n]")
LAST_WORD = re.compile(r"[\w$]+\Z")


def blank(text: str) -> str:
    """As long as the text, with its line ends."""
    return LINE.sub(" ", text)


def starts_regex(before: str, last: str) -> bool:
    """Whether a slash after this code, whose last character but blanks is `last`, starts a regular expression."""
    if not last or last in BEFORE_REGEX:
        return True
    word = LAST_WORD.search(before)
    return bool(word) and word[0] in WORDS_BEFORE_REGEX


def lex(text: str, ext: str = ".js") -> tuple[str, str, list[dict]]:
    """Code without comments and literals, the same with short plain strings kept, and the strings with their lines."""
    piece = PYTHON if ext == ".py" else OTHER
    masked, words, strings = [], [], []
    at = done = 0  # of the search, and of what has been written
    last = ""
    line, counted = 1, 0
    while m := piece.search(text, at):
        code = text[at : m.start()].rstrip()
        last = code[-1] if code else last
        end = m.end()
        if m.lastgroup == "slash":
            r = REGEX.match(text, m.start()) if starts_regex(text[max(done, m.start() - 20) : m.start()].rstrip(), last) else None
            if r is None:
                last, at = "/", end
                continue
            end, last = r.end(), "/"
        masked.append(text[done : m.start()])
        words.append(masked[-1])
        hidden = blank(text[m.start() : end])
        masked.append(hidden)
        if m.lastgroup == "s":
            line, counted = line + text.count("\n", counted, m.start()), m.start()
            value = m["s"][1:-1]
            strings.append({"value": value, "line": line})
            words.append(m["s"] if PLAIN.match(value) else hidden)
        else:
            words.append(hidden)
        if m.lastgroup in ("s", "t"):
            last = m[0][0]
        at = done = end
    masked.append(text[done:])
    words.append(text[done:])
    return "".join(masked), "".join(words), strings


def masked(files: DataFrame) -> DataFrame:
    """(rel_path, ext, content, masked, words, strings with lines); files without content are left out."""
    kind = pa.list_(pa.struct([("value", pa.string()), ("line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                out = [lex(t, e) for e, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                made = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], kind)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=["rel_path", "ext", "content", "masked", "words", "strings"])

    return files.where(F.col("content").isNotNull()).select("rel_path", "ext", "content").mapInArrow(run, MASKED)
