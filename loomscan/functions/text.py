"""Column functions for text: lines of matches, entropy, slugs, paths, escapes, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Marks a match's start and end in a copy of the text; a text's own ones become blanks there.
MARK = "\x01"


def matches_with_lines(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """array<struct<match, line>>: all matches of a pattern and the line each starts on, without positions.

    Both ends of each match are marked in one pass of the pattern. The marked text cut at marks has the matches in every second
    place; cut into lines, a line gives its number once for each mark. Linear. With `needs`, one of which every match holds,
    texts that have none of them are not searched.
    """
    some = lambda t, parts: reduce(Column.__or__, [F.contains(t, F.lit(p)) for p in parts])
    plain = F.when(some(text, [MARK]), F.replace(text, F.lit(MARK), F.lit(" "))).otherwise(text)
    marked = F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}")
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(MARK), F.lit("")))
    numbers = lambda t, i: F.when(some(t, [MARK]), F.array_repeat((i + 1).cast("int"), marks(t).cast("int"))).otherwise(F.array().cast("array<int>"))
    second = lambda a, at: F.filter(a, lambda x, i: i % 2 == at)

    def told(m: Column) -> Column:
        lines = F.flatten(F.transform(F.split(m, "\n"), numbers))
        return F.arrays_zip(second(F.split(m, MARK), 1).alias("match"), second(lines, 0).alias("line"))

    both = F.flatten(F.transform(F.array(marked), told))  # a variable: the pattern is not tried again for each use
    none = F.array().cast("array<struct<match:string,line:int>>")
    found = some(text, needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(found, both.cast("array<struct<match:string,line:int>>")).otherwise(none)


def entropy(text: Column, digits: int | None = 2) -> Column:
    """Shannon entropy of a string's characters in bits, rounded to some digits if asked for."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return bits if digits is None else F.round(bits, digits)


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def folded(path: Column) -> Column:
    """A path without `.` and `..` segments."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def regex_literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def snippet(text: Column, needle: str, around: int = 60) -> Column:
    """The first hit (any case) with `around` characters on both sides, cut ends marked."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + len(needle) + around, F.length(text) + 1)
    shown = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start), F.when(stop <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, shown)


def duration_text(ms: Column) -> Column:
    """`250ms`, `1.3s`, `2m 5s`; tenths of a second and seconds are rounded half up."""
    tenths = F.floor((ms + 50) / 100)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor((ms % 60000) / 1000 + 0.5).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit("ms"))).when(ms < 60000, seconds).otherwise(minutes)


def due_text(due: Column, now: Column) -> Column:
    """How far off a time is: `3h overdue`, `due now`, `due within the hour`, `due in 5h`, `due in 2d`."""
    hours = (F.unix_micros(due.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3_600_000_000
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(hours < -1, F.concat(whole(-hours), F.lit("h overdue"))).when(hours < 0, "due now").when(hours < 1, "due within the hour")
        .when(hours < 24, F.concat(F.lit("due in "), whole(hours), F.lit("h"))).otherwise(F.concat(F.lit("due in "), whole(hours / 24), F.lit("d")))
    )
