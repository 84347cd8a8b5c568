"""Globs and .gitignore patterns as anchored regular expressions, and version order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscan.functions.text import regex_literal


def glob_regex(glob: str) -> str:
    """`**/` any number of segments, `**` anything, `*` all but a slash, `?` one such character; anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + regex_literal(glob[i]), i + 1
    return f"^{out}$"


def gitignore_rules(text: str) -> list[tuple[int, bool, str]]:
    """(order, negated, regex) of a .gitignore file; a pattern without an inner slash holds at any depth."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        body = glob_regex(line)[1:-1]
        rules.append((len(rules), negated, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def ignored_by(path: Column, rules: list[tuple[int, bool, str]]) -> Column:
    """The last rule that matches decides; none: kept."""
    out = F.lit(False)
    for _, negated, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def version_parts(version: Column) -> Column:
    """Digits and dots only, as numbers: the parts of a range run together, as in `>=1.0.0 <2.0.0`."""
    return F.transform(F.split(F.regexp_replace(version, r"[^0-9.]", ""), r"\."), lambda p: F.coalesce(F.try_to_number(F.when(p == "", "0").otherwise(p), F.lit("999999999")).cast("long"), F.lit(0).cast("long")))


def version_less(a: Column, b: Column) -> Column:
    """a < b part by part, missing parts as 0."""
    pad = lambda x, y: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    x, y = version_parts(a), version_parts(b)
    return pad(x, y) < pad(y, x)
