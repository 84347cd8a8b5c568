"""Rules as tables: each app's .gitignore lines and globs, and suppression rules, met by joins and not by the plan's shape.

An app's ignore rules are few, so they travel as one array beside its files and the last match decides. Suppression rules
may be many: they are filed under what a path must have to meet them (its last segment, its leading folders, its ending),
paths look their own keys up by equality, and only what shares a key is put to the regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions.text import basename


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a glob column, without anchors: `**/` any folders, `**` anything, `*` all but a slash."""
    out = F.regexp_replace(glob, r"[.+^${}()|\[\]\\]", r"\\$0")
    for mark, sign in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        out = F.replace(out, F.lit(mark), F.lit(sign))
    return out


def anchored(pattern: Column) -> Column:
    return F.concat(F.lit("^"), pattern, F.lit("$"))


def gitignore_table(texts: DataFrame) -> DataFrame:
    """(app_id, ord, negated, regex) of the lines of .gitignore texts (app_id, content); blank lines and comments are none.

    A pattern without an inner slash holds at any depth; one that ends in a slash means what lies in the folder.
    """
    lines = texts.select("app_id", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    own = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    negated = F.col("line").startswith("!")
    body = F.regexp_replace("line", "^!", "")
    bare = F.regexp_replace(body, "/+$", "")
    start = F.when(F.contains(bare, F.lit("/")), "").otherwise("(?:.*/)?")
    end = F.when(body.endswith("/"), "/.*").otherwise("(?:/.*)?")
    return own.select("app_id", "ord", negated.alias("negated"), anchored(F.concat(start, glob_pattern(F.regexp_replace(bare, "^/", "")), end)).alias("regex"))


def glob_table(patterns: DataFrame, now: Column) -> DataFrame:
    """(app_id, regex) of unexpired ignore patterns (app_id, pattern, expires_at)."""
    live = patterns.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return live.select("app_id", anchored(glob_pattern(F.col("pattern"))).alias("regex"))


def inherited(rules: DataFrame, apps: DataFrame) -> DataFrame:
    """Rules of the apps (app_id, owner): their own, and those that name an owner in place of an app (rules: app_id, owner, ...)."""
    rest = [c for c in rules.columns if c not in ("app_id", "owner")]
    own = rules.where("app_id is not null").select("app_id", *rest)
    shared = rules.where("app_id is null").drop("app_id").join(apps.select("app_id", "owner"), "owner").select("app_id", *rest)
    return own.unionByName(shared)


def with_ignored(files: DataFrame, lines: DataFrame, globs: DataFrame | None = None) -> DataFrame:
    """files (app_id, rel_path, ...) with column `ignored`: by the last of its app's lines that matches, or by any glob.

    An app's rules are gathered in one array (people write them, so an app has few) and joined to its files; the join keeps
    files where they are if the rules are small, and is split by skew if one app has most files.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "negated", "regex")))
    out = files.join(lines.groupBy("app_id").agg(ordered.alias("__lines")), "app_id", "left")
    met = F.filter("__lines", lambda r: F.rlike(F.col("rel_path"), r["regex"]))
    ignored = F.coalesce(~F.try_element_at(met, F.lit(-1))["negated"], F.lit(False))
    if globs is not None:
        out = out.join(globs.groupBy("app_id").agg(F.collect_set("regex").alias("__globs")), "app_id", "left")
        ignored = ignored | F.coalesce(F.exists("__globs", lambda g: F.rlike(F.col("rel_path"), g)), F.lit(False))
    return out.withColumn("ignored", ignored).drop("__lines", "__globs")


#: Parts that the paths of one key are dealt to; a rule is filed in each.
SALTS = 16
WILD = r"[*?]"


def rule_key(glob: Column) -> Column:
    """What a path must have to meet a glob: its last segment (`f:`), its leading folders (`d:`), its ending (`x:`), or nothing."""
    last = basename(glob)
    folders = F.regexp_extract(glob, r"^((?:[^*?/]+/)++)", 1)
    ending = F.regexp_extract(last, r"^[^.]*[*?]([.][^*?.]+)$", 1)
    plain = ~last.rlike(WILD) & (last != "")
    return F.when(plain, F.concat(F.lit("f:"), last)).when(folders != "", F.concat(F.lit("d:"), folders)).when(ending != "", F.concat(F.lit("x:"), ending)).otherwise("")


def path_keys(path: Column) -> Column:
    """Every key under which a rule that the path meets may be filed."""
    segments = F.split(path, "/")
    n = F.size(segments) - 1
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/")))
    folders = F.when(n > 0, prefixes).otherwise(F.array().cast("array<string>"))
    ending = F.regexp_extract(basename(path), r"([.][^.]+)$", 1)
    return F.concat(F.array(F.lit(""), F.concat(F.lit("f:"), basename(path))), folders, F.when(ending != "", F.array(F.concat(F.lit("x:"), ending))).otherwise(F.array().cast("array<string>")))


def suppressed_kinds(findings: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Distinct (category, file) of findings that an unexpired rule (rule_category, pattern, expires_at) hides.

    Each kind of finding is asked for once, however many findings it has. Joins are by equality: keys are salted, so a
    common ending, or rules that have no key at all, are spread over SALTS tasks.
    """
    kinds = findings.select("category", "file").distinct().withColumn("__salt", F.pmod(F.xxhash64("file", "category"), F.lit(SALTS)).cast("int"))
    asked = kinds.withColumn("__key", F.explode(path_keys(F.col("file"))))
    live = rules.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    filed = live.select("rule_category", rule_key(F.col("pattern")).alias("__key"), anchored(glob_pattern(F.col("pattern"))).alias("__regex")).distinct()
    filed = filed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = ((F.col("rule_category") == "any") | (F.col("rule_category") == F.col("category"))) & F.rlike(F.col("file"), F.col("__regex"))
    return asked.join(filed, ["__key", "__salt"]).where(met).select("category", "file").distinct()


def without_suppressed(findings: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    return findings.join(suppressed_kinds(findings, rules, now), ["category", "file"], "left_anti").select(*findings.columns)
