"""Rule tables against rules one by one: each app's ignore lines, inherited globs, suppression rules by key."""

import random

from pyspark.sql import functions as F

from loomscan.functions import globs
from loomscan.operators import rules

def now():
    return F.lit("2024-01-01").cast("timestamp")


def test_glob_columns_equal_glob_texts(spark):
    paths = ["x.js", "a/x.js", "a/b/x.js", "a/b.min.js", "build/o.js", "a.b+c/(d).js", "a/bb/x.jsx"]
    patterns = ["**/x.js", "a/*.js", "?.js", "a/**", "**", "*", "a.b+c/(d).js", "**/b/**", "a/**/x.js"]
    df = spark.createDataFrame([(p, g) for p in paths for g in patterns], "path string, glob string")
    got = {(r["path"], r["glob"]): r["hit"] for r in df.select("path", "glob", F.rlike("path", rules.anchored(rules.glob_pattern(F.col("glob")))).alias("hit")).collect()}
    for g in patterns:
        want = {r["path"] for r in df.where(F.col("path").rlike(globs.glob_regex(g))).collect()}
        assert {p for p in paths if got[p, g]} == want, g


def test_each_app_has_its_own_lines(spark):
    texts = {1: "# c\n*.log\n!keep.log\nbuild/\n/a/b\n", 2: "!x.js\r\n\r\n*.js\n", 3: ""}
    paths = ["n.log", "keep.log", "a/keep.log", "build", "build/o.js", "keep/build/o.js", "a/b/x.js", "c/a/b/x.js", "x.js"]
    table = rules.gitignore_table(spark.createDataFrame(list(texts.items()), "app_id long, content string"))
    files = spark.createDataFrame([(a, p) for a in (1, 2, 3, 4) for p in paths], "app_id long, rel_path string")
    got = {(r["app_id"], r["rel_path"]) for r in rules.with_ignored(files, table).where("ignored").collect()}
    want = set()
    for a, text in texts.items():
        one = spark.createDataFrame([(p,) for p in paths], "p string").where(globs.ignored_by(F.col("p"), globs.gitignore_rules(text)))
        want |= {(a, r["p"]) for r in one.collect()}
    assert got == want and rules.with_ignored(files, table).count() == len(paths) * 4


def test_patterns_are_inherited_and_expire(spark):
    apps = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "app_id long, owner int")
    table = spark.createDataFrame([(1, None, "a/**", None), (None, 10, "**/gen/**", "2025-01-01"), (None, 11, "**", "2023-01-01")], "app_id long, owner int, pattern string, e string").withColumn("expires_at", F.col("e").cast("timestamp")).drop("e")
    files = spark.createDataFrame([(a, p) for a in (1, 2, 3) for p in ("a/x", "b/gen/y", "c")], "app_id long, rel_path string")
    none = spark.createDataFrame([], "app_id long, ord int, negated boolean, regex string")
    got = rules.with_ignored(files, none, rules.glob_table(rules.inherited(table, apps), now())).where("ignored")
    assert sorted((r["app_id"], r["rel_path"]) for r in got.collect()) == [(1, "a/x"), (1, "b/gen/y"), (2, "b/gen/y")]


def test_suppression_by_key_equals_all_pairs(spark):
    rng = random.Random(3)
    seg = lambda: rng.choice(["a", "b", "src", "x.js", "y.ts", "z", "index.js"])
    files = {"/".join(seg() for _ in range(rng.randrange(1, 5))) for _ in range(120)} | {"", "a.", ".js", "a//b.js"}
    wild = lambda: rng.choice(["a", "b", "src", "*", "**", "?", "x*", "*.js", "x.js", "*.min.js", "y.??"])
    table = [(rng.choice(["any", "c1", "c2"]), "/".join(wild() for _ in range(rng.randrange(1, 4))), rng.choice([None, "2023-01-01", "2025-01-01"])) for _ in range(60)]
    findings = spark.createDataFrame([(c, f, i) for i, f in enumerate(sorted(files)) for c in ("c1", "c2", "c3")], "category string, file string, line int")
    many = spark.createDataFrame(table, "rule_category string, pattern string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    got = {tuple(r) for r in rules.suppressed_kinds(findings, many, now()).collect()}
    import re

    live = [(c, re.compile(globs.glob_regex(g))) for c, g, e in table if e is None or e >= "2024-01-01"]
    want = {(c, f) for f in files for c in ("c1", "c2", "c3") if any(r in ("any", c) and p.match(f) for r, p in live)}
    assert got == want and 0 < len(want) < len(files) * 3
    left = rules.without_suppressed(findings, many, now())
    assert left.columns == findings.columns and left.count() == findings.count() - len(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "NestedLoop" not in rules.without_suppressed(findings, many, now())._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
