"""Files that cannot have what a query asks for are read but not lexed; the rows stay those of all files."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomscan.functions.text import entropy
from loomscan.operators import detect, extract, lexer, metrics
from loomscan.plans import portfolio, scans, surface

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SHAPES = [metrics.OVERSIZED, metrics.COMPLEX, metrics.NESTED, metrics.LOOPED, metrics.LEAKING]
FILES = "rel_path string, ext string, content string"
#: Comments between the words of a call, runs of signs, literals beside words: masking makes them blanks.
ODD = [
    "eval/* x */(a); new /* y */ Function /* z */ ('b');", "new\n// c\nFunction(1)", "x = Math.random(); // token", "CREATEHASH('md5'); createHash ('md5'); createhash(/* a */ \"SHA1\")", "console.log(1)", "'console.log(1)'",
    "for (const a of b) { db.query /* q */ (a); }", "xs.map(x => db.findOne\n(x))", "useEffect(/* e */ () => { setTimeout(f); });", "useEffect (() => { setTimeout(f); });",
    "function f() { 'x'if (a) {/**/if (b) {/r/g\nif (c) { if (d) { if (e) { if (f) { g(); } } } } } } }", "function f() { return a???b:c ? d : e && f || g&&&h ?? i ? j : k ?? l ?? m && n && o || p; }",
    "function f() {\n" + "\n" * 79 + "}", "function f() {\n" + "\n" * 80 + "}", "const a = '" + "aB3" * 7 + "'; const b = \"" + "q8Zt3Lw0Xn5Rb7Vy2Kc9" + "\"", "const c = 'q8Zt3Lw0Xn5Rb7Vy2Kc9", "const d = '" + "a" * 185 + "q8Zt3Lw0Xn5Rb7V'", "",
]


def told(df) -> Counter:
    return Counter(map(str, df.collect()))


def odd(spark):
    return spark.createDataFrame([(f"{i}.ts", ".ts", t) for i, t in enumerate(ODD)], FILES)


@pytest.mark.parametrize("category", SHAPES)
def test_shapes_of_files_that_may_have_them_are_all(spark, category):
    for files in (odd(spark), scans.TREE.files(spark, SF)):
        every = told(metrics.findings(metrics.blocks_of(files)).where(F.col("category") == category))
        assert every and told(metrics.findings_of(files, category)) == every


@pytest.mark.parametrize("category", list(detect.LIVE))
def test_live_code_of_files_that_may_have_it_is_all(spark, category):
    for files in (odd(spark), scans.TREE.files(spark, SF)):
        every = told(detect.code_findings(lexer.masked(files)).where(F.col("category") == category))
        assert every and told(scans.live(files, category)) == every


def test_random_strings_of_files_that_may_have_them_are_all(spark):
    for files in (odd(spark), scans.TREE.files(spark, SF)):
        for threshold in (2.0, 4.0):
            every = told(detect.entropy_findings(lexer.masked(files), threshold))
            assert every and told(detect.entropy_findings(lexer.masked(files.where(F.col("content").rlike(detect.LITERAL))), threshold)) == every
    rows = spark.createDataFrame([("aab",), ("",), ("ab😀😀",), (None,)], "t string").select(entropy(F.col("t"), 4).alias("e")).collect()
    assert [r["e"] for r in rows] == [0.9183, 0.0, 1.5, None]


@pytest.mark.parametrize("name, least", [("scan_debug_logging", 4), ("scan_eval", 4), ("scan_function_constructor", 4), ("scan_weak_hash", 4), ("scan_weak_random", 4), ("scan_entropy", 2), ("scan_effect_cleanup", 5), ("scan_queries_in_loops", 2), ("scan_nesting", 3)])
def test_most_files_are_not_lexed(spark, monkeypatch, name, least):
    seen, whole = [], lexer.masked
    monkeypatch.setattr(lexer, "masked", lambda files: seen.append(files) or whole(files))
    portfolio.QUERIES[name](spark, SF)
    assert seen[0].count() * least <= scans.TREE.files(spark, SF).count()


def test_texts_are_made_for_the_files_that_are_asked_for(spark):
    plan = portfolio.QUERIES["extract_js_classes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("mongoose.Schema") < plan.index("Filter") < plan.index("inline(")  # the text is made above the filter on names
    plan = portfolio.QUERIES["npm_declared"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    plan = portfolio.QUERIES["extract_next"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "HandleFunc\\(" not in plan


def test_routes_of_files_alone(spark):
    f = surface.PROJECT.files(spark, SF)
    assert told(extract.next_routes(f)) == told(extract.routes(f).where("handler = '(file)'").select("rel_path", "method", "path", "handler", "line"))


def test_methods_and_models_of_files_that_may_have_them_are_all(spark):
    files = odd(spark).union(spark.createDataFrame([("m.ts", ".ts", "class/**/A { f(x) { g(); } }\nfunction h() { }"), ("n.js", ".js", "/* B */ @Entity()\nclass C { @Column() d: string; }"), ("o.sql", ".sql", "-- t\nCreate Table t (a INT);")], FILES))
    every = told(metrics.blocks_of(files).where("kind = 'function' and name like '%.%'").select("rel_path", "name", "line"))
    assert every and told(metrics.methods(files)) == every
    assert {(r["origin"], r["model"], r["field"]) for r in extract.models(files).collect()} >= {("typeorm", "C", "d"), ("sql", "t", "a")}
