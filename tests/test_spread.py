"""Queries over files derived from `part` deal the parts out, and no side that grows with them is broadcast."""

import os

import pytest
from pyspark.sql import functions as F

from loomscan.operators import detect, extract, lexer, metrics
from loomscan.plans import calls, portfolio, scans, sources, stores, surface, trees
from loomscan.sources import files as src

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
assert calls and stores and surface and trees


def test_parts_of_one_row_group_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sources, "PARTS", 50, raising=False)
    files = scans.TREE.files(spark, SF)
    tasks = files.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) == 4 and sum(t["n"] for t in tasks) == 200 * len(scans.TEMPLATES)


@pytest.mark.parametrize("name", ["graph_edges", "graph_edge_order", "graph_dead_code", "dead_code_findings", "call_resolution", "call_kinds", "route_handlers", "route_functions", "import_bindings"])
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = portfolio.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name, passes", [("call_kinds", 2), ("scan_oversized", 1), ("scan_complexity", 1)])
def test_bodies_are_parsed_no_oftener_than_needed(spark, name, passes):
    plan = portfolio.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 * passes  # the lexer's pass and that of the bodies


@pytest.mark.parametrize("name, passes", [("call_resolution", 1), ("entry_trace", 0), ("route_functions", 0), ("route_traces", 0)])
def test_files_are_parsed_once(spark, name, passes):
    plan = portfolio.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == passes


def test_fewer_kinds_are_the_same_rows(spark):
    f, told = surface.PROJECT.files(spark, SF), lambda df: sorted(map(str, df.collect()))
    for kind in ("class", "import", "export", "function"):
        assert told(extract.components(f, [kind])) == told(extract.components(f).where(F.col("kind") == kind))
    for origin in ("sql", "prisma", "django", "typeorm", "mongoose"):
        assert told(extract.models(f, [origin])) == told(extract.models(f).where(F.col("origin") == origin))
    code = lexer.masked(scans.TREE.files(spark, SF))
    for category in ("Code Injection Risk", detect.HASHING, detect.RANDOM, detect.DEBUG):
        assert told(detect.code_findings(code, [category])) == told(detect.code_findings(code).where(F.col("category") == category))


def test_a_call_by_a_renamed_import_and_one_of_its_own_file(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    made = row("rel_path string, caller string, callee string, ord int", ("a.js", "f", "all", 0), ("a.js", "f", "g", 1), ("a.js", "f", "users.gone", 2), ("a.js", "f", "db.query", 3), ("a.js", "f", "no", 4))
    functions = row("rel_path string, name string, line int", ("a.js", "g", 1), ("b.js", "all", 1))
    bound = row("rel_path string, local string, to_path string", ("a.js", "all", "b.js"), ("a.js", "users", "b.js"), ("a.js", "g", "b.js"), ("a.js", "db", "b.js"))
    got = {r["callee"]: (r["kind"], r["to_path"], r["target"]) for r in metrics.classified(made, functions, bound).collect()}
    assert got == {"all": ("imported", "b.js", "all"), "g": ("local", "a.js", "g"), "users.gone": ("opaque-project", "b.js", None), "db.query": ("external", None, "Database call")}


def test_tasks_list_and_read_pages(spark, tmp_path):
    for path in ("a.md", "x/b.md", "x/y z/c.md", "x/no.txt", ".git/d.md", "_x/e.md", "x/_f.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"# {path}\n")
    pages = src.markdown(spark, str(tmp_path))
    assert sorted(map(tuple, pages.collect())) == sorted((f"{tmp_path}/{p}", f"# {p}\n") for p in ("a.md", "x/b.md", "x/y z/c.md"))
    assert "FileScan" not in pages._jdf.queryExecution().executedPlan().toString()  # its index would be the driver's


def test_pages_of_archives_are_read_as_if_unpacked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "ARCHIVED", 3)
    pages = [(f"app{i}/x/p{i}.md", f"é {i}") for i in range(8)] + [("app9/empty.md", None), ("app9/_no.md", "x"), ("app9/no.txt", "x"), (".git/no.md", "x")]
    assert src.write_archives(spark.createDataFrame(pages, "rel_path string, content string").coalesce(1), str(tmp_path)) == 12
    assert len(list(tmp_path.iterdir())) == 4  # files on disk do not grow with the pages
    assert sorted(map(tuple, src.markdown(spark, str(tmp_path)).collect())) == sorted((f"{tmp_path}/{p}", t or "") for p, t in pages[:9])
