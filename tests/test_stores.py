"""Stored graphs, versions of state, snapshot logs, checked rows, budgeted traces."""

import json

import pytest
from pyspark.sql import functions as F

from loomscan.operators import graph, history, state
from loomscan.sources import stores

EDGE = "app_id long, from_path string, to_path string, ord int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def apps(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "app_id long")


def test_graph_write_replaces_only_its_apps(spark, tmp_path):
    path = str(tmp_path / "graph")
    edges = lambda *e: spark.createDataFrame(list(e), EDGE)
    nodes = lambda *n: spark.createDataFrame(list(n), "app_id long, rel_path string")
    assert graph.read_graph(spark, path).count() == 0
    graph.write_graph(apps(spark, 1, 2, 3), nodes((1, "a"), (1, "b"), (2, "a")), edges((1, "a", "b", 4), (2, "a", "a/b", 1), (3, "x", "y", 2)), path)
    graph.write_graph(apps(spark, 1, 3), nodes((1, "a")), edges((1, "a", "c", 9)), path)
    assert rows(graph.read_graph(spark, path), "app_id", "src", "dst", "ord") == [(1, "a", "c", 9), (2, "a", "a/b", 1)]
    assert rows(graph.read_graph(spark, path, "node"), "app_id", "src") == [(1, "a"), (2, "a")] and rows(graph.read_graph(spark, path, "app"), "app_id") == [(1,), (2,), (3,)]
    plan = graph.read_graph(spark, path).where("app_id = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(app_id" in plan


def test_a_crash_between_the_steps_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "state"), "id long"
    write = lambda n: stores.write_state(spark.range(n), path)
    read = lambda: stores.read_state(spark, path, schema).count()
    write(2)
    assert read() == 2

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(stores, "point_to", crash)
    with pytest.raises(OSError):
        write(5)
    assert read() == 2  # the new version is there, but nothing names it
    monkeypatch.undo()
    write(3)
    assert read() == 3 and sum(p.name.startswith("v-") for p in (tmp_path / "state").iterdir()) == 1
    write(0)
    assert read() == 0


def test_snapshot_log_keeps_broken_lines_apart(spark, tmp_path):
    folder = tmp_path / "log" / "app_id=7"
    folder.mkdir(parents=True)
    whole = {"scan_id": 1, "scannedAt": "2024-01-02T03:04:05.678Z", "stats": {"files": 3}, "issues": [{"file": "a", "line": 1}], "extra": 1}
    (folder / "2024-01-02T03-04-05-678Z.json").write_text(json.dumps(whole))
    (folder / "2024-02-03T04-05-06-789Z.json").write_text(json.dumps({"app_id": 8, "scan_id": 2}) + "\n{broken\n")
    (folder / "odd.json").write_text(json.dumps({"scan_id": 3, "scannedAt": "yesterday"}))
    good, bad = history.read_log(spark, str(tmp_path / "log"))
    got = {r["scan_id"]: r for r in good.collect()}
    assert set(got) == {1, 2} and got[1]["app_id"] == 7 and got[2]["app_id"] == 8 and str(got[1]["scanned_at"]).startswith("2024-01-02 03:04:05.678") and str(got[2]["scanned_at"]).startswith("2024-02-03 04:05:06.789")
    assert got[1]["issues"][0]["file"] == "a" and got[1]["stats"]["files"] == 3
    assert rows(bad, "app_id", "reason", "line") == [(7, "no JSON", "{broken"), (7, "no time", None)]


def test_rules_are_checked_as_a_table(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    table = spark.createDataFrame(
        [("a/**", "why", "", "2024-06-01"), (" ", None, "x", "2024-06-01"), ("b", "why", "c", "2023-06-01"), ("b", "why", "c", "2025-06-01"), ("b", "why", None, None)],
        "pattern string, reason string, rule_category string, expires string",
    ).withColumn("expires_at", F.col("expires").cast("timestamp"))
    good, bad = state.checked_rules(table, now)
    assert rows(good, "pattern", "rule_category") == [("a/**", "any")]
    assert sorted(r["reasons"] for r in bad.collect()) == [
        ["a pattern is required", "a reason is required"], ["an expiry is required"], ["the expiry must lie in the future"], ["the expiry must lie within 365 days"],
    ]


def test_trace_keeps_its_budget_at_every_hop(spark):
    calls = [("r", f"n{i:03}", i) for i in range(200)] + [(f"n{i:03}", f"n{(i + 7) % 200:03}", 0) for i in range(200)] + [(f"n{i:03}", f"m{i:03}", 1) for i in range(200)] + [("r", "r", 500)]
    c = spark.createDataFrame(calls, "src string, dst string, ord int")
    got = graph.trace(spark.createDataFrame([("r",), ("n001",), ("none",)], "start string"), c, hops=3, budget=10).orderBy("start", "rn").collect()
    of = lambda s: [(r["node"], r["depth"]) for r in got if r["start"] == s]
    assert of("r") == [("r", 0)] + [(f"n{i:03}", 1) for i in range(9)] and of("none") == [("none", 0)]
    assert of("n001") == [("n001", 0), ("n008", 1), ("m001", 1), ("n015", 2), ("m008", 2), ("n022", 3), ("m015", 3)]


def test_edges_come_in_the_order_of_their_first_import(spark):
    f = spark.createDataFrame([("src/a.js",), ("src/b.js",), ("src/c.ts",)], "rel_path string")
    i = spark.createDataFrame([("src/a.js", "./c", 5), ("src/a.js", "./b.js", 9), ("src/a.js", "./b", 2), ("src/a.js", "./a", 1)], "from_path string, spec string, ord int")
    assert rows(graph.edges(i, f), "from_path", "to_path", "ord") == [("src/a.js", "src/b.js", 2), ("src/a.js", "src/c.ts", 5)]


def test_one_app_of_a_log_is_read_from_its_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "scan_id long, app_id long"
    for i in range(2):
        history.append(spark.range(100).select((F.col("id") + 100 * i).alias("scan_id"), (F.col("id") % 10).alias("app_id")), path)
    own = history.read_snapshots(spark, path, schema, 3)
    assert own.count() == 20 and set(own.columns) == {"scan_id", "app_id"} and history.read_snapshots(spark, path, schema).count() == 200
    assert "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().toString()


def test_scratch_tables_can_be_dropped(spark):
    held = stores.cut(spark.range(3), "held")
    assert held.count() == 3
    path = held.inputFiles()[0].rsplit("/", 1)[0]
    stores.drop_scratch(spark)
    store, p = stores.hadoop(spark, path)
    assert not store.exists(p) and not stores._made
