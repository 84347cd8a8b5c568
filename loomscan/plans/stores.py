"""Registered queries of what is written and read back: stored graphs, snapshot logs, state versions, checked rules; and of
budgeted traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import text
from loomscan.operators import extract, graph, history, state
from loomscan.plans import corpus, surface
from loomscan.plans import portfolio as pf
from loomscan.plans.portfolio import ctes, query
from loomscan.plans.sources import lines
from loomscan.sources import fixtures as fx
from loomscan.sources import stores

SECTION = "^[a-z]+://[^/]*/([^/?#]*)"
SQL_SITE = f"""{corpus.SQL_LINKS}, site AS (SELECT DISTINCT page_id % 20 AS app_id, page_id, '/' || regexp_extract(url, '{SECTION}', 1) AS src, target AS dst FROM links)"""


def site(spark, sf) -> DataFrame:
    """(app_id, page_id, src, dst): links from site sections, pages dealt to twenty apps."""
    src = F.concat(F.lit("/"), F.regexp_extract("url", SECTION, 1))
    return corpus.links(spark, sf).select((F.col("page_id") % 20).alias("app_id"), "page_id", src.alias("src"), F.col("target").alias("dst")).distinct()


@query(ctes(SQL_SITE) + """, live AS (SELECT * FROM site WHERE CASE WHEN app_id % 2 = 0 THEN app_id <> 4 ELSE page_id % 3 <> 0 END)
SELECT app_id, src, dst, min(page_id) AS ord FROM live GROUP BY ALL""")
def graph_store(spark, sf):
    """Two runs into one stored graph: the first writes all apps (two thirds of their pages), the second only the even ones
    (all pages, of which app 4 has lost every one); the others keep their first graph."""
    all_, path = site(spark, sf), stores.scratch(spark, "graph")
    apps = fx.read(spark, sf, "pages").select((F.col("page_id") % 20).alias("app_id"))

    def run(apps_: DataFrame, links: DataFrame) -> None:
        edges = links.groupBy("app_id", F.col("src").alias("from_path"), F.col("dst").alias("to_path")).agg(F.min("page_id").alias("ord"))
        graph.write_graph(apps_, edges.select("app_id", F.col("from_path").alias("rel_path")).distinct(), edges, path)

    run(apps, all_.where("page_id % 3 <> 0"))
    run(apps.where("app_id % 2 = 0"), all_.where("app_id % 2 = 0 and app_id <> 4"))
    return graph.read_graph(spark, path)


@query(ctes(SQL_SITE).replace("WITH", "WITH RECURSIVE") + """, e AS (SELECT DISTINCT src, dst FROM site),
r AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e UNION SELECT start, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 4),
first AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT start, node, depth, rn FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node)::int AS rn FROM first) WHERE rn <= 25""")
def budgeted_trace(spark, sf):
    """What each site section leads to within four links, 25 targets at most."""
    e = site(spark, sf).select("src", "dst").distinct().withColumn("ord", F.lit(0))
    return graph.trace(e.select(F.col("src").alias("start")), e, hops=4, budget=25)


def placed_imports(f: DataFrame) -> DataFrame:
    return extract.components(f, ["import"]).select(F.col("rel_path").alias("from_path"), F.col("name").alias("spec"), F.col("line").alias("ord"))


@query(f"""WITH {surface.PROJECT.sql()}, l AS ({lines()}), {surface.IMPORTS}, {surface.MEANT}
SELECT from_path, to_path, row_number() OVER (PARTITION BY from_path ORDER BY min(line), to_path)::int AS place FROM edge WHERE from_path <> to_path GROUP BY 1, 2""")
def graph_edge_order(spark, sf):
    """Edges of the import graph in the order in which a file first imports them."""
    f = surface.PROJECT.files(spark, sf)
    place = F.row_number().over(Window.partitionBy("from_path").orderBy("ord", "to_path"))
    return graph.edges(placed_imports(f), f).select("from_path", "to_path", place.alias("place"))


#: Every eleventh order is a broken line, every seventh of the rest has no time of its own.
@query(ctes(fx.SQL_SNAPSHOTS) + """SELECT 'snapshot' AS kind, app_id, count(*) AS n, max(scanned_at) AS last FROM snapshots WHERE scan_id % 11 <> 0 AND scan_id % 7 <> 0 GROUP BY 2
UNION ALL SELECT CASE WHEN scan_id % 11 = 0 THEN 'no JSON' ELSE 'no time' END, CASE WHEN scan_id % 11 <> 0 THEN app_id END, count(*), NULL FROM snapshots WHERE scan_id % 11 = 0 OR scan_id % 7 = 0 GROUP BY 1, 2""")
def snapshot_log(spark, sf):
    """Snapshots through a log of JSON lines in which some are broken and some have no time: what comes back, and what is
    kept apart."""
    own, path = fx.snapshots(spark, sf), stores.scratch(spark, "log")
    issue = F.struct(F.lit("a.js").alias("file"), F.lit(1).alias("line"), F.lit("High").alias("severity"), F.lit("c").alias("category"), F.lit("s").alias("summary"))
    rows = own.select(
        "app_id", "scan_id", F.when(F.col("scan_id") % 7 != 0, F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("scannedAt"),
        F.struct(F.lit(1).cast("long").alias("files"), F.col("scan_id").alias("issues"), F.lit(0).cast("long").alias("routes"), F.lit(0).cast("long").alias("models")).alias("stats"), F.array(issue).alias("issues"),
    )
    history.write_log(rows.where("scan_id % 11 <> 0"), path)
    rows.where("scan_id % 11 = 0").select(F.concat(F.lit('{"scan_id": '), F.col("scan_id").cast("string"), F.lit(', "stats": {')).alias("value")).write.mode("append").text(path)
    good, bad = history.read_log(spark, path)
    counted = good.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"), F.max("scanned_at").cast("timestamp_ntz").alias("last")).withColumn("kind", F.lit("snapshot"))
    apart = bad.groupBy(F.col("reason").alias("kind"), "app_id").agg(F.count(F.lit(1)).alias("n")).withColumn("last", F.lit(None).cast("timestamp_ntz"))
    return counted.unionByName(apart).select("kind", "app_id", "n", "last")


@query("SELECT o_orderpriority AS name, count(*) AS n, sum(o_totalprice)::decimal(30, 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def state_versions(spark, sf):
    """A state table written twice and read back: the second version holds."""
    path, schema = stores.scratch(spark, "state"), "name string, n long, total decimal(30,2)"
    orders = fx.read(spark, sf, "orders")
    of = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("decimal(30,2)").alias("total"))
    stores.write_state(of(orders), path)
    stores.write_state(of(orders.where("o_orderstatus = 'F'")), path)
    return stores.read_state(spark, path, schema)


REASONS = ("a pattern is required", "a reason is required", "an expiry is required", "the expiry must lie in the future", "the expiry must lie within 365 days")
FAILS = ("o_custkey % 10 = 0", "o_orderstatus = 'P'", "o_orderkey % 13 = 0", f"o_orderkey % 13 <> 0 AND o_orderdate <= TIMESTAMP '{fx.NOW}' - INTERVAL 300 DAY", f"o_orderkey % 13 <> 0 AND o_orderdate > TIMESTAMP '{fx.NOW}' - INTERVAL 300 DAY + INTERVAL 365 DAY")


@query("WITH r AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in zip(REASONS, FAILS, strict=True)) + """], lambda x: x IS NOT NULL) AS x FROM orders)
SELECT array_to_string(x, '; ') AS reasons, count(*) AS n FROM r GROUP BY 1""")
def rule_rejects(spark, sf):
    """Suppression rules made of orders, checked as a table: how many may be written, and why the others may not."""
    o = fx.read(spark, sf, "orders")
    rows = o.select(
        F.when(F.col("o_custkey") % 10 != 0, F.lit("src/**")).otherwise(" ").alias("pattern"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("reason"),
        F.lit("").alias("rule_category"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate") + F.expr("interval 300 days")).alias("expires_at"),
    )
    good, bad = state.checked_rules(rows, pf.now())
    return good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reasons", "; ").alias("reasons"))).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, fx.SQL_TRIAGE) + """, s AS (SELECT app_id, max(scanned_at) AS at FROM snapshots WHERE app_id % 8 <> 0 GROUP BY 1),
x AS (SELECT a.app_id, s.at IS NOT NULL AND a.app_id % 9 <> 0 AS scan, a.app_id IN (SELECT app_id FROM triage WHERE state = 'fixed') AS fix, a.app_id % 3 = 1 AS gate, a.app_id % 5 = 1 AS ack,
  a.app_id % 50 < 7 OR a.app_id % 11 = 0 AS rule, a.app_id % 7 = 1 AS known FROM apps a LEFT JOIN s USING (app_id))
SELECT app_id, 'firstScan' AS item, scan AS done, true AS auto FROM x UNION ALL SELECT app_id, 'firstFix', fix, true FROM x
UNION ALL SELECT app_id, 'ciGate', gate OR ack, gate FROM x UNION ALL SELECT app_id, 'suppression', rule OR known, rule FROM x""")
def onboarding_checklist(spark, sf):
    """The first steps of each app: from its scans, triage, gate, rules and patterns, and from what people ticked off."""
    a = fx.apps(spark, sf)
    last = fx.snapshots(spark, sf).where("app_id % 8 <> 0").groupBy("app_id").agg(F.max("scanned_at").alias("scanned_at"))
    apps = a.join(last, "app_id", "left").select("app_id", F.when(F.col("app_id") % 9 != 0, "Done").otherwise("Scanning").alias("status"), "scanned_at", F.when(F.col("app_id") % 3 == 1, "High").when(F.col("app_id") % 3 == 2, "Critical").alias("fail_on"))
    manual = a.where("app_id % 2 = 1 or app_id % 5 = 1 or app_id % 7 = 1").select("app_id", (F.col("app_id") % 5 == 1).alias("gate_acknowledged"), (F.col("app_id") % 7 == 1).alias("suppression_acknowledged"))
    return state.checklist(apps, manual, fx.triage(spark, sf), a.where("app_id % 50 < 7"), a.where("app_id % 11 = 0"))


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_APPS) + f""", l AS (SELECT app_id, max(scanned_at) AS seen, sum(floor(duration_ms * 10)::bigint) AS ms FROM snapshots GROUP BY 1),
d AS (SELECT app_id, ms, date_diff('second', TIMESTAMP '{fx.NOW}', seen + to_minutes(schedule_minutes)) / 3600.0 AS h FROM l JOIN apps USING (app_id) WHERE schedule_minutes > 0)
SELECT app_id, CASE WHEN h < -1 THEN floor(0.5 - h)::bigint || 'h overdue' WHEN h < 0 THEN 'due now' WHEN h < 1 THEN 'due within the hour' WHEN h < 24 THEN 'due in ' || floor(h + 0.5)::bigint || 'h' ELSE 'due in ' || floor(h / 24 + 0.5)::bigint || 'd' END AS due,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms + 50) // 1000 || '.' || ((ms + 50) // 100) % 10 || 's' ELSE ms // 60000 || 'm ' || (ms % 60000 + 500) // 1000 || 's' END AS took FROM d""")
def due_texts(spark, sf):
    """When each app's next scan is due, and how long its scans took together, in words."""
    last = fx.snapshots(spark, sf).groupBy("app_id").agg(F.max("scanned_at").alias("at"), F.sum(F.floor(F.col("duration_ms") * 10)).alias("ms"))
    own = last.join(fx.apps(spark, sf).where("schedule_minutes > 0").select("app_id", "schedule_minutes"), "app_id")
    due = F.col("at") + F.make_interval(mins=F.col("schedule_minutes"))
    return own.select("app_id", text.due_text(due, pf.now()).alias("due"), text.duration_text(F.col("ms")).alias("took"))
