"""Registered queries of trees and stores on disk: files that tasks write, list, prune and read again, appended logs, pages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomscan.operators import detect, graph, history, metrics
from loomscan.plans import calls, surface
from loomscan.plans import sites as site_plans
from loomscan.plans.portfolio import ctes, query
from loomscan.plans.sources import lines
from loomscan.sources import files as src
from loomscan.sources import fixtures as fx
from loomscan.sources import stores


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a path that tasks open themselves."""
    return stores.scratch(spark, name).removeprefix("file://").removeprefix("file:")


#: Where pages go: some lie deep, some in folders that are never entered, some are binaries or lock files by their names.
FOLDERS = ["node_modules/x", ".git", "src/a/b/c/d", "src", "src", "lib/dist", "docs"]
SQL_PLACED = """placed AS (SELECT page_id, coalesce(html, '') AS h, 'app' || page_id % 20 || '/' || ['node_modules/x', '.git', 'src/a/b/c/d', 'src', 'src', 'lib/dist', 'docs'][(page_id % 7 + 1)::int]
  || CASE WHEN page_id % 13 = 5 THEN '/' || page_id || '/yarn.lock' ELSE '/page_' || page_id || CASE WHEN page_id % 5 = 4 THEN '.png' ELSE '.html' END END AS rel_path FROM pages),
kept AS (SELECT * FROM placed WHERE page_id % 7 NOT IN (0, 1, 5) AND page_id % 13 <> 5 AND page_id % 5 <> 4)"""


def placed(spark, sf) -> str:
    """The pages as files of a tree; its folder."""
    p = fx.read(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    where = F.get(F.array(*map(F.lit, FOLDERS)), (F.col("page_id") % 7).cast("int"))
    name = F.when(F.col("page_id") % 13 == 5, F.concat(n, F.lit("/yarn.lock"))).otherwise(F.concat(F.lit("page_"), n, F.when(F.col("page_id") % 5 == 4, ".png").otherwise(".html")))
    root = folder(spark, "tree")
    src.write_files(p.select(F.concat_ws("/", F.concat(F.lit("app"), (F.col("page_id") % 20).cast("string")), where, name).alias("rel_path"), F.col("html").alias("content")), root)
    return root


@query(ctes(SQL_PLACED) + "SELECT rel_path, strlen(h)::bigint AS size_bytes, md5(h) AS digest FROM kept")
def scanned_tree(spark, sf):
    """A whole tree, listed and read by tasks: ignored folders are not entered, binaries and lock files left out."""
    root = placed(spark, sf)
    return src.contents(src.listing(spark, root), root).select("rel_path", "size_bytes", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(ctes(SQL_PLACED) + "SELECT rel_path FROM kept WHERE len(string_split(rel_path, '/')) <= 3")
def shallow_tree(spark, sf):
    """The same tree down to three levels."""
    return src.listing(spark, placed(spark, sf), depth=3).select("rel_path")


@query(ctes(SQL_PLACED) + "SELECT rel_path, strlen(h) <= 3000 AS read FROM kept")
def bounded_read(spark, sf):
    """Files over a size are listed but not read."""
    root = placed(spark, sf)
    return src.contents(src.listing(spark, root), root, max_bytes=3000).select("rel_path", F.col("content").isNotNull().alias("read"))


@query(f"WITH {site_plans.WIKI.sql(where=site_plans.KEEP)} SELECT 'app' || app_id || '/' || rel_path AS path, content FROM code")
def markdown_pages(spark, sf):
    """Pages of wikis, written by tasks into archives of files and read as Markdown."""
    root = folder(spark, "wiki")
    src.write_archives(site_plans.wiki(spark, sf).select(F.concat(F.lit("app"), F.col("app_id").cast("string"), F.lit("/"), "path").alias("rel_path"), "content"), root)
    return src.markdown(spark, root).select(F.regexp_extract("path", r"/(app\d+/.*)$", 1).alias("path"), "content")


@query(ctes(fx.SQL_SNAPSHOTS) + "SELECT app_id, count(*) AS n, max(scanned_at) AS last, arg_max(scan_id, (scanned_at, scan_id)) AS scan_id FROM snapshots GROUP BY 1")
def snapshot_append(spark, sf):
    """Snapshots appended in three runs to one log by app, and what it holds then."""
    own, path = fx.snapshots(spark, sf), stores.scratch(spark, "snapshots")
    for i in range(3):
        history.append(own.where(F.col("scan_id") % 3 == i), path)
    log = history.read_snapshots(spark, path, "scan_id long, app_id long, scanned_at timestamp_ntz, duration_ms double")
    n = log.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    return history.latest(log).join(n, "app_id").select("app_id", "n", F.col("scanned_at").alias("last"), "scan_id")


@query("SELECT event_type AS action, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def audit_log(spark, sf):
    """An audit log that two runs append to."""
    path, schema = stores.scratch(spark, "audit"), "event_id long, action string"
    rows = fx.read(spark, sf, "events").select("event_id", F.col("event_type").alias("action"))
    stores.append_audit(rows.where("event_id % 2 = 0"), path)
    stores.append_audit(rows.where("event_id % 2 = 1"), path)
    return stores.read_state(spark, path, schema).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query(f"""WITH {surface.PROJECT.sql()}, l AS ({lines()}), {surface.IMPORTS}, {surface.MEANT}
SELECT rel_path AS file, 1 AS line, 'Low' AS severity, 'Possible Dead Code' AS category FROM code
WHERE regexp_matches(rel_path, '^(src|tool)/') AND NOT regexp_matches(rel_path, '/(main[.]py|app[.]js)$') AND rel_path NOT IN (SELECT m.target FROM meant m)""")
def dead_code_findings(spark, sf):
    """Findings of files that no import refers to."""
    f = surface.PROJECT.files(spark, sf)
    dead = graph.unreferenced(surface.imports(f), f.where("rel_path rlike '^(src|tool)/.*'"), graph.entry_like(F.col("rel_path"), ["main.py", "app.js"]))
    return detect.dead_code(dead).select("file", "line", "severity", "category")


@query(f"WITH {calls.APP.sql()}, l AS ({lines()}) SELECT rel_path, 'Store.' || regexp_extract(l, '^  ([a-z]+)[(]', 1) AS name, line FROM l WHERE rel_path LIKE '%audit.js' AND regexp_matches(l, '^  [a-z]+[(]')")
def class_methods(spark, sf):
    """Methods of classes, named with them."""
    return metrics.methods(calls.APP.files(spark, sf))
