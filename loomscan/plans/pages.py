"""Registered queries that make pages and messages, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscan.operators import history, pages
from loomscan.plans import portfolio as pf
from loomscan.plans.corpus import SQL_PATH
from loomscan.plans.portfolio import ctes, query
from loomscan.sources import fixtures as fx

NL = "chr(10)"
IN_LATEST = "scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived)"


@query(ctes(*pf.LIVE) + f"SELECT app_id, fingerprint, '[' || severity || '] ' || category || ' — ' || file || ':' || line AS title, summary || {NL} || {NL} || 'File: `' || file || ':' || line || '`' || {NL} || 'Severity: ' || severity || {NL} || 'Category: ' || category AS body FROM active WHERE severity = 'Critical' AND {IN_LATEST}")
def tracker_payloads(spark, sf):
    return pages.tracker_payloads(pf.latest_active(spark, sf).where("severity = 'Critical'"))


SQL_DIFF = f"""w AS (SELECT * FROM pairs WHERE previous_id IS NOT NULL AND scanned_at >= TIMESTAMP '{fx.NOW}' - INTERVAL 90 DAY),
nw AS (SELECT w.app_id, w.scan_id, w.scanned_at FROM w JOIN issues i ON i.scan_id = w.scan_id WHERE NOT EXISTS (SELECT 1 FROM issues o WHERE o.scan_id = w.previous_id AND o.fingerprint = i.fingerprint)),
rs AS (SELECT w.app_id, w.scan_id, w.scanned_at FROM w JOIN issues i ON i.scan_id = w.previous_id WHERE NOT EXISTS (SELECT 1 FROM issues o WHERE o.scan_id = w.scan_id AND o.fingerprint = i.fingerprint))"""


def changes(spark, sf):
    """(app_id, scanned_at, change, n) of the scans of the last 90 days."""
    pairs = history.consecutive(fx.snapshots(spark, sf)).where(F.col("scanned_at") >= pf.now() - F.expr("interval 90 days"))
    rows = history.diff(pairs, fx.issues(spark, sf).select("scan_id", "fingerprint"), "fingerprint")
    return rows.groupBy("scan_id", "change").agg(F.count(F.lit(1)).alias("n")).join(pairs.select("scan_id", "app_id", "scanned_at"), "scan_id").select("app_id", "scanned_at", "change", "n")


@query(ctes(*pf.LIVE, pf.SQL_PAIRS, SQL_DIFF) + f"""SELECT app_id, 'Digest of ' || name || ': ' || coalesce(n, 0) || ' new, ' || coalesce(r, 0) || ' resolved in 90 days, ' || coalesce(a, 0) || ' active' AS text FROM apps
LEFT JOIN (SELECT app_id, count(*) AS n FROM nw GROUP BY 1) USING (app_id) LEFT JOIN (SELECT app_id, count(*) AS r FROM rs GROUP BY 1) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) AS a FROM active WHERE {IN_LATEST} GROUP BY 1) USING (app_id) WHERE NOT archived""")
def digest_messages(spark, sf):
    sums = changes(spark, sf).groupBy("app_id").agg(*[F.sum(F.when(F.col("change") == c, F.col("n"))).alias(c) for c in ("new", "resolved")])
    active = pf.latest_active(spark, sf).groupBy("app_id").agg(F.count(F.lit(1)).alias("active"))
    return pages.digest_texts(pf.live(spark, sf).select("app_id", "name").join(sums, "app_id", "left").join(active, "app_id", "left"), 90)


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, pf.SQL_PAIRS, SQL_DIFF) + f"""SELECT app_id, 'Change-Log.md' AS path, '# Change Log' || {NL} || {NL} || string_agg('- ' || strftime(scanned_at, '%Y-%m-%d') || ': ' || n || ' new, ' || r || ' resolved', {NL} ORDER BY scanned_at DESC) || {NL} AS content
FROM (SELECT app_id, scanned_at, sum(n)::bigint AS n, sum(r)::bigint AS r FROM (SELECT app_id, scanned_at, 1 AS n, 0 AS r FROM nw UNION ALL SELECT app_id, scanned_at, 0, 1 FROM rs) GROUP BY ALL) GROUP BY app_id""")
def change_logs(spark, sf):
    return pages.change_pages(changes(spark, sf))


@query(ctes(*pf.LIVE, fx.SQL_SEVERITY) + f"""SELECT app_id, 'Home.md' AS path, '# Home' || {NL} || {NL} || '## Findings' || {NL} || {NL} || coalesce(c, '_none found_') || {NL} || {NL} || '## Pages' || {NL} || {NL} || '- [Change-Log](Change-Log.md)' || {NL} || '- [Data-Model](Data-Model.md)' || {NL} AS content
FROM apps LEFT JOIN (SELECT app_id, string_agg('- ' || severity || ': ' || n, {NL} ORDER BY rank) AS c FROM (SELECT app_id, severity, rank, count(*) AS n FROM active JOIN sev USING (severity) WHERE {IN_LATEST} GROUP BY ALL) GROUP BY 1) USING (app_id) WHERE NOT archived""")
def home_pages(spark, sf):
    counts = pf.latest_active(spark, sf).groupBy("app_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    others = pf.live(spark, sf).select("app_id", F.explode(F.array(F.lit("Data-Model.md"), F.lit("Change-Log.md"))).alias("path"))
    return pages.home_pages(counts, others)


@query(f"""WITH r AS (SELECT page_id % 10 AS app_id, page_id, {SQL_PATH} AS path FROM pages), g AS (SELECT *, regexp_extract(path, '^/*([^/:{{<]*)', 1) AS s FROM r), n AS (SELECT *, CASE WHEN s = '' THEN 'Root' ELSE upper(s[1]) || s[2:] END AS grp FROM g)
SELECT app_id, 'Process-Flows/' || trim(regexp_replace(lower(grp), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path, '# Process Flow: ' || grp || {NL} || {NL} || string_agg('## GET `' || path || '`' || {NL} || {NL} || 'Handled in `pages.js` (line ' || page_id || ') by `show`.' || {NL} || {NL} || '1. read' || {NL} || '2. render' || {NL}, {NL} ORDER BY path, page_id) || {NL} AS content FROM n GROUP BY app_id, grp""")
def flow_pages(spark, sf):
    """Pages of the site as routes of ten apps."""
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1))
    routes = fx.read(spark, sf, "pages").select((F.col("page_id") % 10).alias("app_id"), F.lit("GET").alias("method"), path.alias("path"), F.lit("show").alias("handler"), F.lit("pages.js").alias("rel_path"), F.col("page_id").alias("line"), F.array(F.lit("read"), F.lit("render")).alias("steps"))
    return pages.flow_pages(routes)


@query("""WITH d AS (SELECT doc_id % 50 AS app_id, CASE WHEN doc_id % 7 = 0 THEN '../p' ELSE 'p' END || doc_id || '.md' AS path, doc_id FROM documents)
SELECT app_id, path, CASE WHEN doc_id % 3 = 0 THEN 'e' WHEN doc_id % 2 = 0 THEN 'o' WHEN doc_id % 5 = 0 THEN 'k' END AS content, CASE WHEN doc_id % 3 = 0 THEN 'edited' WHEN doc_id % 2 = 0 THEN 'own' WHEN doc_id % 5 = 0 THEN 'package' END AS origin FROM d WHERE doc_id % 7 <> 0""")
def page_lookup(spark, sf):
    """Edited pages before an app's own, those before a package's; a path out of the folder finds nothing."""
    d = fx.read(spark, sf, "documents").select((F.col("doc_id") % 50).alias("app_id"), F.concat(F.when(F.col("doc_id") % 7 == 0, "../p").otherwise("p"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "doc_id")
    side = lambda n, text: d.where(F.col("doc_id") % n == 0).select("app_id", "path", F.lit(text).alias("content"))
    return pages.resolve_pages(d.select("app_id", "path"), side(3, "e"), side(2, "o"), side(5, "k"))
