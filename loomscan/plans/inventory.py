"""Registered queries over apps, dependencies, pages and schedules, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscan.functions import text
from loomscan.operators import history, render, state
from loomscan.plans import portfolio as pf
from loomscan.plans.corpus import SQL_LINKS, links
from loomscan.plans.portfolio import ctes, query
from loomscan.sources import files as src
from loomscan.sources import fixtures as fx
from loomscan.sources import manifests
from loomscan.streaming import events as ev

SQL_NOW = f"TIMESTAMP '{fx.NOW}'"
#: Weakness classes of the stand-in categories.
CWES = [("ECONOMY", "CWE-79"), ("PROMO", "CWE-89"), ("STANDARD", "CWE-798")]
ADVISED = [("ECONOMY", "2.5"), ("PROMO", "1.10.0")]
INHERITED = [(10, "vendor/**"), (10, "**/*.min.js"), (30, "dist/**")]


@query(ctes(fx.SQL_APPS) + "SELECT app_id, name, owner FROM apps WHERE environment = 'BUILDING' AND contains(lower(name || ' ' || array_to_string(tags, ' ')), 'tier1')")
def app_filter(spark, sf):
    """Apps of one environment whose name or tags hold a term."""
    words = F.lower(F.concat_ws(" ", "name", "tags"))
    return fx.apps(spark, sf).where((F.col("environment") == "BUILDING") & F.contains(words, F.lit("tier1"))).select("app_id", "name", "owner")


@query(ctes(*pf.ACTIVE) + "SELECT scan_id, file, line, category, severity FROM active WHERE severity IN ('Critical', 'High') AND contains(lower(category || ' ' || file || ' ' || summary), 'ring')")
def issue_filter(spark, sf):
    """Open or acknowledged findings that no rule suppresses, at a severity or worse, that hold a term."""
    words = F.lower(F.concat_ws(" ", "category", "file", "summary"))
    kept = fx.issues(spark, sf).where(state.at_least(F.col("severity"), "High") & F.contains(words, F.lit("ring")))
    rows = state.active(kept, fx.triage(spark, sf, kept), fx.rules(spark), pf.now())
    return rows.select("scan_id", "file", "line", "category", "severity")


@query(ctes(fx.SQL_ISSUES) + ", c AS (SELECT * FROM (VALUES " + ", ".join(map(str, CWES)) + ") AS t(category, cwe)) SELECT coalesce(cwe, 'none') AS cwe, severity, count(*) AS n FROM issues LEFT JOIN c USING (category) GROUP BY ALL")
def issues_by_cwe(spark, sf):
    cwes = spark.createDataFrame(CWES, "category string, cwe string")  # a fixed list
    return fx.issues(spark, sf).join(F.broadcast(cwes), "category", "left").groupBy(F.coalesce("cwe", F.lit("none")).alias("cwe"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_type AS name, fixed FROM part JOIN (VALUES ('ECONOMY', '2.5', 2, 5), ('PROMO', '1.10.0', 1, 10)) AS a(name, fixed, major, minor) ON p_type = a.name WHERE p_size // 10 < major OR (p_size // 10 = major AND p_size % 10 < minor)")
def vulnerable_parts(spark, sf):
    """Dependencies under an advisory's first good version."""
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), F.lit("0"))
    deps = fx.read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name"), version.alias("version"))
    return manifests.vulnerable(deps, F.broadcast(spark.createDataFrame(ADVISED, "name string, fixed string"))).select("p_partkey", "name", "fixed")


@query(ctes(fx.SQL_APPS) + "SELECT app_id, owner, owner = '' OR lower(owner) IN (SELECT lower(n_name) FROM nation WHERE n_regionkey <= 2) AS valid FROM apps")
def owner_validity(spark, sf):
    """Owners are known by name in any case; no owner is fine."""
    known = fx.read(spark, sf, "nation").where("n_regionkey <= 2").select(F.lower("n_name").alias("known")).distinct()
    return fx.apps(spark, sf).join(known, F.lower("owner") == F.col("known"), "left").select("app_id", "owner", ((F.col("owner") == "") | F.col("known").isNotNull()).alias("valid"))


LINK, LABEL = r'<a [^>]*href="([^"]*)"', r"<a [^>]*>([^<]*)</a>"


@query(f"SELECT page_id, generate_subscripts(z, 1)::int - 1 AS pos, unnest(list_transform(z, lambda x: x[1])) AS target, unnest(list_transform(z, lambda x: x[2])) AS label FROM (SELECT page_id, list_zip(regexp_extract_all(html, '{LINK}', 1), regexp_extract_all(html, '{LABEL}', 1)) AS z FROM pages)")
def link_labels(spark, sf):
    """Targets and labels of a page's links, put together by position."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), 1).alias("target"), F.regexp_extract_all("html", F.lit(LABEL), 1).alias("label"))
    return fx.read(spark, sf, "pages").select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.target", "x.label")


@query(ctes(fx.SQL_APPS) + "SELECT app_id, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM (SELECT app_id, base, row_number() OVER (PARTITION BY base ORDER BY app_id) AS rn FROM (SELECT app_id, trim(regexp_replace(lower(name[:-2]), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM apps))")
def app_slugs(spark, sf):
    """Folder names of apps; those that collide (here: names cut by a character) are numbered."""
    base = text.slug(F.regexp_replace("name", ".$", ""))
    rows = fx.apps(spark, sf).select("app_id", base.alias("base"))
    rn = F.row_number().over(Window.partitionBy("base").orderBy("app_id"))
    return rows.withColumn("rn", rn).select("app_id", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("rn").cast("string"))).alias("slug"))


@query(r"SELECT page_id, generate_subscripts(p, 1)::int AS step, unnest(p) AS segment FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)")
def path_steps(spark, sf):
    parts = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1), "/"), lambda x: x != "")
    return fx.read(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("pos", "segment")).select("page_id", (F.col("pos") + 1).alias("step"), "segment")


@query(ctes(fx.SQL_FILES) + ", l AS (SELECT rel_path, string_split(content, chr(10)) AS l FROM files WHERE contains(lower(content), 'license')), p AS (SELECT *, list_position(list_transform(l, lambda t: contains(lower(t), 'license')), true) AS i FROM l) SELECT rel_path, i::int AS line, array_to_string(l[greatest(i - 5, 1) : i], chr(10)) AS context FROM p")
def match_context(spark, sf):
    """A file's first matching line, with up to five lines above it."""
    hit = fx.files(spark, sf).where(F.contains(F.lower("content"), F.lit("license"))).select("rel_path", F.split("content", "\n").alias("l"))
    at = F.array_position(F.transform("l", lambda t: F.contains(F.lower(t), F.lit("license"))), True).cast("int")
    first = F.greatest(F.col("line") - 5, F.lit(1))
    return hit.withColumn("line", at).select("rel_path", "line", F.array_join(F.slice("l", first, F.col("line") - first + 1), "\n").alias("context"))


@query("SELECT p_brand, p_partkey, rn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::int AS rn FROM part) WHERE rn <= 3")
def first_ids(spark, sf):
    """The first three ids of each group; tasks keep three a group before the shuffle."""
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    return fx.read(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(order).alias("rn")).where("rn <= 3")


@query(ctes(fx.SQL_FILES) + "SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS files, sum(size_bytes)::bigint AS bytes, floor(sum(size_bytes) / 1024 + 0.5)::bigint AS kib, least(90, 15 + floor(0.6 * count(*) + 0.5))::bigint AS seconds FROM files GROUP BY 1")
def code_size(spark, sf):
    """Files, size and estimated seconds of a deep scan by folder; halves round up."""
    n, size = F.count(F.lit(1)), F.sum("size_bytes")
    rows = fx.files(spark, sf).groupBy(F.element_at(F.split("rel_path", "/"), 1).alias("folder"))
    return rows.agg(n.alias("files"), size.alias("bytes"), F.floor(size / 1024 + 0.5).alias("kib"), F.least(F.lit(90), 15 + F.floor(0.6 * n + 0.5)).cast("long").alias("seconds"))


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Live apps with their last scan, its times as instants, and what the schedules ask of them."""
    own = pf.live(spark, sf).join(history.latest(fx.snapshots(spark, sf)), "app_id", "left")
    status = F.when(F.col("duration_ms") > 40000, "Scanning").otherwise("Done")
    at = F.col("scanned_at").cast("timestamp")
    hook = F.when(F.col("app_id") % 3 == 0, "").otherwise("hook")
    return own.select("app_id", "schedule_minutes", status.alias("status"), at.alias("scanned_at"), (F.col("app_id") % 2 == 0).alias("digest_enabled"), hook.alias("webhook"), at.alias("digest_sent_at"))


SQL_SCANNED = "scanned AS (SELECT app_id, schedule_minutes, scanned_at, CASE WHEN duration_ms > 40000 THEN 'Scanning' ELSE 'Done' END AS status FROM apps LEFT JOIN latest USING (app_id) WHERE NOT archived)"
DUE = ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST, SQL_SCANNED)


@query(DUE + f"SELECT app_id, schedule_minutes FROM scanned WHERE schedule_minutes > 0 AND status <> 'Scanning' AND (scanned_at IS NULL OR epoch({SQL_NOW}) - epoch(scanned_at) >= schedule_minutes * 60)")
def schedule_due(spark, sf):
    return ev.due(scanned(spark, sf), pf.now().cast("timestamp")).select("app_id", "schedule_minutes")


@query(DUE + f"SELECT app_id FROM scanned WHERE app_id % 2 = 0 AND app_id % 3 <> 0 AND (scanned_at IS NULL OR epoch({SQL_NOW}) - epoch(scanned_at) >= 7 * 86400)")
def digest_due(spark, sf):
    return ev.digest_due(scanned(spark, sf), pf.now().cast("timestamp")).select("app_id")


@query(ctes(SQL_LINKS) + "SELECT DISTINCT url, target FROM links WHERE contains(lower(url), 'th') OR contains(lower(target), 'th')")
def link_search(spark, sf):
    """Links that touch a node whose name holds a term."""
    has = lambda c: F.contains(F.lower(c), F.lit("th"))
    return links(spark, sf).where(has("url") | has("target")).select("url", "target").distinct()


@query(ctes(*pf.LIVE) + ", i AS (SELECT app_id, count(*) AS total FROM issues WHERE scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived) GROUP BY 1), a AS (SELECT app_id, count(*) AS active FROM active WHERE scan_id IN (SELECT scan_id FROM latest) GROUP BY 1) SELECT app_id, total, coalesce(active, 0) AS active, total - coalesce(active, 0) AS dismissed FROM i LEFT JOIN a USING (app_id)")
def dismissed_counts(spark, sf):
    """Findings of each app's last scan: all, active, and dismissed by triage or rule."""
    scans = history.latest(fx.snapshots(spark, sf)).join(pf.live(spark, sf).select("app_id"), "app_id", "left_semi").select("scan_id")
    total = fx.issues(spark, sf).join(scans, "scan_id", "left_semi").groupBy("app_id").agg(F.count(F.lit(1)).alias("total"))
    active = pf.latest_active(spark, sf).groupBy("app_id").agg(F.count(F.lit(1)).alias("active"))
    n = F.coalesce("active", F.lit(0).cast("long"))
    return total.join(active, "app_id", "left").select("app_id", "total", n.alias("active"), (F.col("total") - n).alias("dismissed"))


@query(ctes(fx.SQL_ISSUES) + "SELECT app_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM issues GROUP BY 1")
def app_categories(spark, sf):
    return fx.issues(spark, sf).groupBy("app_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query(ctes(fx.SQL_APPS) + ", c AS (SELECT environment, count(*) AS n FROM apps WHERE environment <> '' GROUP BY 1) SELECT environment, n, round(n / greatest(1, (SELECT max(n) FROM c)), 4) AS height FROM c")
def environment_bars(spark, sf):
    """Counts over the largest of them, for a chart."""
    counts = fx.apps(spark, sf).where("environment <> ''").groupBy("environment").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).scalar()
    return counts.select("environment", "n", F.round(F.col("n") / F.greatest(F.lit(1), most), 4).alias("height"))


@query(ctes(fx.SQL_ISSUES) + "SELECT file, summary AS usual FROM (SELECT file, summary, row_number() OVER (PARTITION BY file ORDER BY n DESC, summary) AS rn FROM (SELECT file, summary, count(*) AS n FROM issues GROUP BY ALL)) WHERE rn = 1")
def usual_summary(spark, sf):
    """The most frequent value of a file; of equal ones the first (as committers decide on owners)."""
    return fx.issues(spark, sf).groupBy("file").agg(F.mode("summary", deterministic=True).alias("usual"))


@query(ctes(*pf.LIVE, fx.SQL_SEVERITY) + ", r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY rank, file, line, summary) AS rn, count(*) OVER (PARTITION BY app_id) AS n FROM active JOIN sev USING (severity) WHERE rank <= 1 AND scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived)) SELECT app_id, string_agg(file || ':' || line || ' ' || summary, chr(10) ORDER BY rn) || CASE WHEN any_value(n) > 3 THEN chr(10) || '+ ' || (any_value(n) - 3) || ' more' ELSE '' END AS text FROM r WHERE rn <= 3 GROUP BY 1")
def webhook_lines(spark, sf):
    """Messages of the first three findings of each app at High or worse."""
    return render.webhook_text(pf.latest_active(spark, sf), "High", 3)


@query("SELECT CASE WHEN k % 5 = 0 THEN 'repo' || k WHEN k % 7 = 0 THEN 'x' ELSE c_name END AS name, CASE WHEN k % 5 = 0 THEN '/srv/repo' || k || '.git' WHEN k % 7 = 0 THEN '/srv/x/' ELSE '/srv/' || k END AS path, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN c_mktsegment END AS environment, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 'me' END AS owner, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 'a|b' ELSE '' END AS tags FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 3 <> 0")
def bulk_import(spark, sf):
    """Import lines: full ones, bare paths, names left out, comments."""
    k = F.col("c_custkey")
    own = F.concat_ws(",", F.col("c_name"), F.concat(F.lit("/srv/"), k.cast("string")), F.col("c_mktsegment"), F.lit("me"), F.lit("a, b"))
    line = F.when(k % 3 == 0, F.lit("# left out")).when(k % 5 == 0, F.concat(F.lit("/srv/repo"), k.cast("string"), F.lit(".git"))).when(k % 7 == 0, F.lit(" ,/srv/x/")).otherwise(own)
    rows, _ = src.bulk_rows(fx.read(spark, sf, "customer").select(line.alias("value")))
    return rows.select("name", "path", "environment", "owner", F.array_join("tags", "|").alias("tags"))


@query(ctes(fx.SQL_FILES) + "SELECT DISTINCT split_part(rel_path, '/', 1) AS path, 1 AS level FROM files UNION ALL SELECT DISTINCT split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2), 2 FROM files")
def folder_tree(spark, sf):
    return src.tree(fx.files(spark, sf))


@query(ctes(fx.SQL_APPS) + ", r AS (SELECT * FROM (VALUES " + ", ".join(map(str, INHERITED)) + ") AS t(root_id, pattern)) SELECT app_id, pattern FROM apps JOIN r ON app_id - app_id % 10 = root_id")
def inherited_patterns(spark, sf):
    """Ignore patterns that packages take over from their root."""
    patterns = spark.createDataFrame(INHERITED, "root_id long, pattern string")  # a fixed list
    return fx.apps(spark, sf).withColumn("root_id", F.col("app_id") - F.col("app_id") % 10).join(F.broadcast(patterns), "root_id").select("app_id", "pattern")


@query(ctes(fx.SQL_ISSUES) + "SELECT severity, category, grouping(severity, category)::bigint AS level, count(*) AS n FROM issues GROUP BY ROLLUP (severity, category)")
def severity_rollup(spark, sf):
    return fx.issues(spark, sf).rollup("severity", "category").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k::int) AS start, event_type, count(*) AS n FROM events, range(4) AS r(k) GROUP BY ALL")
def sliding_counts(spark, sf):
    """Events of each day that begins every six hours."""
    rows = fx.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sliding(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, count(k) AS parsed, sum(k)::bigint AS total FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events) GROUP BY 1")
def event_props(spark, sf):
    """Payloads read with a fixed schema; what cannot be read is null."""
    k = F.from_json("props", "k long")["k"]
    return fx.read(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("total"))
