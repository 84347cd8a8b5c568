"""Registered queries of the portfolio that need a queue, sources, two apps, order of names, or whole sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscan.operators import detect, history, state
from loomscan.operators.ranks import ranked
from loomscan.plans import portfolio as pf
from loomscan.plans.portfolio import ctes, query
from loomscan.sources import fixtures as fx
from loomscan.sources import manifests

IN_LATEST = "scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived)"


@query(ctes(*pf.LIVE) + f"""SELECT app_id, file, line, number, rn FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY number DESC, file, line, category, scan_id)::int AS rn
FROM (SELECT *, regexp_extract(summary, '([0-9]+)', 1)::int AS number FROM active WHERE {IN_LATEST})) WHERE rn <= 5""")
def worst_by_number(spark, sf):
    """The five findings of each app whose texts name the largest number."""
    rows = pf.latest_active(spark, sf).withColumn("number", F.regexp_extract("summary", "([0-9]+)", 1).cast("int"))
    order = Window.partitionBy("app_id").orderBy(F.desc("number"), "file", "line", "category", "scan_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("app_id", "file", "line", "number", "rn")


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + """, d AS (SELECT app_id, environment, duration_ms * (1 + app_id % 5) AS ms FROM apps JOIN latest USING (app_id) WHERE NOT archived)
SELECT environment, app_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY ms DESC, app_id)::int AS rn FROM d WHERE ms > greatest(5000, 2 * (SELECT avg(ms) FROM d)))""")
def slow_apps_ranked(spark, sf):
    """Apps over twice the mean duration, slowest first in their environment."""
    last = pf.live(spark, sf).join(history.latest(fx.snapshots(spark, sf)), "app_id").select("app_id", "environment", (F.col("duration_ms") * (1 + F.col("app_id") % 5)).alias("ms"))
    mean = last.agg(F.avg("ms").alias("mean"))  # one row
    slow = last.join(F.broadcast(mean), F.col("ms") > F.greatest(F.lit(5000.0), 2 * F.col("mean")))
    return slow.select("environment", "app_id", F.row_number().over(Window.partitionBy("environment").orderBy(F.desc("ms"), "app_id")).alias("rn"))


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + f"""SELECT environment, app_id, overdue, row_number() OVER (PARTITION BY environment ORDER BY next_due NULLS FIRST, app_id)::int AS rn FROM
(SELECT *, scanned_at + to_minutes(schedule_minutes) AS next_due, app_id % 11 <> 0 AND coalesce(scanned_at + to_minutes(schedule_minutes) <= TIMESTAMP '{fx.NOW}', true) AS overdue
 FROM apps LEFT JOIN latest USING (app_id) WHERE NOT archived AND schedule_minutes > 0)""")
def scan_calendar_ranked(spark, sf):
    """The calendar by next due time; an app whose scan runs (every eleventh here) is not overdue."""
    own = pf.live(spark, sf).where("schedule_minutes > 0").join(history.latest(fx.snapshots(spark, sf)), "app_id", "left")
    due = own.withColumn("next_due", F.col("scanned_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("schedule_minutes")))
    overdue = (F.col("app_id") % 11 != 0) & F.coalesce(F.col("next_due") <= pf.now(), F.lit(True))
    calendar = due.select("environment", "app_id", overdue.alias("overdue"), "next_due")
    return ranked(calendar, "environment", [F.asc_nulls_first("next_due"), F.asc("app_id")]).drop("next_due")


@query(ctes(fx.SQL_APPS) + """SELECT owner, tag, n, row_number() OVER (PARTITION BY owner ORDER BY n DESC, lower(tag), tag)::int AS rn
FROM (SELECT owner, tag, count(*) AS n FROM (SELECT owner, CASE WHEN app_id % 2 = 0 THEN upper(t) ELSE t END AS tag FROM (SELECT owner, app_id, unnest(tags) AS t FROM apps WHERE NOT archived)) GROUP BY ALL)""")
def tags_in_locale_order(spark, sf):
    """Tags of each owner, most used first, then by name in the order of the locale."""
    tags = pf.live(spark, sf).select("owner", "app_id", F.explode("tags").alias("t")).select("owner", F.when(F.col("app_id") % 2 == 0, F.upper("t")).otherwise(F.col("t")).alias("tag"))
    n = tags.groupBy("owner", "tag").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("owner").orderBy(F.desc("n"), F.collate("tag", "UNICODE_CI"), "tag")
    return n.select("owner", "tag", "n", F.row_number().over(order).alias("rn"))


@query(ctes(fx.SQL_APPS) + ", a AS (SELECT app_id, CASE WHEN app_id % 2 = 0 THEN upper(owner) ELSE owner END || '-' || app_id % 40 AS name, environment FROM apps) SELECT app_id, name, environment FROM a WHERE (SELECT count(*) FROM a b WHERE lower(b.name) = lower(a.name)) > 1")
def siblings_by_name(spark, sf):
    """Apps of one name, whatever its case, counted without pairing them."""
    name = F.concat_ws("-", F.when(F.col("app_id") % 2 == 0, F.upper("owner")).otherwise(F.col("owner")), (F.col("app_id") % 40).cast("string"))
    own = fx.apps(spark, sf).select("app_id", name.alias("name"), "environment").withColumn("key", F.lower("name"))
    many = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(many, "key", "left_semi").select("app_id", "name", "environment")


SOURCE = "CASE WHEN line % 3 = 0 THEN 'dependency-audit' END"


def sourced(rows: DataFrame) -> DataFrame:
    """Findings with a source; those that scanners of code made have none of their own."""
    return rows.withColumn("source", F.when(F.col("line") % 3 == 0, "dependency-audit"))


@query(ctes(fx.SQL_ISSUES) + f"SELECT category, file, count(*) AS n, count(DISTINCT coalesce({SOURCE}, 'static')) = 1 AS same_source FROM issues GROUP BY 1, 2")
def same_source_groups(spark, sf):
    by = sourced(fx.issues(spark, sf)).groupBy("category", "file")
    source = F.coalesce("source", F.lit("static"))
    return by.agg(F.count(F.lit(1)).alias("n"), (F.min(source) == F.max(source)).alias("same_source"))


@query(ctes(*pf.ACTIVE) + f"SELECT scan_id, file, line FROM active WHERE app_id IN (1, 2, 4, 5, 7, 8) AND coalesce({SOURCE}, 'static') = 'static' AND contains(lower(category || ' ' || file || ' ' || summary), 'brand#1')")
def issue_filter_by_app(spark, sf):
    """Active findings of some apps, of the default source, that hold a term."""
    words = F.lower(F.concat_ws(" ", "category", "file", "summary"))
    scans = fx.snapshots(spark, sf).where("app_id in (1, 2, 4, 5, 7, 8)").select("scan_id")
    rows = sourced(pf.active_of(spark, sf, scans))
    return rows.where((F.coalesce("source", F.lit("static")) == "static") & F.contains(words, F.lit("brand#1"))).select("scan_id", "file", "line")


@query(ctes(fx.SQL_ISSUES) + f"SELECT coalesce({SOURCE}, 'static') AS source, severity, count(*) AS n FROM issues GROUP BY ALL")
def issues_by_source(spark, sf):
    return sourced(fx.issues(spark, sf)).groupBy(F.coalesce("source", F.lit("static")).alias("source"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_ISSUES) + ", s AS (SELECT app_id, scan_id, count(*) AS issues, count(DISTINCT file) AS files, count(DISTINCT category) AS categories FROM issues GROUP BY ALL) SELECT * FROM s")
def scan_stats(spark, sf):
    """Counts of what a scan found."""
    return fx.issues(spark, sf).groupBy("app_id", "scan_id").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("file").alias("files"), F.countDistinct("category").alias("categories"))


@query("SELECT o_orderpriority AS lane, o_orderkey AS scan_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::int AS position FROM orders WHERE o_orderstatus = 'O'")
def queue_positions(spark, sf):
    """Place of each waiting scan in its lane."""
    waiting = fx.read(spark, sf, "orders").where("o_orderstatus = 'O'")
    lanes = waiting.select(F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("scan_id"), "o_orderdate")
    return ranked(lanes, "lane", [F.asc("o_orderdate"), F.asc("scan_id")], "position").drop("o_orderdate")


@query(ctes(fx.SQL_APPS) + """, a AS (FROM apps WHERE app_id = 1), b AS (FROM apps WHERE app_id = 7)
SELECT f.field, f.l AS left_value, f.r AS right_value, f.l IS DISTINCT FROM f.r AS differs FROM (SELECT unnest([{'field': 'name', 'l': a.name, 'r': b.name}, {'field': 'environment', 'l': a.environment, 'r': b.environment},
 {'field': 'owner', 'l': a.owner, 'r': b.owner}, {'field': 'shared tags', 'l': array_to_string(list_sort(list_intersect(a.tags, b.tags)), ','), 'r': array_to_string(list_sort(list_intersect(a.tags, b.tags)), ',')}]) AS f FROM a, b)""")
def compare_fields(spark, sf):
    """Two apps field by field, and the tags that both have."""
    a, b = (fx.apps(spark, sf).where(f"app_id = {i}").select(F.lit(1).alias("k"), *[F.col(c).alias(f"{side}_{c}") for c in ("name", "environment", "owner", "tags")]) for side, i in (("l", 1), ("r", 7)))
    shared = F.array_join(F.array_sort(F.array_intersect("l_tags", "r_tags")), ",")
    field = lambda name, left, right: F.struct(F.lit(name).alias("field"), left.alias("left_value"), right.alias("right_value"), (~left.eqNullSafe(right)).alias("differs"))
    all_ = F.array(*[field(c, F.col(f"l_{c}"), F.col(f"r_{c}")) for c in ("name", "environment", "owner")], field("shared tags", shared, shared))
    return a.join(b, "k").select(F.explode(all_).alias("f")).select("f.*")  # one row each


@query(ctes(fx.SQL_APPS) + """, r AS (SELECT app_id, tags, list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'tier0' THEN 'base' ELSE t END)) AS renamed, list_filter(tags, lambda t: t <> 'building') AS deleted FROM apps)
SELECT 'rename' AS change, count(*) AS changed, sum(len(renamed))::bigint AS left_over FROM r WHERE list_contains(tags, 'tier0') UNION ALL SELECT 'delete', count(*), sum(len(deleted))::bigint FROM r WHERE list_contains(tags, 'building')""")
def tag_changes(spark, sf):
    """Apps that a rename and a deletion of a tag change, and the tags that these have afterwards."""
    renamed = F.array_distinct(F.transform("tags", lambda t: F.when(t == "tier0", "base").otherwise(t)))
    deleted = F.array_remove("tags", "building")
    apps = fx.apps(spark, sf)
    of = lambda change, tag, to: apps.where(F.array_contains("tags", tag)).agg(F.count(F.lit(1)).alias("changed"), F.sum(F.size(to)).alias("left_over")).select(F.lit(change).alias("change"), "changed", "left_over")
    return of("rename", "tier0", renamed).union(of("delete", "building", deleted))


def surface_diff(kind: str, column: str, sql: str):
    @query(ctes(fx.SQL_SNAPSHOTS, pf.SQL_PAIRS) + f""", rows AS (SELECT DISTINCT l_orderkey AS scan_id, {sql} AS item FROM lineitem)
SELECT p.scan_id, 'new' AS change, r.item FROM pairs p JOIN rows r ON r.scan_id = p.scan_id WHERE previous_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rows o WHERE o.scan_id = p.previous_id AND o.item = r.item)
UNION ALL SELECT p.scan_id, 'resolved', r.item FROM pairs p JOIN rows r ON r.scan_id = p.previous_id WHERE NOT EXISTS (SELECT 1 FROM rows o WHERE o.scan_id = p.scan_id AND o.item = r.item)""")
    def run(spark, sf):
        rows = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.expr(column).alias("item")).distinct()
        return history.diff(history.consecutive(fx.snapshots(spark, sf)), rows, "item").select("scan_id", "change", "item")

    pf.QUERIES[f"{kind}_diff"], pf.SQL[f"{kind}_diff"] = pf.QUERIES.pop("run"), pf.SQL.pop("run")
    run.__name__ = f"{kind}_diff"


surface_diff("route", "concat('GET /', l_suppkey % 5)", "'GET /' || l_suppkey % 5")
surface_diff("model", "concat('Model', l_partkey % 7)", "'Model' || l_partkey % 7")


@query(ctes(fx.SQL_ISSUES) + ", f AS (SELECT DISTINCT fingerprint, category, 'see ' || category AS fix FROM issues), p AS (SELECT fingerprint, 'try ' || category AS proposal FROM f WHERE md5(fingerprint) < '4') SELECT fingerprint, coalesce(proposal, fix) AS suggested_fix FROM f LEFT JOIN p USING (fingerprint)")
def fix_proposals(spark, sf):
    """Findings with a proposed fix where there is one."""
    f = fx.issues(spark, sf).select("fingerprint", "category", F.concat(F.lit("see "), F.col("category")).alias("suggested_fix")).distinct()
    made = f.where(F.md5("fingerprint") < "4").select("fingerprint", F.concat(F.lit("try "), F.col("category")).alias("proposal"))
    return detect.with_proposals(f, made).select("fingerprint", "suggested_fix")


@query("""WITH d AS (SELECT p_partkey, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS pos, p_size % 6 AS hits FROM part), h AS (SELECT name, pos, least(hits, 3) AS ids FROM d WHERE pos <= 500 AND hits > 0),
r AS (SELECT name, ids, row_number() OVER (ORDER BY pos) AS rn FROM h)
SELECT name, ids::int AS ids FROM r WHERE rn <= 30 UNION ALL SELECT (count(*) - 30) || ' more', 0 FROM r HAVING count(*) > 30""")
def advisory_batch(spark, sf):
    """Answers of an advisory service, by position: the first 500 packages are asked for, 30 hits of 3 ids each are shown."""
    parts = fx.read(spark, sf, "part").orderBy("p_partkey").limit(manifests.BATCH)
    ids = F.transform(F.filter(F.sequence(F.lit(0), (F.col("p_size") % 6).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("ADV-"), i.cast("string")))
    answers = parts.agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("name"), ids.alias("ids")))).alias("x"))
    asked = answers.select(F.transform("x", lambda v: v["name"]).alias("names"), F.transform("x", lambda v: v["ids"]).alias("results"))
    return manifests.advisory_hits(asked).select("name", F.size("ids").alias("ids"))


@query("""WITH log AS (SELECT user_id % 50 AS app_id, event_type AS fingerprint, ['open', 'acknowledged', 'false_positive', 'fixed'][(event_id % 4 + 1)::int] AS state,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id % 3 END AS assignee, ts AS updated_at FROM events)
SELECT app_id, fingerprint, state, assignee FROM (SELECT *, row_number() OVER (PARTITION BY app_id, fingerprint ORDER BY updated_at DESC, state DESC) AS rn FROM log) WHERE rn = 1 AND NOT (state = 'open' AND assignee = '')""")
def triage_upsert(spark, sf):
    """The triage table after a log of decisions."""
    e = fx.read(spark, sf, "events")
    states = F.array(*map(F.lit, ("open", "acknowledged", "false_positive", "fixed")))
    assignee = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    log = e.select(
        (F.col("user_id") % 50).alias("app_id"), F.col("event_type").alias("fingerprint"), F.get(states, (F.col("event_id") % 4).cast("int")).alias("state"),
        assignee.alias("assignee"), F.col("ts").alias("updated_at"),
    )
    return state.upsert(log).select("app_id", "fingerprint", "state", "assignee")


@query(ctes(fx.SQL_APPS) + "SELECT environment, count(*) AS apps, count(*) FILTER (WHERE NOT archived) AS exported FROM apps GROUP BY 1")
def export_counts(spark, sf):
    return fx.apps(spark, sf).groupBy("environment").agg(F.count(F.lit(1)).alias("apps"), F.count_if(~F.col("archived")).alias("exported"))


