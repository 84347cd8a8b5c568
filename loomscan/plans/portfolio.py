"""Registered portfolio queries: DataFrame plans over the derived tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscan.functions.text import basename
from loomscan.operators import history, state
from loomscan.schemas import SEVERITIES
from loomscan.sources import fixtures as fx

SQL: dict[str, str] = {}
QUERIES: dict = {}


def now() -> Column:
    return F.lit(fx.NOW).cast("timestamp_ntz")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, fx.SQL_TRIAGE, fx.SQL_RULES)
ACTIVE = (*BASE, fx.SQL_ACTIVE)
LIVE = (*ACTIVE, fx.SQL_APPS, fx.SQL_LATEST)


def live(spark: SparkSession, sf: str) -> DataFrame:
    return fx.apps(spark, sf).where("not archived")


def active_of(spark: SparkSession, sf: str, scans: DataFrame) -> DataFrame:
    """Active findings of some scans (scan_id); triage is asked for these findings only."""
    kept = fx.issues(spark, sf, scans)
    return state.active(kept, fx.triage(spark, sf, kept), fx.rules(spark), now())


def latest_active(spark: SparkSession, sf: str) -> DataFrame:
    """Active findings of the last scan of each app that is not archived."""
    scans = history.latest(fx.snapshots(spark, sf)).join(live(spark, sf).select("app_id"), "app_id", "left_semi").select("scan_id")
    return active_of(spark, sf, scans)


def severities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")


@query(ctes(*LIVE, fx.SQL_SEVERITY) + """SELECT sev.severity, count(a.scan_id) AS n FROM sev LEFT JOIN (SELECT * FROM active WHERE scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived)) a USING (severity) GROUP BY 1""")
def active_by_severity(spark, sf):
    counts = latest_active(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return severities(spark).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + "SELECT app_id, scan_id, scanned_at, duration_ms FROM latest")
def latest_snapshot(spark, sf):
    return history.latest(fx.snapshots(spark, sf)).select("app_id", "scan_id", "scanned_at", "duration_ms")


@query(ctes(*BASE) + "SELECT coalesce(state, 'open') AS state, severity, count(*) AS n FROM issues LEFT JOIN triage USING (app_id, fingerprint) GROUP BY ALL")
def issues_with_triage(spark, sf):
    return state.with_triage(fx.issues(spark, sf), fx.triage(spark, sf)).groupBy("state", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_ISSUES, fx.SQL_RULES) + f"SELECT scan_id, file, line, category FROM issues i WHERE EXISTS (SELECT 1 FROM rules r WHERE (r.rule_category = 'any' OR r.rule_category = i.category) AND (r.expires_at IS NULL OR r.expires_at >= TIMESTAMP '{fx.NOW}') AND regexp_full_match(i.file, r.regex))")
def suppressed_issues(spark, sf):
    return state.suppressed(fx.issues(spark, sf), fx.rules(spark), now()).select("scan_id", "file", "line", "category")


SQL_PAIRS = "pairs AS (SELECT scan_id, app_id, scanned_at, lag(scan_id) OVER (PARTITION BY app_id ORDER BY scanned_at, scan_id) AS previous_id FROM snapshots)"


def changes(spark: SparkSession, sf: str, key: str) -> DataFrame:
    pairs = history.consecutive(fx.snapshots(spark, sf))
    return history.diff(pairs, fx.issues(spark, sf).select("scan_id", "category", "fingerprint", "severity"), key)


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, SQL_PAIRS) + "SELECT p.scan_id, i.category, i.fingerprint, i.severity FROM pairs p JOIN issues i ON i.scan_id = p.scan_id WHERE previous_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM issues o WHERE o.scan_id = p.previous_id AND o.fingerprint = i.fingerprint)")
def new_issues(spark, sf):
    return changes(spark, sf, "fingerprint").where("change = 'new'").select("scan_id", "category", "fingerprint", "severity")


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, SQL_PAIRS) + "SELECT p.scan_id, i.category, i.fingerprint, i.severity FROM pairs p JOIN issues i ON i.scan_id = p.previous_id WHERE NOT EXISTS (SELECT 1 FROM issues o WHERE o.scan_id = p.scan_id AND o.category = i.category)")
def resolved_issues(spark, sf):
    """By category, on which scans of an app do repeat."""
    return changes(spark, sf, "category").where("change = 'resolved'").select("scan_id", "category", "fingerprint", "severity")


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, SQL_PAIRS) + f"SELECT p.app_id, count(*) AS resolved FROM pairs p JOIN issues i ON i.scan_id = p.previous_id WHERE p.scanned_at >= TIMESTAMP '{fx.NOW}' - INTERVAL 90 DAY AND NOT EXISTS (SELECT 1 FROM issues o WHERE o.scan_id = p.scan_id AND o.fingerprint = i.fingerprint) GROUP BY 1")
def resolved_in_window(spark, sf):
    """Findings gone between consecutive scans of the last 90 days (the lag sees older scans, the diff only these)."""
    pairs = history.consecutive(fx.snapshots(spark, sf)).where(F.col("scanned_at") >= now() - F.expr("interval 90 days"))
    rows = fx.issues(spark, sf).select("scan_id", "fingerprint")
    gone = history.diff(pairs, rows, "fingerprint").where("change = 'resolved'")
    return gone.join(pairs.select("scan_id", "app_id"), "scan_id").groupBy("app_id").agg(F.count(F.lit(1)).alias("resolved"))


SQL_ASOF = f"""days AS (SELECT (TIMESTAMP '{fx.NOW}' - to_days(i::int))::date AS day FROM range(14) t(i)),
at_day AS (SELECT day, app_id, scan_id FROM (SELECT day, s.app_id, s.scan_id, row_number() OVER (PARTITION BY day, s.app_id ORDER BY scanned_at DESC, s.scan_id DESC) AS rn
 FROM days JOIN snapshots s ON s.scanned_at < day + INTERVAL 1 DAY JOIN apps USING (app_id) WHERE NOT archived) WHERE rn = 1)"""


@query(ctes(*ACTIVE, fx.SQL_APPS, SQL_ASOF) + "SELECT day, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in SEVERITIES) + ", count(*) AS total FROM at_day JOIN active USING (scan_id) GROUP BY day")
def trend_asof(spark, sf):
    """Daily active findings over the last snapshots at each day's end, with today's triage and rules."""
    scans = fx.snapshots(spark, sf).join(live(spark, sf).select("app_id"), "app_id", "left_semi")
    at = history.daily(scans, now().cast("date"), 14).select("day", "scan_id")
    found = active_of(spark, sf, at.select("scan_id").distinct()).groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    rows = at.join(found, "scan_id")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0).cast("long")).alias(s.lower())
    return rows.groupBy("day").agg(*map(of, SEVERITIES), F.sum("n").alias("total"))


@query(ctes(fx.SQL_SNAPSHOTS) + f"SELECT app_id, scan_id, scanned_at FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY old DESC, CASE WHEN old THEN scanned_at END DESC, CASE WHEN old THEN scan_id END DESC, scanned_at, scan_id) AS rn FROM (SELECT *, scanned_at <= TIMESTAMP '{fx.NOW}' - INTERVAL 7 DAY AS old FROM snapshots)) WHERE rn = 1")
def digest_baseline(spark, sf):
    return history.baseline(fx.snapshots(spark, sf), now() - F.expr("interval 7 days"))


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + "SELECT CASE WHEN scan_id IS NULL THEN 'Not Started' WHEN duration_ms > 40000 THEN 'Failed' ELSE 'Done' END AS status, count(*) AS n FROM apps LEFT JOIN latest USING (app_id) WHERE NOT archived GROUP BY 1")
def apps_by_status(spark, sf):
    last = history.latest(fx.snapshots(spark, sf))
    status = F.when(F.col("scan_id").isNull(), "Not Started").when(F.col("duration_ms") > 40000, "Failed").otherwise("Done")
    return live(spark, sf).join(last, "app_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_APPS) + "SELECT coalesce(nullif(environment, ''), 'Unset') AS environment, count(*) AS n FROM apps WHERE NOT archived GROUP BY 1")
def apps_by_environment(spark, sf):
    return live(spark, sf).groupBy(F.coalesce(F.nullif("environment", F.lit("")), F.lit("Unset")).alias("environment")).agg(F.count(F.lit(1)).alias("n"))


def ages(spark: SparkSession, sf: str) -> DataFrame:
    return live(spark, sf).join(history.latest(fx.snapshots(spark, sf)), "app_id", "left").withColumn("days", F.floor((F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(F.col("scanned_at").cast("timestamp"))) / 86400))


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + f"SELECT app_id, name, floor((epoch(TIMESTAMP '{fx.NOW}') - epoch(scanned_at)) / 86400)::bigint AS days FROM apps LEFT JOIN latest USING (app_id) WHERE NOT archived AND (scanned_at IS NULL OR floor((epoch(TIMESTAMP '{fx.NOW}') - epoch(scanned_at)) / 86400) > 14)")
def stale_apps(spark, sf):
    """Never scanned, or not in 14 days; those without a scan come first."""
    return ages(spark, sf).where("days is null or days > 14").select("app_id", "name", "days").orderBy(F.desc_nulls_first("days"), "app_id")


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + "SELECT app_id, duration_ms FROM apps JOIN latest USING (app_id) WHERE NOT archived AND duration_ms > greatest(5000, 2 * (SELECT avg(duration_ms) FROM apps JOIN latest USING (app_id) WHERE NOT archived))")
def slow_apps(spark, sf):
    last = live(spark, sf).join(history.latest(fx.snapshots(spark, sf)), "app_id")
    mean = last.agg(F.avg("duration_ms").alias("mean"))  # one row
    return last.join(F.broadcast(mean), F.col("duration_ms") > F.greatest(F.lit(5000.0), 2 * F.col("mean"))).select("app_id", "duration_ms")


@query(ctes(fx.SQL_APPS, fx.SQL_SNAPSHOTS, fx.SQL_LATEST) + f"SELECT app_id, schedule_minutes, scanned_at + to_minutes(schedule_minutes) AS next_due, coalesce(scanned_at + to_minutes(schedule_minutes) <= TIMESTAMP '{fx.NOW}', true) AS overdue FROM apps LEFT JOIN latest USING (app_id) WHERE NOT archived AND schedule_minutes > 0")
def scan_calendar(spark, sf):
    own = live(spark, sf).where("schedule_minutes > 0").join(history.latest(fx.snapshots(spark, sf)), "app_id", "left")
    due = F.col("scanned_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("schedule_minutes"))
    return own.select("app_id", "schedule_minutes", due.alias("next_due"), F.coalesce(due <= now(), F.lit(True)).alias("overdue"))


@query(ctes(fx.SQL_APPS, *BASE[:2], fx.SQL_LATEST) + """SELECT tech, app_id, n FROM (SELECT *, count(*) OVER (PARTITION BY tech) AS n FROM (
SELECT DISTINCT app_id, tech FROM (SELECT app_id, unnest(tags) AS tech FROM apps WHERE NOT archived UNION ALL SELECT app_id, lower(category) AS tech FROM latest JOIN issues USING (scan_id, app_id) JOIN apps USING (app_id) WHERE NOT archived))) WHERE n > 1""")
def tech_stack_shared(spark, sf):
    """Technologies that several apps have, a row for each app: named by hand, or seen in the last scan."""
    own = live(spark, sf)
    scans = history.latest(fx.snapshots(spark, sf)).select("scan_id")
    seen = fx.issues(spark, sf, scans).select("app_id", F.lower("category").alias("tech")).distinct().join(own.select("app_id"), "app_id", "left_semi")
    rows = own.select("app_id", F.explode("tags").alias("tech")).union(seen).distinct()
    shared = rows.groupBy("tech").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(shared, "tech").select("tech", "app_id", "n")


@query(ctes(fx.SQL_APPS) + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM apps WHERE NOT archived) GROUP BY 1")
def tag_counts(spark, sf):
    return live(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_APPS) + "SELECT app_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'tier2' THEN 'tier1' ELSE t END))), ',') AS tags FROM apps WHERE list_contains(tags, 'tier2')")
def tag_merge(spark, sf):
    """Apps that a merge of tag tier2 into tier1 changes, with their tags after it."""
    merged = F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.when(t == "tier2", "tier1").otherwise(t))))
    return fx.apps(spark, sf).where(F.array_contains("tags", "tier2")).select("app_id", F.array_join(merged, ",").alias("tags"))


SQL_COMPARE = "c AS (SELECT app_id, severity, count(*) AS n FROM active WHERE scan_id IN (SELECT scan_id FROM latest) AND app_id IN (1, 2) GROUP BY ALL)"


@query(ctes(*LIVE, fx.SQL_SEVERITY, SQL_COMPARE) + "SELECT severity, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n, coalesce(a.n, 0) <> coalesce(b.n, 0) AS differs FROM sev LEFT JOIN (FROM c WHERE app_id = 1) a USING (severity) LEFT JOIN (FROM c WHERE app_id = 2) b USING (severity)")
def compare_apps(spark, sf):
    """Two apps side by side, suppression rules applied to both."""
    scans = history.latest(fx.snapshots(spark, sf).where("app_id in (1, 2)")).select("scan_id")
    n = active_of(spark, sf, scans).groupBy("severity").agg(F.count_if(F.col("app_id") == 1).alias("l"), F.count_if(F.col("app_id") == 2).alias("r"))
    zero = F.lit(0).cast("long")
    return severities(spark).join(n, "severity", "left").select("severity", F.coalesce("l", zero).alias("left_n"), F.coalesce("r", zero).alias("right_n"), (F.coalesce("l", zero) != F.coalesce("r", zero)).alias("differs"))


@query(ctes(fx.SQL_APPS) + "SELECT a.owner, a.environment, count(*) AS n FROM apps a SEMI JOIN apps b ON lower(a.owner) = lower(b.owner) AND a.environment = b.environment AND a.app_id <> b.app_id WHERE a.environment <> '' GROUP BY ALL")
def siblings(spark, sf):
    """Apps that share owner and environment with another, counted without pairing them."""
    own = fx.apps(spark, sf).where("environment <> ''")
    return own.groupBy("owner", "environment").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(ctes(*LIVE, fx.SQL_SEVERITY) + "SELECT app_id, category, regexp_extract(file, '[^/]*$') AS name, count(*) AS n, arg_min(severity, rank) AS worst FROM active JOIN sev USING (severity) WHERE scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived) GROUP BY ALL")
def issue_groups_worst(spark, sf):
    return latest_active(spark, sf).groupBy("app_id", "category", basename(F.col("file")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", state.rank(F.col("severity"))).alias("worst"))


@query(ctes(*LIVE) + "SELECT app_id, bool_or(severity IN ('Critical', 'High')) AS failing FROM active WHERE scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived) GROUP BY 1")
def ci_gate(spark, sf):
    return state.gate(latest_active(spark, sf), "High")


@query(ctes(*LIVE, fx.SQL_SEVERITY) + "SELECT app_id, file, line, category, severity, rn FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY rank, file, line, category, summary, scan_id)::int AS rn FROM active JOIN sev USING (severity) WHERE scan_id IN (SELECT scan_id FROM latest JOIN apps USING (app_id) WHERE NOT archived)) WHERE rn <= 5")
def worst_offenders(spark, sf):
    """The five worst findings of each app, in a total order."""
    order = Window.partitionBy("app_id").orderBy(state.rank(F.col("severity")), "file", "line", "category", "summary", "scan_id")
    return latest_active(spark, sf).withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("app_id", "file", "line", "category", "severity", "rn")


@query(ctes(*BASE) + "SELECT app_id, bool_or(state = 'fixed') AS has_fixed, bool_or(state = 'acknowledged') AS has_acknowledged, (bool_or(state = 'fixed')::int + bool_or(state = 'acknowledged')::int)::bigint AS done FROM triage GROUP BY 1")
def onboarding_signals(spark, sf):
    has = lambda s: F.bool_or(F.col("state") == s)
    return fx.triage(spark, sf).groupBy("app_id").agg(has("fixed").alias("has_fixed"), has("acknowledged").alias("has_acknowledged")).withColumn("done", F.col("has_fixed").cast("long") + F.col("has_acknowledged").cast("long"))


@query(ctes(fx.SQL_ISSUES) + ", f AS (SELECT DISTINCT file, category FROM issues), o AS (SELECT DISTINCT file, 'owner of ' || file AS text FROM f WHERE file LIKE 'src/red/%'), g AS (SELECT DISTINCT category, 'about ' || category AS text FROM f WHERE category IN ('ECONOMY', 'PROMO')) SELECT file, category, coalesce(o.text, g.text, 'none') AS description FROM f LEFT JOIN o USING (file) LEFT JOIN g USING (category)")
def override_coalesce(spark, sf):
    """A person's text, else a generated one, else the placeholder."""
    f = fx.issues(spark, sf).select("file", "category").distinct()
    keys = ["file", "category"]
    own = f.where("file like 'src/red/%'").select(*keys, F.concat(F.lit("owner of "), F.col("file")).alias("text"))
    made = f.where("category in ('ECONOMY', 'PROMO')").select(*keys, F.concat(F.lit("about "), F.col("category")).alias("text"))
    return state.described(f, own, made, keys, "none").select(*keys, "description")
