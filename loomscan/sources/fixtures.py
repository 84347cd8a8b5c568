"""The engine's tables derived from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions.globs import glob_regex

NOW = "2001-08-01 00:00:00"
#: Suppression rules: id, category or `any`, glob, expiry.
RULES = [(1, "ECONOMY", "src/red/**", None), (2, "any", "src/small/*.js", "2002-01-01 00:00:00"), (3, "any", "**/ring.js", "2000-01-01 00:00:00"), (4, "PROMO", "**/widget.js", None)]
IGNORES = [(1, "src1/**", None), (2, "**/de/*.txt", "2002-01-01 00:00:00"), (3, "**/*.txt", "2000-01-01 00:00:00")]
GITIGNORE = "src2/\n*7.txt\n!src2/en/\n!doc_17.txt\n# end\n"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def apps(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    minutes = F.element_at(F.array(*map(F.lit, (0, 60, 1440, 10080))), (F.col("c_custkey") % 4 + 1).cast("int"))
    environment = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("app_id"), F.col("c_name").alias("name"), environment.alias("environment"), F.col("n_name").alias("owner"),
        (F.col("c_acctbal") < 0).alias("archived"), minutes.alias("schedule_minutes"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("tier"), (F.col("c_custkey") % 3).cast("string"))).alias("tags"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("app_id"), F.col("o_orderdate").alias("scanned_at"), (F.col("o_totalprice") / 10).alias("duration_ms"))


def severity() -> F.Column:
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return F.when((r == "R") & (s == "F"), "Critical").when(r == "R", "High").when(r == "A", "Medium").otherwise("Low")


def issues(spark: SparkSession, sf: str, scans: DataFrame | None = None) -> DataFrame:
    """Findings with their app; the fingerprint holds the line, so a shifted line is a new finding. With `scans` (scan_id) only
    theirs: the others leave before a part is looked up."""
    line, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    known = snapshots(spark, sf).select("scan_id", "app_id")
    known = known if scans is None else known.join(scans.select("scan_id"), "scan_id", "left_semi")
    file = F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit(".js"))
    own = line.withColumnRenamed("l_orderkey", "scan_id").join(known, "scan_id").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "scan_id", F.col("p_type").alias("category"), file.alias("file"), F.col("l_linenumber").alias("line"),
        severity().alias("severity"), F.col("p_brand").alias("summary"), "app_id",
    )
    return own.withColumn("fingerprint", F.concat_ws("::", "category", "file", F.col("line").cast("string"), "summary"))


def triage(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(app_id, fingerprint, state) of triaged findings; with `of`, of those findings only."""
    h = F.substring(F.md5(F.concat(F.col("app_id").cast("string"), F.lit("|"), F.col("fingerprint"))), 1, 1)
    state = F.when(h.isin("0", "1", "2"), "false_positive").when(h.isin("3", "4"), "fixed").when(h.isin("5", "6"), "acknowledged")
    asked = issues(spark, sf) if of is None else of
    return asked.select("app_id", "fingerprint").withColumn("state", state).where("state is not null").distinct()


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, c, g, glob_regex(g), e) for i, c, g, e in RULES]
    return spark.createDataFrame(rows, "rule_id int, rule_category string, pattern string, regex string, expires string").withColumn("expires_at", F.col("expires").cast("timestamp_ntz")).drop("expires")


def files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf, "documents").select(path.alias("rel_path"), F.lit(".txt").alias("ext"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"), "doc_id")


SQL_APPS = """apps AS (SELECT c_custkey AS app_id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS environment, n_name AS owner,
 c_acctbal < 0 AS archived, [0, 60, 1440, 10080][(c_custkey % 4 + 1)::int] AS schedule_minutes, [lower(c_mktsegment), 'tier' || (c_custkey % 3)] AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SQL_SNAPSHOTS = "snapshots AS (SELECT o_orderkey AS scan_id, o_custkey AS app_id, o_orderdate AS scanned_at, o_totalprice / 10 AS duration_ms FROM orders)"
SQL_ISSUES = """issues AS (SELECT *, category || '::' || file || '::' || line || '::' || summary AS fingerprint FROM (SELECT l_orderkey AS scan_id, o_custkey AS app_id, p_type AS category,
 'src/' || replace(p_name, ' ', '/') || '.js' AS file, l_linenumber AS line, p_brand AS summary,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Critical' WHEN l_returnflag = 'R' THEN 'High' WHEN l_returnflag = 'A' THEN 'Medium' ELSE 'Low' END AS severity
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey))"""
SQL_TRIAGE = """triage AS (SELECT * FROM (SELECT app_id, fingerprint, CASE WHEN h IN ('0', '1', '2') THEN 'false_positive' WHEN h IN ('3', '4') THEN 'fixed' WHEN h IN ('5', '6') THEN 'acknowledged' END AS state
 FROM (SELECT DISTINCT app_id, fingerprint, substr(md5(app_id || '|' || fingerprint), 1, 1) AS h FROM issues)) WHERE state IS NOT NULL)"""
#: What the globs mean, written by hand.
MEANT = {"src/red/**": "src/red/.*", "src/small/*.js": "src/small/[^/]*[.]js", "**/ring.js": "(.*/)?ring[.]js", "**/widget.js": "(.*/)?widget[.]js"}
SQL_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{g}', '{MEANT[g]}', {f"TIMESTAMP '{e}'" if e else 'CAST(NULL AS TIMESTAMP)'})" for i, c, g, e in RULES) + ") AS r(rule_id, rule_category, pattern, regex, expires_at))"
SQL_SEVERITY = "sev AS (SELECT * FROM (VALUES ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3)) AS s(severity, rank))"
SQL_ACTIVE = f"""active AS (SELECT i.* FROM issues i LEFT JOIN triage t USING (app_id, fingerprint) WHERE coalesce(t.state, 'open') NOT IN ('false_positive', 'fixed')
 AND NOT EXISTS (SELECT 1 FROM rules r WHERE (r.rule_category = 'any' OR r.rule_category = i.category) AND (r.expires_at IS NULL OR r.expires_at >= TIMESTAMP '{NOW}') AND regexp_full_match(i.file, r.regex)))"""
SQL_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM snapshots) WHERE rn = 1)"
SQL_FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS rel_path, text AS content, strlen(text) AS size_bytes, doc_id FROM documents)"
