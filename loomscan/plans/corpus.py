"""Registered queries over texts, links and events, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomscan.functions import globs, text
from loomscan.operators import detect, graph, incremental
from loomscan.plans.portfolio import ctes, query
from loomscan.sources import fixtures as fx
from loomscan.streaming import events as ev

TOKEN = r'token = "[0-9a-f]{40}"'


@query(ctes(fx.SQL_FILES) + f"SELECT rel_path, len(regexp_extract_all(content, '{TOKEN}'))::bigint AS n FROM files WHERE regexp_matches(content, '{TOKEN}')")
def custom_rule_hits(spark, sf):
    rules = [("Fixture token", "High", TOKEN)]
    return detect.custom_rules(fx.files(spark, sf), rules).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(fx.SQL_FILES) + f", l AS (SELECT rel_path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files WHERE regexp_matches(content, '{TOKEN}')) SELECT rel_path, line::int AS line, unnest(regexp_extract_all(t, '{TOKEN}')) AS match FROM l WHERE regexp_matches(t, '{TOKEN}')")
def rule_hits_with_line(spark, sf):
    return detect.pattern_rows(fx.files(spark, sf).where(F.col("content").rlike(TOKEN)), TOKEN).select("rel_path", "line", "match")


@query(ctes(fx.SQL_FILES) + f""", s AS (SELECT DISTINCT unnest(regexp_extract_all(content, '"([0-9a-f]{{40}})"', 1)) AS s FROM files), c AS (SELECT s, c, count(*) / 40.0 AS p FROM (SELECT s, unnest(string_split(s, '')) AS c FROM s) GROUP BY ALL)
SELECT s, round(-sum(p * log2(p)), 2) AS entropy FROM c GROUP BY s""")
def string_entropy(spark, sf):
    s = fx.files(spark, sf).select(F.explode(F.regexp_extract_all("content", F.lit('"([0-9a-f]{40})"'), 1)).alias("s")).distinct()
    return s.select("s", text.entropy(F.col("s")).alias("entropy"))


@query(ctes(fx.SQL_FILES) + "SELECT rel_path, n FROM (SELECT rel_path, len(regexp_extract_all(content, '(?i)license'))::bigint AS n FROM files) WHERE n > 0 ORDER BY n DESC, rel_path LIMIT 30")
def text_search(spark, sf):
    """Files by hits, the best 30: the report's length."""
    n = F.regexp_count("content", F.lit("(?i)license")).cast("long")
    return fx.files(spark, sf).select("rel_path", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "rel_path").limit(30)


@query(ctes(fx.SQL_FILES) + ", h AS (SELECT rel_path, content, instr(lower(content), 'license') AS p FROM files), w AS (SELECT *, greatest(p - 60, 1) AS a, least(p + 67, length(content) + 1) AS b FROM h WHERE p > 0) SELECT rel_path, CASE WHEN a > 1 THEN '…' ELSE '' END || substr(content, a, b - a) || CASE WHEN b <= length(content) THEN '…' ELSE '' END AS snippet FROM w")
def search_snippets(spark, sf):
    return fx.files(spark, sf).select("rel_path", text.snippet(F.col("content"), "license").alias("snippet")).where("snippet is not null")


@query(ctes(fx.SQL_FILES) + f", l AS (SELECT rel_path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files), h AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY line) AS rn FROM l WHERE contains(lower(t), 'license')) SELECT rel_path, line::int AS line, t AS text FROM h WHERE rn <= 5")
def search_lines(spark, sf):
    """The first five matching lines of each file."""
    lines = fx.files(spark, sf).where(F.contains(F.lower("content"), F.lit("license"))).select("rel_path", F.slice(F.filter(F.transform(F.split("content", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))), lambda x: F.contains(F.lower(x["text"]), F.lit("license"))), 1, 5).alias("x"))
    return lines.select("rel_path", F.explode("x").alias("x")).select("rel_path", "x.line", "x.text")


@query(ctes(fx.SQL_FILES) + "SELECT rel_path FROM files WHERE regexp_full_match(rel_path, 'src1/.*') OR regexp_full_match(rel_path, '(.*/)?de/[^/]*[.]txt')")
def glob_ignored(spark, sf):
    hit = F.lit(False)
    for _, g, e in fx.IGNORES:
        if e is None or e >= fx.NOW:
            hit = hit | F.col("rel_path").rlike(globs.glob_regex(g))
    return fx.files(spark, sf).where(hit).select("rel_path")


@query(ctes(fx.SQL_FILES) + "SELECT rel_path, coalesce(arg_max(NOT negated, ord) FILTER (WHERE regexp_full_match(rel_path, pattern)), false) AS ignored FROM files, (VALUES (0, false, '(.*/)?src2/.*'), (1, false, '(.*/)?[^/]*7[.]txt(/.*)?'), (2, true, 'src2/en/.*'), (3, true, '(.*/)?doc_17[.]txt')) AS r(ord, negated, pattern) GROUP BY 1")
def gitignore_last_match(spark, sf):
    return fx.files(spark, sf).select("rel_path", globs.ignored_by(F.col("rel_path"), globs.gitignore_rules(fx.GITIGNORE)).alias("ignored"))


SQL_LINKS = "links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"


def links(spark, sf):
    return fx.read(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


@query(ctes(SQL_LINKS) + "SELECT page_id, target, count(*) AS n FROM links GROUP BY ALL")
def page_link_edges(spark, sf):
    return links(spark, sf).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


SQL_PATH = "'/' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), ''), '')"


@query(ctes(SQL_LINKS) + f"SELECT page_id FROM (SELECT page_id, '/' || split_part({SQL_PATH}, '/', 2) AS section FROM pages) WHERE section NOT IN (SELECT target FROM links)")
def unreferenced_pages(spark, sf):
    """Pages whose section no page links to."""
    first = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1))
    pages = fx.read(spark, sf, "pages").select("page_id", first.alias("target"))
    return pages.join(links(spark, sf).select("target").distinct(), "target", "left_anti").select("page_id")


@query("SELECT CASE WHEN s = '' THEN 'Root' ELSE upper(substr(s, 1, 1)) || substr(s, 2) END AS grp, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]*/([^/?#:{]*)', 1) AS s FROM pages) GROUP BY 1")
def route_groups(spark, sf):
    """Pages by the first segment of their path."""
    s = F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#:{]*)", 1)
    name = F.when(s == "", "Root").otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))
    return fx.read(spark, sf, "pages").groupBy(name.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(^|[^L])GPL|CC BY-NC|GNU General Public|GNU Affero') THEN 'restrictive' WHEN regexp_matches(text, 'LGPL|MPL|EPL|GNU Lesser') THEN 'weak' WHEN regexp_matches(text, 'MIT|Apache|BSD|ISC') THEN 'permissive' ELSE 'unknown' END AS class FROM documents) GROUP BY 1""")
def license_class(spark, sf):
    """Class of the licence that a text names."""
    return fx.read(spark, sf, "documents").groupBy(detect.license_class(F.col("text")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (p_size // 10) || '.' || (p_size % 10) || '.0' AS version, (p_size // 10) < 2 OR (p_size // 10 = 2 AND p_size % 10 < 5) AS less FROM part")
def version_less(spark, sf):
    version = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    return fx.read(spark, sf, "part").select("p_partkey", version.alias("version"), globs.version_less(version, F.lit("2.5")).alias("less"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf):
    rows = fx.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.sessions(rows)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT date_trunc('day', ts)::timestamp AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    rows = fx.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.tumbling(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(ctes(fx.SQL_FILES) + "SELECT hit, count(*) AS n FROM (SELECT doc_id % 7 <> 0 OR doc_id % 14 = 0 AS hit FROM files WHERE doc_id % 5 <> 0 UNION ALL SELECT false FROM files WHERE doc_id % 5 = 0) GROUP BY 1")
def incremental_hits(spark, sf):
    """Cached: all but every fifth file. Every seventh has a new time, every other of those new contents too."""
    now = fx.files(spark, sf).withColumn("mtime_ms", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long"))
    then = now.where("doc_id % 5 <> 0").withColumn("mtime_ms", F.lit(1).cast("long")).withColumn("content", F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 14 != 0), F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    cache = incremental.next_cache(then.withColumn("result", F.lit("[]")), "v1")
    return incremental.split_by_cache(now, cache, "v1").groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_max(event_type, ts) AS status, max(ts) AS at FROM events GROUP BY 1")
def last_progress(spark, sf):
    """The state that each app's progress feed ended in."""
    return fx.read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("status"), F.max("ts").alias("at"))


@query("SELECT event_id, event_type, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS change FROM events")
def change_feed(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return fx.read(spark, sf, "events").select("event_id", "event_type", "value", F.round(F.col("value") - F.lag("value").over(w), 2).alias("change"))


@query(ctes(SQL_LINKS) + ", e AS (SELECT DISTINCT '/' || split_part(" + SQL_PATH + ", '/', 2) AS src, target AS dst FROM links), s AS (SELECT DISTINCT src AS start FROM e), r AS (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT start, dst, 1 FROM s JOIN e ON src = start UNION ALL SELECT s.start, b.dst, 2 FROM s JOIN e a ON a.src = s.start JOIN e b ON b.src = a.dst) SELECT start, node, min(depth)::int AS depth FROM r GROUP BY ALL")
def link_trace(spark, sf):
    """Targets within two links of each site section."""
    e = links(spark, sf).select(F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1)).alias("src"), F.col("target").alias("dst")).distinct().withColumn("ord", F.lit(0))
    return graph.trace(e.select(F.col("src").alias("start")).distinct(), e, budget=1 << 30).select("start", "node", "depth")
