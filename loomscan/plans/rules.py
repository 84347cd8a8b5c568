"""Registered queries of rule tables: each app's own ignore rules, and many suppression rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscan.operators import rules
from loomscan.plans import portfolio as pf
from loomscan.plans.portfolio import ctes, query
from loomscan.sources import fixtures as fx

SQL_OWN = "own AS (SELECT doc_id % 1000 AS app_id, rel_path FROM files)"


def own_files(spark, sf):
    """Documents as files of a thousand apps."""
    return fx.files(spark, sf).select((F.col("doc_id") % 1000).alias("app_id"), "rel_path")


def app_lines(spark, sf):
    """Each customer's .gitignore: texts that end in a digit of its key, a folder back in, a folder out, one file back in."""
    k, n = (F.col("c_custkey") % 10).cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat_ws("\n", F.lit("# rules"), F.concat(F.lit("*"), k, F.lit(".txt  ")), F.lit(""), F.concat(F.lit("!src"), n, F.lit("/")), F.concat(F.lit("/src"), k, F.lit("/de")), F.concat(F.lit("!doc_?"), k, F.lit(".txt")))
    return rules.gitignore_table(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("app_id"), text.alias("content")))


SQL_LINES = """line AS (SELECT c_custkey AS app_id, unnest([1, 3, 4, 5]) AS ord, unnest([false, true, false, true]) AS negated,
  unnest(['(.*/)?[^/]*' || c_custkey % 10 || '[.]txt(/.*)?', '(.*/)?src' || c_nationkey || '/.*', 'src' || c_custkey % 10 || '/de(/.*)?', '(.*/)?doc_[^/]' || c_custkey % 10 || '[.]txt(/.*)?']) AS pattern FROM customer)"""


@query(ctes(fx.SQL_FILES, SQL_OWN, SQL_LINES) + """SELECT app_id, rel_path, coalesce(NOT arg_max(negated, ord) FILTER (WHERE regexp_full_match(rel_path, pattern)), false) AS ignored
FROM own LEFT JOIN line USING (app_id) GROUP BY 1, 2""")
def app_ignore_lines(spark, sf):
    """Each app's files under the app's own .gitignore; the last line that matches decides."""
    return rules.with_ignored(own_files(spark, sf), app_lines(spark, sf))


#: Ignore patterns: each fourth customer has one of its own, and every nation has one for all its customers; some are over.
SQL_PATTERNS = f"""pattern AS (SELECT c_custkey AS app_id, 'src' || c_custkey % 7 || '/.*' AS p, c_custkey % 3 <> 0 AS live FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, '(.*/)?en/[^/]*' || n_nationkey % 10 || '[.]txt', n_nationkey % 5 <> 0 FROM nation JOIN customer ON c_nationkey = n_nationkey)"""


@query(ctes(fx.SQL_FILES, SQL_OWN, SQL_LINES, SQL_PATTERNS) + """SELECT app_id, rel_path FROM own o WHERE coalesce((SELECT arg_max(negated, ord) FROM line l WHERE l.app_id = o.app_id AND regexp_full_match(o.rel_path, l.pattern)), true)
AND NOT EXISTS (SELECT 1 FROM pattern p WHERE p.app_id = o.app_id AND live AND regexp_full_match(o.rel_path, p))""")
def app_visible_files(spark, sf):
    """Files that neither an app's .gitignore nor an ignore pattern hides, of the app or inherited from its owner."""
    c, n = fx.read(spark, sf, "customer"), fx.read(spark, sf, "nation")
    over, late = F.lit("2001-01-01").cast("timestamp_ntz"), F.lit("2002-01-01").cast("timestamp_ntz")
    own = c.where("c_custkey % 4 = 0").select(
        F.col("c_custkey").alias("app_id"), F.lit(None).cast("int").alias("owner"), F.concat(F.lit("src"), (F.col("c_custkey") % 7).cast("string"), F.lit("/**")).alias("pattern"),
        F.when(F.col("c_custkey") % 3 != 0, late).otherwise(over).alias("expires_at"),
    )
    shared = n.select(
        F.lit(None).cast("long").alias("app_id"), F.col("n_nationkey").alias("owner"), F.concat(F.lit("**/en/*"), (F.col("n_nationkey") % 10).cast("string"), F.lit(".txt")).alias("pattern"),
        F.when(F.col("n_nationkey") % 5 != 0, late).otherwise(over).alias("expires_at"),
    )
    patterns = rules.inherited(own.unionByName(shared), c.select(F.col("c_custkey").alias("app_id"), F.col("c_nationkey").alias("owner")))
    marked = rules.with_ignored(own_files(spark, sf), app_lines(spark, sf), rules.glob_table(patterns, pf.now()))
    return marked.where("not ignored").select("app_id", "rel_path")


#: Findings' kinds are categories with brands; every part makes a rule, of five shapes.
SQL_KINDS = "kind AS (SELECT category || ' ' || summary AS category, 'app' || app_id % 50 || '/' || file AS file, scan_id FROM issues)"
SQL_MANY = f"""many AS (SELECT CASE WHEN p_size = 7 THEN 'any' ELSE p_type || ' ' || p_brand END AS rule_category, p_size % 3 <> 0 AS live, CASE p_partkey % 5
  WHEN 0 THEN 'app' || p_partkey % 50 || '/src/' || split_part(p_name, ' ', 1) || '/.*' WHEN 1 THEN '(.*/)?' || split_part(p_name, ' ', 2) || '[.]js'
  WHEN 2 THEN 'app' || p_partkey % 50 || '/src/' || replace(p_name, ' ', '/') || '[.]js' WHEN 3 THEN '[^/]*' || p_partkey % 10 || '/src/' || split_part(p_name, ' ', 1) || '/[^/]*[.]js'
  ELSE '(.*/)?[^/]*' || p_partkey % 10 || '/(.*/)?' || p_name[1] || '[^/]*/.*' END AS pattern FROM part)"""


@query(ctes(fx.SQL_ISSUES, SQL_KINDS, SQL_MANY) + """, k AS (SELECT DISTINCT category, file FROM kind),
hidden AS (SELECT k.* FROM k JOIN many ON rule_category = category WHERE live AND regexp_full_match(file, pattern)
  UNION SELECT k.* FROM k JOIN many ON rule_category = 'any' WHERE live AND regexp_full_match(file, pattern))
SELECT category, count(*) AS n, count(*) FILTER (WHERE h.file IS NULL) AS shown FROM kind LEFT JOIN hidden h USING (category, file) GROUP BY 1""")
def suppression_table(spark, sf):
    """Findings by category, and those that none of the parts' rules hides."""
    kinds = fx.issues(spark, sf).select(
        F.concat_ws(" ", "category", "summary").alias("category"), F.concat(F.lit("app"), (F.col("app_id") % 50).cast("string"), F.lit("/"), "file").alias("file"), "scan_id",
    )
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    k, digit = (F.col("p_partkey") % 50).cast("string"), (F.col("p_partkey") % 10).cast("string")
    shape = F.col("p_partkey") % 5
    pattern = (
        F.when(shape == 0, F.concat(F.lit("app"), k, F.lit("/src/"), word(1), F.lit("/**"))).when(shape == 1, F.concat(F.lit("**/"), word(2), F.lit(".js")))
        .when(shape == 2, F.concat(F.lit("app"), k, F.lit("/src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".js")))
        .when(shape == 3, F.concat(F.lit("*"), digit, F.lit("/src/"), word(1), F.lit("/*.js"))).otherwise(F.concat(F.lit("**/*"), digit, F.lit("/**/"), F.substring("p_name", 1, 1), F.lit("*/**")))
    )
    many = fx.read(spark, sf, "part").select(
        F.when(F.col("p_size") == 7, "any").otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("rule_category"), pattern.alias("pattern"),
        F.when(F.col("p_size") % 3 != 0, F.lit("2002-01-01")).otherwise("2001-01-01").cast("timestamp_ntz").alias("expires_at"),
    )
    hidden = rules.suppressed_kinds(kinds, many, pf.now()).withColumn("hidden", F.lit(1))
    return kinds.join(hidden, ["category", "file"], "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hidden").isNull()).alias("shown"))
