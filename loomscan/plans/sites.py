"""Registered queries of pages and sites over wikis and facts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.operators import pages, render
from loomscan.plans.portfolio import query
from loomscan.plans.sources import Tree, register
from loomscan.plans.surface import ROOT
from loomscan.sources import fixtures as fx
from loomscan.sources import manifests

WIKI = Tree({
    "Home.md": "# Wiki §k & more\n\nSee [flows](Process-Flows/§t.md), [none](Gone§n.md) and [out](https://a.org/§w.md).\n- **one** `a<b`\n- two\n1. first\n---\n| A | B |\n|---|---|\n| [h](Home.md) | §n |\n```\nx < §n\n```",
    "Process-Flows/§t.md": "## Users §n\n[back](../Home.md) [own](§t.md) [lost](../§w.md)",
    "Notes.md": "plain §w",
})
SITE = Tree({
    "Home.html": '<h1>Wiki §k &amp; more</h1>\n\n<p>See <a href="Process-Flows/§t.html">flows</a>, none and <a href="https://a.org/§w.md" target="_blank" rel="noopener">out</a>.</p>\n<ul>\n<li><strong>one</strong> <code>a&lt;b</code></li>\n<li>two</li>\n</ul>\n'
    '<ol>\n<li>first</li>\n</ol>\n<hr>\n<table>\n<tr><th>A</th><th>B</th></tr>\n<tr><td><a href="Home.html">h</a></td><td>§n</td></tr>\n</table>\n<pre><code>\nx &lt; §n\n</code></pre>',
    "Process-Flows/§t.html": '<h2>Users §n</h2>\n<p><a href="Home.html">back</a> <a href="Process-Flows/§t.html">own</a> lost</p>',
    "Notes.html": "<p>plain §w</p>",
    "index.html": '<a href="Home.html">Continue</a>',
})
FLAT = Tree({
    "Home.md": WIKI.templates["Home.md"].replace("Process-Flows/", "Process-Flows-"),
    "Process-Flows-§t.md": "## Users §n\n[back](Home.md) [own](Process-Flows-§t.md) [lost](../§w.md)",
    "Notes.md": "plain §w",
})
#: Every third part has no notes, every fifth no flows: the links to them are broken.
KEEP = "NOT (path = 'Notes.md' AND p_size % 3 = 0)"


def wiki(spark: SparkSession, sf: str, keep: str = KEEP) -> DataFrame:
    return WIKI.files(spark, sf, keep).select("app_id", F.col("rel_path").alias("path"), "content")


register(
    "static_site", lambda spark, sf: render.site(wiki(spark, sf)),
    f"WITH {SITE.sql(where=KEEP.replace('.md', '.html'))} SELECT app_id, rel_path AS path, content AS html FROM code", "Pages of wikis as a site; links to pages that exist only.",
)
register("flat_wiki", lambda spark, sf: render.flat_wiki(wiki(spark, sf)), f"WITH {FLAT.sql(where=KEEP)} SELECT app_id, rel_path AS path, content FROM code", "Wikis without folders.")
FLOWLESS = "NOT (path LIKE 'Process%' AND p_size % 5 = 0)"
register(
    "broken_links", lambda spark, sf: render.broken_links(wiki(spark, sf, FLOWLESS)),
    f"""WITH {WIKI.sql(where=FLOWLESS)}, t AS (SELECT DISTINCT app_id, rel_path AS path, unnest(regexp_extract_all(content, '[]][(]([^)]+[.]md)[)]', 1)) AS target FROM code)
SELECT app_id, path, target FROM t WHERE NOT target LIKE 'http%' AND NOT EXISTS (SELECT 1 FROM code c WHERE c.app_id = t.app_id
  AND c.rel_path = CASE WHEN target LIKE '../%' THEN target[4:] WHEN contains(path, '/') THEN 'Process-Flows/' || target ELSE target END)""",
    "Links that name no page of their app, read from the page's folder.",
)

PAGES = f"pages_of AS (SELECT app_id, count(*) AS n FROM code GROUP BY 1), {fx.SQL_APPS}"


@query(f"""WITH {WIKI.sql(where="p_size % 2 = 0")}, {PAGES}, f AS (SELECT a.app_id, name || ' <' || owner || '>' AS name, environment, n, CASE WHEN archived THEN NULL ELSE a.app_id % 9 END AS issues FROM apps a LEFT JOIN pages_of USING (app_id)),
c AS (SELECT *, replace(replace(name, '<', '&lt;'), '>', '&gt;') AS shown FROM f)
SELECT app_id, '<tr><td>' || CASE WHEN n IS NULL THEN shown ELSE '<a href="app-' || app_id || '/Home.html">' || shown || '</a>' END || '</td><td>' || CASE WHEN environment = '' THEN '—' ELSE environment END
  || '</td><td>Done</td><td>' || coalesce(issues::varchar, '—') || '</td><td>' || coalesce(n || ' page(s)', 'No wiki generated yet') || '</td></tr>' AS row, n IS NOT NULL AS exported FROM c""")
def portfolio_site(spark, sf):
    """The portfolio's table: apps with their pages, or that there are none."""
    a = fx.apps(spark, sf).select(
        "app_id", F.concat("name", F.lit(" <"), "owner", F.lit(">")).alias("name"), "environment", F.lit("Done").alias("status"), F.concat(F.lit("app-"), F.col("app_id").cast("string")).alias("slug"),
        F.when(~F.col("archived"), F.col("app_id") % 9).alias("issues"),
    )
    return render.portfolio_index(a, wiki(spark, sf, "p_size % 2 = 0"))


LABEL = "CASE WHEN len({0}) > 80 THEN replace({0}, chr(34), chr(39))[1:79] || '…' ELSE replace({0}, chr(34), chr(39)) END"
NODE = "'n' || substr(sha1({0}), 1, 12) || '[\"' || " + LABEL + " || '\"]'"
EDGE = f"'  ' || {NODE.format('src')} || ' --> ' || {NODE.format('dst')}"


@query(f"""WITH f AS (SELECT p_type AS entry, 'load "' || p_name || '"' AS src, CASE WHEN p_size % 5 = 0 THEN repeat('x', 60 + p_size) ELSE p_brand END AS dst FROM part)
SELECT entry, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT DISTINCT entry, {EDGE} AS line FROM f) GROUP BY entry""")
def mermaid_flow(spark, sf):
    """Flowcharts: what each kind of part loads."""
    dst = F.when(F.col("p_size") % 5 == 0, F.repeat(F.lit("x"), 60 + F.col("p_size"))).otherwise(F.col("p_brand"))
    return render.flowchart(fx.read(spark, sf, "part").select(F.col("p_type").alias("entry"), F.concat(F.lit('load "'), "p_name", F.lit('"')).alias("src"), dst.alias("dst")))


@query("""SELECT p_partkey % 20 AS app_id, 'Progress.md' AS path, '# Progress' || chr(10) || chr(10) || '| Directory | Status |' || chr(10) || '|---|---|' || chr(10)
  || string_agg('| ' || p_name || ' | ' || ['Not Started', 'Done', 'In Progress'][1 + p_size % 3] || ' |', chr(10) ORDER BY p_size, p_name) || chr(10) AS content FROM part GROUP BY 1""")
def progress_pages(spark, sf):
    status = F.when(F.col("p_size") % 3 == 1, "Done").when(F.col("p_size") % 3 == 2, "In Progress")
    return pages.progress_pages(fx.read(spark, sf, "part").select((F.col("p_partkey") % 20).alias("app_id"), F.col("p_name").alias("unit"), F.col("p_size").alias("ord"), status.alias("status")))


@query("""WITH p AS (SELECT p_partkey AS app_id, p_size, replace(p_name, ' ', '-') AS w FROM part),
x AS (SELECT app_id, p_size, w, upper(w[1]) || w[2:] AS g, p_size % 4 AS models FROM p)
SELECT app_id, 'Architecture.md' AS path, '# Architecture' || chr(10) || chr(10) || CASE WHEN p_size % 5 = 0 THEN 'A service.' || chr(10) || chr(10) || '_(generated)_' || chr(10) || chr(10) ELSE '' END
  || '## Directory Structure' || chr(10) || chr(10) || CASE WHEN p_size % 3 = 0 THEN '_none found_' ELSE '```' || chr(10) || '- ' || w || '/' || chr(10) || '  - lib/' || chr(10) || '```' END || chr(10) || chr(10)
  || '## Tech Stack' || chr(10) || chr(10) || '- **Go**: `go.mod`, go modules' || chr(10) || '- **Node.js**: `package.json`, npm/yarn/pnpm' || chr(10) || '- **Python**: `requirements.txt`, pip' || chr(10) || chr(10)
  || '## Entry Points' || chr(10) || chr(10) || '- `lib/' || replace(w, '-', '_') || '.js`' || chr(10) || '- `main.py`' || chr(10) || '- `npm start: node ' || p_size || '`' || chr(10) || chr(10)
  || '## Data Flow' || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN '3 routes in 2 groups, ' ELSE '0 routes in 0 groups, ' END || models || ' models.' || chr(10) || chr(10)
  || '## Process Flow Groups' || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN list_aggregate(list_sort(['- [' || g || '](Process-Flows/' || w || '.md): 2 routes', '- [Zero](Process-Flows/zero.md): 1 routes']), 'string_agg', chr(10)) ELSE '_none found_' END || chr(10) AS content FROM x""")
def architecture_pages(spark, sf):
    """A page for each app: folders, manifests, entry points, route groups."""
    part = fx.read(spark, sf, "part").withColumnRenamed("p_partkey", "app_id").withColumn("w", F.replace("p_name", F.lit(" "), F.lit("-")))
    files = ROOT.files(spark, sf)
    rows = lambda cond, *items: part.where(cond).select("app_id", F.explode(F.array(*items)).alias("x")).select("app_id", "x.*")
    folder = lambda path, level: F.struct(path.alias("path"), F.lit(level).alias("level"))
    route = lambda path: F.struct(F.lit("GET").alias("method"), path.alias("path"))
    under = lambda tail: F.concat(F.lit("/"), F.col("w"), F.lit(tail))
    return pages.architecture_pages(
        part.select("app_id", (F.col("p_size") % 4).cast("long").alias("models")), rows("p_size % 3 <> 0", folder(F.col("w"), 1), folder(F.concat("w", F.lit("/lib")), 2)),
        manifests.manifests(files, spark), manifests.entry_points(files), rows("p_size % 2 = 0", route(under("/a")), route(under("/:id")), route(F.lit("/zero"))),
        part.where("p_size % 5 = 0").select("app_id", F.lit("A service.").alias("text")),
    )


@query("""SELECT p_partkey AS app_id, 'Process-Flows.md' AS path, '# Process Flows' || chr(10) || chr(10) || 'No entry points were detected, so there is nothing to show.' || chr(10) || chr(10) || 'Detected frameworks: '
  || CASE WHEN p_size % 2 = 0 THEN 'Django, Express, Flask, React' ELSE 'none' END || '.' || chr(10) AS content FROM part WHERE p_size % 3 <> 0""")
def no_flow_pages(spark, sf):
    """A page that says so for each app without routes."""
    part = fx.read(spark, sf, "part").withColumnRenamed("p_partkey", "app_id")
    known = manifests.frameworks(ROOT.files(spark, sf, "p_size % 2 = 0"), spark).groupBy("app_id").agg(F.collect_set("framework").alias("frameworks"))
    apps = part.select("app_id").join(known, "app_id", "left").select("app_id", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"))
    return pages.no_flow_pages(apps, part.where("p_size % 3 = 0").select("app_id", F.lit("GET").alias("method"), F.lit("/").alias("path")))
