"""Registered queries of calls and routes over source files derived from `part`: what each call is, who handles a route,
and what a route leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions.joins import sorted_side
from loomscan.operators import extract, graph, metrics
from loomscan.plans.sources import Tree
from loomscan.plans.surface import IMPORTS, MEANT, over
from loomscan.sources import stores

APP = Tree({
    "src/p§k/app.js": """import express from 'express';
import * as users from './users';
import { list as all, load } from './users';
const { audit: log } = require('./lib/audit');
const app = express();
app.get('/one/:id', users.show);
app.post('/§w', async (req, res) => { §c(req); res.json(1); });
app.put('/two', (req, res) => { log(req); }); app.delete('/two', (req, res) => { load(req); });
app.patch('/three', auth, local);
app.get('/none', missing);
function local(req) { all(req); users.gone(req); axios.get('/x'); other(req); helper?.(req); Store.keep(req); }
""",
    "src/p§k/users.ts": """import { db } from './lib/audit';
export function show(req) { load(req); list(req); }
export const list = async (q) => { return db.user.findMany(q); };
export async function load(body) { list(body); db.save(body); }
""",
    "src/p§k/lib/audit.js": """export class Store {
  keep(x) { this.put(x); fs.readFile(x); }
  put(x) { }
}
export function audit(x) { keep(x); }
""",
}, {"§c": "CASE WHEN p_size % 3 = 0 THEN 'load' WHEN p_size % 3 = 1 THEN 'local' ELSE 'unknown' END"})


def bound(f: DataFrame) -> DataFrame:
    """(rel_path, local, to_path): names bound to files of the tree."""
    b = stores.cut(extract.bindings(f), "bindings")  # read twice, parsed once
    files = graph.resolved_imports(b.select(F.col("rel_path").alias("from_path"), "spec"), f)
    return b.join(sorted_side(files.withColumnRenamed("from_path", "rel_path")), ["rel_path", "spec"]).select("rel_path", "local", "to_path").distinct()


def kinds(f: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    blocks = metrics.blocks_of(f) if blocks is None else blocks
    functions = blocks.where("kind = 'function' and name <> '(anonymous)'").select("rel_path", "name", "line")
    return metrics.classified(metrics.whole_calls(blocks), functions, bound(f))


#: SQL: names bound by a line, each with the file it comes from; functions with their bodies, one a line; calls with kinds.
BOUND = r"""edged AS (SELECT rel_path, s, arg_min(m.target, i) AS to_path FROM meant m WHERE m.target IN (SELECT c.rel_path FROM code c) GROUP BY ALL),
clause AS (SELECT rel_path, regexp_extract(l, '''(\./[^'']+)''', 1) AS s, unnest(string_split(regexp_extract(l, '^(?:import|const) [{]?(.*?)[}]? (?:from|= require)', 1), ',')) AS p FROM l WHERE regexp_matches(l, '(from|require[(]) ?''\./')),
bound AS (SELECT rel_path, regexp_extract(p, '([A-Za-z]+) *$', 1) AS local, to_path FROM clause JOIN edged USING (rel_path, s)),
fn AS (SELECT rel_path, line, CASE WHEN regexp_matches(l, '^app[.]') THEN '(anonymous)' WHEN regexp_matches(l, '^  ') THEN 'Store.' || regexp_extract(l, '^  ([a-z]+)', 1) ELSE regexp_extract(l, '(?:function|const) ([a-z]+)', 1) END AS name,
  unnest(CASE WHEN regexp_matches(l, '^app[.]') THEN regexp_extract_all(l, '=> [{]([^}]*)[}]', 1) ELSE [regexp_extract(l, '[{](.*)[}]', 1)] END) AS body FROM l
  WHERE regexp_matches(l, '^(export )?(async )?function |^export const |=> [{]|^  [a-z]+[(]')),
called AS (SELECT rel_path, name, body, replace(unnest(regexp_extract_all(body, '(?:^|[^.\w])([A-Za-z]+(?:[?]?[.][A-Za-z]+)*)[(]', 1)), '?.', '.') AS callee FROM fn),
known AS (SELECT rel_path, regexp_extract(name, '([a-z]+)$', 1) AS last, name FROM fn WHERE name <> '(anonymous)'),
led AS (SELECT c.rel_path, c.name AS caller, callee, CASE WHEN regexp_matches(callee, '[.]findMany$') THEN 'Database call' WHEN regexp_matches(callee, '^axios') THEN 'Outbound HTTP call' WHEN regexp_matches(callee, '^fs[.]') THEN 'File I/O' END AS label,
  split_part(callee, '.', 1) AS base, nullif(split_part(callee, '.', 2), '') AS member FROM called c),
kind AS (SELECT l.rel_path, caller, callee, CASE WHEN label IS NOT NULL THEN 'external' WHEN here.name IS NOT NULL THEN 'local' WHEN b.to_path IS NULL THEN NULL WHEN there.name IS NOT NULL THEN 'imported' ELSE 'opaque-project' END AS kind,
  CASE WHEN label IS NOT NULL THEN NULL WHEN here.name IS NOT NULL THEN l.rel_path ELSE b.to_path END AS to_path, coalesce(label, here.name, there.name) AS target
  FROM led l LEFT JOIN known here ON here.rel_path = l.rel_path AND (here.name = callee OR here.last = base) LEFT JOIN bound b ON b.rel_path = l.rel_path AND b.local = base
  LEFT JOIN known there ON there.rel_path = b.to_path AND there.last = coalesce(member, base))"""
over(
    "call_kinds", lambda f: kinds(f).groupBy("rel_path", "caller", "callee", "kind", "to_path", "target").agg(F.count(F.lit(1)).alias("n")),
    "SELECT rel_path, caller, callee, kind, to_path, target, count(*) AS n FROM kind WHERE kind IS NOT NULL GROUP BY ALL", APP, IMPORTS, MEANT, BOUND,
)
over(
    "import_bindings", lambda f: bound(f).orderBy("rel_path", "local"), "SELECT DISTINCT rel_path, local, to_path FROM bound", APP, IMPORTS, MEANT, BOUND,
)


def handled(f: DataFrame, functions: DataFrame, names: DataFrame) -> DataFrame:
    """The routes of files with the functions that handle them; each file is searched for routes once."""
    return extract.route_calls(stores.cut(extract.routes(f), "routes"), functions, names)


over(
    "route_functions", lambda f: handled(f, stores.cut(metrics.functions_of(f), "functions"), bound(f)).select("rel_path", "method", "path", "name", "line", F.trim("body").alias("body")),
    r"""SELECT r.rel_path, upper(verb) AS method, path, CASE WHEN handler LIKE '(%' THEN '(anonymous)' ELSE f.name END AS name, f.line, trim(replace(f.body, '''/x''', '    ')) AS body
FROM (SELECT rel_path, line, regexp_extract(x, '^app[.]([a-z]+)', 1) AS verb, regexp_extract(x, '''([^'']+)''', 1) AS path, CASE WHEN contains(x, '=>') THEN '(' || regexp_extract(x, '=> [{]([^}]*)', 1) ELSE regexp_extract(x, '([a-z]+)[)];', 1) END AS handler
  FROM (SELECT rel_path, line, unnest(regexp_extract_all(l, 'app[.][a-z]+[(]''[^'']+''.*?[)];(?: *$| (?:[}][)]; ?|app|res[^}]*[}][)];))')) AS x FROM l WHERE regexp_matches(l, '^app[.]'))) r
JOIN fn f ON (f.rel_path = r.rel_path OR handler = 'show' AND f.rel_path = replace(r.rel_path, 'app.js', 'users.ts')) AND CASE WHEN handler LIKE '(%' THEN f.line = r.line AND contains(f.body, handler[2:12]) ELSE f.name = handler END""", APP, IMPORTS, MEANT, BOUND,
)


def route_id() -> Column:
    return F.concat_ws(" ", "rel_path", "method", "path")


def route_edges(f: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(src, dst, ord) from routes to what their handlers call, whether these are inline, named or imported, and from functions
    to what they call."""
    functions = stores.cut(metrics.functions_of(f), "functions")  # each is asked for more than once
    names = stores.cut(bound(f), "names")
    calls = metrics.classified(metrics.whole_calls(functions), functions.where("name <> '(anonymous)'").select("rel_path", "name", "line"), names)
    node = F.coalesce(F.concat("to_path", F.lit("#"), F.coalesce("target", F.lit("?"))), F.concat(F.lit("external: "), F.col("target")))
    k = stores.cut(calls.select("rel_path", "caller", "place", node.alias("dst"), "ord"), "calls")
    named = k.where("caller <> '(anonymous)'").select(F.concat("rel_path", F.lit("#"), "caller").alias("src"), "dst", "ord")
    handlers = extract.route_calls(extract.routes(f) if routes is None else routes, functions, names).select(route_id().alias("src"), "in_path", "place")
    first = handlers.join(sorted_side(k.withColumnRenamed("rel_path", "in_path")), ["in_path", "place"])
    return named.unionByName(first.select("src", "dst", "ord"))


def local_traces(f: DataFrame) -> DataFrame:
    routes = stores.cut(extract.routes(f), "routes")
    return graph.trace(routes.select(route_id().alias("start")), route_edges(f, routes), hops=3, budget=25).select("start", "node", "depth")


#: SQL: what a call leads to, whoever makes it; the function that handles each route, and in which file it is.
HANDLED = r"""dest AS (SELECT DISTINCT rel_path AS at_path, callee, coalesce(to_path || '#' || coalesce(target, '?'), 'external: ' || target) AS dst FROM kind WHERE kind IS NOT NULL),
node AS (SELECT DISTINCT rel_path || '#' || caller AS src, dst FROM kind JOIN dest ON at_path = rel_path AND dest.callee = kind.callee WHERE caller <> '(anonymous)'),
route AS (SELECT rel_path, line, regexp_extract(x, '^app[.]([a-z]+)', 1) AS verb, regexp_extract(x, '''([^'']+)''', 1) AS path, CASE WHEN contains(x, '=>') THEN '(' || regexp_extract(x, '=> [{]([^}]*)', 1) ELSE regexp_extract(x, '([a-z]+)[)];', 1) END AS handler
  FROM (SELECT rel_path, line, unnest(regexp_extract_all(l, 'app[.][a-z]+[(]''[^'']+''.*?[)];(?: *$| (?:[}][)]; ?|app|res[^}]*[}][)];))')) AS x FROM l WHERE regexp_matches(l, '^app[.]'))),
begun AS (SELECT DISTINCT rel_path || ' ' || upper(verb) || ' ' || path AS start FROM route),
entry AS (SELECT DISTINCT start, dst FROM (SELECT r.rel_path || ' ' || upper(verb) || ' ' || path AS start, f.rel_path AS at_path, replace(unnest(regexp_extract_all(f.body, '(?:^|[^.\w])([A-Za-z]+(?:[?]?[.][A-Za-z]+)*)[(]', 1)), '?.', '.') AS callee
  FROM route r JOIN fn f ON (f.rel_path = r.rel_path OR handler = 'show' AND f.rel_path = replace(r.rel_path, 'app.js', 'users.ts')) AND CASE WHEN handler LIKE '(%' THEN f.line = r.line AND contains(f.body, handler[2:12]) ELSE f.name = handler END) JOIN dest USING (at_path, callee))"""
over(
    "route_traces", local_traces,
    """, two AS (SELECT DISTINCT start, n.dst FROM entry e JOIN node n ON n.src = e.dst), three AS (SELECT DISTINCT start, n.dst FROM two e JOIN node n ON n.src = e.dst),
every AS (SELECT start, start AS node, 0 AS depth FROM begun UNION ALL SELECT start, dst, 1 FROM entry UNION ALL SELECT start, dst, 2 FROM two UNION ALL SELECT start, dst, 3 FROM three)
SELECT start, node, min(depth) AS depth FROM every GROUP BY 1, 2""", APP, IMPORTS, MEANT, BOUND, HANDLED,
)
