"""Calls by kind, bound names, handlers of routes on one line and in other files, methods with their classes; words for times."""

from pyspark.sql import functions as F

from loomscan.functions import text
from loomscan.operators import extract, graph, lexer, metrics, state
from loomscan.plans import calls

FILES = "rel_path string, ext string, size_bytes long, mtime_ms long, content string"


def files(spark, **by_name):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), ".js", 1, 1, v) for k, v in by_name.items()], FILES)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_bound_names(spark):
    f = files(spark, a_dot_js="""import x, { a as b, c, type T } from './one';
import * as ns from "./two"
import './three';
const { d: e, g = 1 } = require('./four'), h = require("./five");
let y = await import('./six');
import {
  long,
  longer as shorter,
} from './seven';
""")  # fmt: skip
    assert rows(extract.bindings(f), "local", "spec") == [("T", "./one"), ("b", "./one"), ("c", "./one"), ("e", "./four"), ("g", "./four"), ("long", "./seven"), ("ns", "./two"), ("shorter", "./seven"), ("x", "./one"), ("y", "./six")]


def test_every_kind_of_call(spark):
    f = files(spark, a_dot_js="""import { load, Box } from './b'; import * as b from './b';
function go(q) { load(q); b.save(q); b.nowhere(q); Box.put(q); local(q); this_is_unknown(q); db.users.findOne(q); fetch(q); fs.readFile(q); bus.publish(q); local?.(q); }
function local(q) { return q; }
""", b_dot_js="export function load(q) {}\nexport class Box {\n  put(q) { if (q) { load(q); } }\n  save(q) { put(q); }\n}\nfunction outer() { const z = { inner(q) { load(q); } }; }\n")  # fmt: skip
    blocks = metrics.blocks(lexer.masked(f)).persist()
    assert rows(blocks.where("kind = 'function'"), "rel_path", "name") == [("a.js", "go"), ("a.js", "local"), ("b.js", "Box.put"), ("b.js", "Box.save"), ("b.js", "inner"), ("b.js", "load"), ("b.js", "outer")]
    b = extract.bindings(f)
    to = graph.resolved_imports(b.select(F.col("rel_path").alias("from_path"), "spec"), f).withColumnRenamed("from_path", "rel_path")
    got = metrics.classified(metrics.whole_calls(blocks), blocks.where("kind = 'function'").select("rel_path", "name", "line"), b.join(to, ["rel_path", "spec"]))
    assert rows(got.where("caller = 'go'"), "callee", "kind", "to_path", "target") == sorted([
        ("load", "imported", "b.js", "load"), ("b.save", "imported", "b.js", "Box.save"), ("b.nowhere", "opaque-project", "b.js", None), ("Box.put", "imported", "b.js", "Box.put"), ("local", "local", "a.js", "local"),
        ("db.users.findOne", "external", None, "Database call"), ("fetch", "external", None, "Outbound HTTP call"), ("fs.readFile", "external", None, "File I/O"), ("bus.publish", "external", None, "Queue/event publish"),
    ], key=str)
    assert rows(got.where("caller like 'Box%'"), "caller", "callee", "target") == [("Box.put", "load", "load"), ("Box.save", "put", "Box.put")]


def test_handlers_of_routes(spark):
    f = files(spark, a_dot_js="""import { show } from './h'; import * as c from './h';
app.get('/b', (q, r) => { one(q); }); app.get('/a', (q, r) => { two(q); });
app.put('/c', show); app.post('/d', c.edit); app.delete('/e', own); app.patch('/f', lost);
function own(q) { three(q); }
""", h_dot_js="export function show(q) { four(q); }\nclass C {\n  edit(q) { five(q); }\n}\n")  # fmt: skip
    b = extract.bindings(f)
    to = graph.resolved_imports(b.select(F.col("rel_path").alias("from_path"), "spec"), f).withColumnRenamed("from_path", "rel_path")
    got = extract.route_calls(extract.routes(f), metrics.blocks(lexer.masked(f)), b.join(to, ["rel_path", "spec"]))
    assert {(r["path"], r["name"], r["body"].strip()) for r in got.collect()} == {
        ("/b", "(anonymous)", "one(q);"), ("/a", "(anonymous)", "two(q);"), ("/c", "show", "four(q);"), ("/d", "C.edit", "five(q);"), ("/e", "own", "three(q);"),
    }


def test_side_effects_of_a_handler(spark):
    f = files(spark, a_dot_js="function go(q, res) { db.user.find(q); axios.get(q); cache(q); db.user.find(2); dbx(q); res.json(1); }\n")
    (row,) = metrics.steps(metrics.body_trace(metrics.blocks(lexer.masked(f)))).collect()
    assert row["side_effects"] == ["db.user.find", "axios.get", "cache"] and row["steps"] == ["calls db.user.find, axios.get, cache", "answers"]


def test_words_for_times(spark):
    said = lambda ms: spark.range(1).select(text.duration_text(F.lit(ms))).collect()[0][0]
    assert [said(x) for x in (0, 999, 1000, 1250, 59_949, 60_000, 125_400, 3_600_000)] == ["0ms", "999ms", "1.0s", "1.3s", "59.9s", "1m 0s", "2m 5s", "60m 0s"]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    due = lambda t: spark.range(1).select(text.due_text(F.lit(t).cast("timestamp"), now)).collect()[0][0]
    times = ["2024-01-01 20:30:00", "2024-01-01 23:30:00", "2024-01-02 00:30:00", "2024-01-02 05:00:00", "2024-01-04 13:00:00"]
    assert [due(t) for t in times] == ["4h overdue", "due now", "due within the hour", "due in 5h", "due in 3d"]


def test_first_steps(spark):
    apps = spark.createDataFrame([(1, "Done", "2024-01-01", "High"), (2, "Done", None, None), (3, None, "2024-01-01", "Critical")], "app_id long, status string, s string, fail_on string").withColumn("scanned_at", F.col("s").cast("timestamp"))
    manual = spark.createDataFrame([(2, True, None)], "app_id long, gate_acknowledged boolean, suppression_acknowledged boolean")
    triage = spark.createDataFrame([(1, "fixed"), (1, "fixed"), (2, "acknowledged")], "app_id long, state string")
    one = spark.createDataFrame([(3,), (3,)], "app_id long")
    got = {(r["app_id"], r["item"]): (r["done"], r["auto"]) for r in state.checklist(apps, manual, triage, one.limit(0), one).collect()}
    assert len(got) == 12 and {k for k, v in got.items() if v[0]} == {(1, "firstScan"), (1, "firstFix"), (1, "ciGate"), (2, "ciGate"), (3, "suppression")}
    assert got[2, "ciGate"] == (True, False) and got[1, "ciGate"] == (True, True)


def test_routes_lead_to_what_inline_named_and_imported_handlers_call(spark):
    f = files(spark, a_dot_js="""import * as users from './users'; import { edit } from './users';
app.get('/show', users.show);
app.put('/in', (q, r) => { own(q); }); app.post('/in', (q, r) => { users.edit(q); });
app.patch('/named', own); app.delete('/far', edit); app.get('/lost', missing);
function own(q) { axios.get(q); }
""", users_dot_js="export function show(q) { fs.readFile(q); }\nexport function edit(q) { show(q); }\n")  # fmt: skip
    assert rows(calls.route_edges(f).where("src like '% %'"), "src", "dst") == sorted([
        ("a.js GET /show", "external: File I/O"), ("a.js PUT /in", "a.js#own"), ("a.js POST /in", "users.js#edit"), ("a.js PATCH /named", "external: Outbound HTTP call"), ("a.js DELETE /far", "users.js#show"),
    ])
    traced = rows(calls.local_traces(f), "start", "node", "depth")
    assert [r for r in traced if "POST" in r[0]] == [("a.js POST /in", "a.js POST /in", 0), ("a.js POST /in", "external: File I/O", 3), ("a.js POST /in", "users.js#edit", 1), ("a.js POST /in", "users.js#show", 2)]
    assert [r for r in traced if "lost" in r[0]] == [("a.js GET /lost", "a.js GET /lost", 0)]


def test_functions_alone_are_those_of_all_blocks(spark):
    own = ["rel_path", "name", "line", "body", "place"]
    f = files(spark, a_dot_js="class A {\n  m(x) { for (;;) { y => { z(x); } } }\n}\nconst f = (a) => { if (a) { g(a); } };\nuseEffect(() => { h(); });\n", b_dot_js="x = {};\n", c_dot_js="// f() {\nx = '){';\n", d_dot_js="x=>{ y }")
    assert rows(metrics.functions_of(f), *own) == rows(metrics.blocks_of(f).where("kind = 'function'"), *own)


def test_a_file_tells_by_which_bases_an_import_may_mean_it(spark):
    paths = ["lib.js", "lib.ts", "lib/index.js", "lib", "a/.js", "m/__init__.py", "m.py", "x.js.js"]
    f = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    i = spark.createDataFrame([("a.js", s, n) for n, s in enumerate(["./lib", "./lib.js", "./lib/", "./lib/index", "./x.js", "./a/", "express", "./lib"])] + [("b.py", "m", 9)], "from_path string, spec string, place int")
    want = graph.candidates(i).join(f.withColumnRenamed("rel_path", "target"), "target")
    own = ["from_path", "spec", "place", "target", "ord"]
    assert rows(graph.existing(i, f), *own) == rows(want, *own)
    assert rows(graph.edges(i.withColumnRenamed("place", "ord"), f), "from_path", "to_path", "ord") == [("a.js", "lib", 0), ("a.js", "lib.js", 1), ("a.js", "lib/index.js", 3), ("a.js", "x.js.js", 4), ("b.py", "m.py", 9)]
