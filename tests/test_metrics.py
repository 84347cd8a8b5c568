"""Structure findings and call resolution on small files."""

from loomscan.operators import extract, graph, lexer, metrics

CODE = """import { load } from './b';
function outer(req, res) {
  if (a && b) { res.status(404).json({}); }
  const inner = () => { if (c) { d(); } };
  load(req); helper();
  for (const x of xs) { db.query(x); for (const y of x) { db.findMany(y); } }
}
function helper() { return 1; }
useEffect(() => { window.addEventListener('x', f); });
useEffect(() => { const t = setInterval(f, 1); return () => clearInterval(t); });
""" + "function big() {\n" + "  go();\n" * 90 + "}\nfunction deep() { if (a) { if (b) { if (c) { if (d) { if (e) { if (f) { g(); } } } } } } }\n"


def test_structure(spark):
    df = spark.createDataFrame([("a.js", ".js", 1, 1, CODE), ("b.js", ".js", 1, 1, "export function load(x) { return x; }\n"), ("c.py", ".py", 1, 1, "def f(): pass")], "rel_path string, ext string, size_bytes long, mtime_ms long, content string")
    b = metrics.blocks(lexer.masked(df)).persist()
    found = {(r["category"], r["severity"], r["line"]) for r in metrics.findings(b).collect()}
    assert found == {("Oversized Function", "Low", 11), ("Deep Nesting", "Low", 103), ("N+1 Query Pattern", "Medium", 6), ("Missing Effect Cleanup", "Medium", 9)}
    assert sum(r["category"] == "N+1 Query Pattern" for r in metrics.findings(b).collect()) == 2
    strict = {r["summary"] for r in metrics.findings(b, branches=5).where("category = 'High Cyclomatic Complexity'").collect()}
    assert strict == {"outer: branches 5", "deep: branches 7"}
    imports = extract.components(df).where("kind = 'import'").selectExpr("rel_path as from_path", "name as spec")
    functions = extract.components(df).where("kind = 'function'").select("rel_path", "name")
    calls = metrics.resolved(metrics.calls(b), functions, graph.edges(imports, df))
    assert {(r["src"], r["dst"]) for r in calls.collect()} == {("a.js#outer", "b.js#load"), ("a.js#outer", "a.js#helper")}
    start = spark.createDataFrame([("a.js#outer",)], "start string")
    assert [r["node"] for r in graph.trace(start, calls).orderBy("rn").collect()] == ["a.js#outer", "b.js#load", "a.js#helper"]
    trace = {r["name"]: r for r in metrics.body_trace(b).collect()}
    assert (trace["outer"]["status_codes"], trace["outer"]["responds"], trace["helper"]["responds"]) == (["404"], True, False)
