"""Golden rows of the scanning operators, properties of history and state, SQL twins of the registered queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomscan import cli
from loomscan.functions import globs, text
from loomscan.operators import detect, extract, graph, history, incremental, lexer, pages, render, state
from loomscan.plans import calls, corpus, inventory, more, portfolio, rules, scans, sites, stores, streams, surface, trees
from loomscan.plans import pages as page_plans
from loomscan.sources import files as src
from loomscan.sources import manifests
from loomscan.streaming import changes, events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FILES = "rel_path string, ext string, size_bytes long, mtime_ms long, content string"
assert corpus and inventory and page_plans and scans and surface and sites and more and calls and rules and stores and streams and trees


def files(spark, **by_name):
    rows = [(k.replace("__", "/"), "." + k.rpartition(".")[2] if "." in k else "", len(v), 1, v) for k, v in by_name.items()]
    return spark.createDataFrame(rows, FILES)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("name", sorted(portfolio.QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = portfolio.QUERIES[name](spark, SF)
    theirs = con.execute(portfolio.SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v for v in r)
    assert sorted(map(norm, map(tuple, mine.select(*names).collect())), key=str) == sorted(map(norm, theirs.fetchall()), key=str)


def test_globs_and_gitignore(spark):
    df = spark.createDataFrame([(p,) for p in ("x.js", "a/x.js", "a/b/x.js", "a/b.min.js", "build/o.js", "keep/build/o.js", "n.log", "keep.log")], "p string")
    hits = lambda g: {r["p"] for r in df.where(F.col("p").rlike(globs.glob_regex(g))).collect()}
    assert hits("**/x.js") == {"x.js", "a/x.js", "a/b/x.js"} and hits("a/*.js") == {"a/x.js", "a/b.min.js"} and hits("?.js") == {"x.js"}
    rules = globs.gitignore_rules("# c\n*.log\n!keep.log\nbuild/\n/a/b\n")
    assert {r["p"] for r in df.where(globs.ignored_by(F.col("p"), rules)).collect()} == {"n.log", "build/o.js", "keep/build/o.js", "a/b/x.js"}


def test_versions(spark):
    less = lambda a, b: spark.range(1).select(globs.version_less(F.lit(a), F.lit(b))).collect()[0][0]
    assert less("^4.17.20", "4.17.21") and not less("4.17.21", "4.17.21") and less("1.2", "1.2.1") and not less("2", "1.9.9") and not less(">=1.0.0 <2.0.0", "1.0.02")


def test_lines_entropy_slug(spark):
    df = files(spark, **{"a.js": "x\nTODO one\n\nTODO two TODO\n"})
    assert rows(detect.pattern_rows(df, "TODO"), "line") == [(2,), (4,), (4,)]
    one = spark.createDataFrame([("aabb", "Hello, World! ", "a/./b/../c")], "e string, s string, p string").select(text.entropy(F.col("e")), text.slug(F.col("s")), text.folded(F.col("p"))).collect()[0]
    assert tuple(one) == (1.0, "hello-world", "a/c")


def test_lexer_keeps_length_and_hides_literals():
    code = "let a = 'eval(1)'; // eval(2)\n/* eval(3)\n*/ eval(4); const r = /['\"]/; `eval(5)`; \"x\""
    hidden, _, strings = lexer.lex(code)
    assert len(hidden) == len(code) and hidden.count("\n") == code.count("\n") and hidden.count("eval(") == 1
    assert [s["value"] for s in strings] == ["eval(1)", "x"] and strings[1]["line"] == 3


def test_detectors(spark):
    js = """const k = {"api_key": "abcd1234efgh"};
const e = {"token": "changeme-now-1"};
db.query(`select ${x}`);
// TODO later
eval(code); // eval(comment)
const t = "eval(text)";
el.innerHTML = name;
exec("ls " + dir);
// token
const v = Math.random();
const h = crypto.createHash('md5').update(password);
console.log(1); console.log(2);
const id = "550e8400-e29b-41d4-a716-446655440000", s = "q8Zt3Lw0Xn5Rb7Vy2Kc9Hd4M";
"""
    df = files(spark, **{"a.js": js})
    raw = {(r["category"], r["line"]) for r in detect.raw_findings(df).collect()}
    assert raw == {("Hardcoded Secret", 1), ("Hardcoded Secret", 2), ("SQL Injection Risk", 3), ("Unresolved TODO", 4), ("Command Injection Risk", 8)}
    code = {(r["category"], r["line"], r["severity"]) for r in detect.code_findings(lexer.masked(df)).collect()}
    assert code == {("Code Injection Risk", 5, "High"), ("Weak Random Number Generation", 10, "High"), ("Weak Password Hashing", 11, "Critical"), ("Leftover Debug Logging", 12, "Low")}
    assert [r["line"] for r in detect.entropy_findings(lexer.masked(df)).collect()] == [13]


def test_components_routes_models_env(spark):
    df = files(spark, **{
        "a.js": "import x from './b';\nexport function f(a, b) {}\nclass A extends B {}\napp.get('/u/:id', auth, show);\nprocess.env.API_URL; process.env['OTHER']\n",
        "m.py": "import os\nfrom . import sub\nclass User(models.Model):\n    name = models.CharField(max_length=3)\n\n@app.route('/p', methods=['GET', 'POST'])\ndef page():\n    os.environ['HOME_DIR']\n",
        "s.sql": "CREATE TABLE t (\n id INT PRIMARY KEY,\n price DECIMAL(10,2) NOT NULL,\n FOREIGN KEY (id) REFERENCES u(id)\n);",
        "p.prisma": "model Post {\n  id Int @id @default(now())\n  tags String[]\n}\n", "config__routes.rb": "resources :posts\nget '/x', to: 'y#z'\n", "app__page.tsx": "", "app__api__u__route.ts": "export async function GET() {}", "g.go": 'r.GET("/g", handle)\nhttp.HandleFunc("/h", hh)',
    })
    found = rows(extract.components(df), "kind", "name")
    assert {("function", "f"), ("class", "A"), ("import", "./b"), ("export", "f"), ("class", "User"), ("import", "os"), ("import", "."), ("function", "page")} <= set(found)
    r = set(rows(extract.routes(df), "method", "path", "handler"))
    assert {("GET", "/u/:id", "show"), ("GET", "/p", "page"), ("POST", "/p", "page"), ("GET", "/posts/:id/edit", "posts#edit"), ("GET", "/x", "y#z"), ("GET", "/", "(file)"), ("GET", "/api/u", "(file)"), ("GET", "/g", "handle"), ("ANY", "/h", "hh")} <= r
    assert rows(extract.models(df).where("origin = 'sql'"), "field", "type") == [("id", "INT"), ("price", "DECIMAL(10,2)")]
    assert rows(extract.models(df).where("origin in ('django', 'prisma')"), "model", "field", "type") == [("Post", "id", "Int"), ("Post", "tags", "String[]"), ("User", "name", "CharField")]
    assert rows(extract.env_vars(df), "name") == [("API_URL",), ("HOME_DIR",), ("OTHER",)]


def test_import_graph(spark):
    df = files(spark, **{"src__a.js": "", "src__b.ts": "", "src__lib__index.js": "", "pkg__m.py": "", "pkg__sub__x.py": "", "lonely.js": ""})
    imports = spark.createDataFrame([("src/a.js", "./b"), ("src/a.js", "./lib"), ("src/a.js", "./a"), ("src/a.js", "react"), ("pkg/sub/x.py", "pkg.m")], "from_path string, spec string")
    assert rows(graph.edges(imports, df), "from_path", "to_path") == [("pkg/sub/x.py", "pkg/m.py"), ("src/a.js", "src/b.ts"), ("src/a.js", "src/lib/index.js")]
    assert rows(graph.unreferenced(imports, df), "rel_path") == [("lonely.js",), ("pkg/sub/x.py",)]
    calls = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("b", "d", 0), ("d", "e", 0), ("c", "a", 0)], "src string, dst string, ord int")
    got = graph.trace(spark.createDataFrame([("a",)], "start string"), calls, budget=3).orderBy("rn").collect()
    assert [(r["node"], r["depth"]) for r in got] == [("a", 0), ("c", 1), ("b", 1)]


def test_dependencies(spark):
    df = files(spark, **{"package.json": json.dumps({"dependencies": {"lodash": "^4.17.20", "react": "1"}, "devDependencies": {"react": "2"}, "main": "m.js", "scripts": {"start": "node m"}}), "requirements.txt": "flask==1.0 # x\n-r y\ndjango>=2\n", "go.mod": "module m\nrequire github.com/a/b v1.2.3\n", "packages__p__package.json": "{}", "web__package.json": "{}", "bad__package.json": "{"})
    assert rows(manifests.npm_deps(df), "name", "version") == [("lodash", "^4.17.20"), ("react", "2")]
    assert rows(manifests.pip_deps(df), "name", "version") == [("flask", "1.0")] and rows(manifests.go_deps(df), "name", "version") == [("github.com/a/b", "1.2.3")]
    assert rows(manifests.frameworks(df, spark), "framework") == [("Django",), ("Flask",), ("React",)]
    assert rows(manifests.entry_points(df), "entry") == [("m.js",), ("npm start: node m",)] and ("packages/p",) in rows(manifests.sub_packages(df), "package")
    adv = spark.createDataFrame(manifests.ADVISORIES, "name string, fixed string")
    assert rows(manifests.vulnerable(manifests.npm_deps(df), adv), "name") == [("lodash",)]
    lic = spark.createDataFrame([("a", "MIT"), ("b", "(MIT OR GPL-3.0)"), ("c", None), ("d", "Odd"), ("e", "MPL-2.0 AND MIT")], "name string, license string")
    assert rows(manifests.license_findings(lic), "name", "status", "severity") == [("b", "restrictive", "High"), ("c", "missing", "Low"), ("d", "unrecognized", "Low"), ("e", "restrictive", "Medium")]
    own = manifests.owners(df, [("*.json", "@web"), ("/packages/", "@core")])
    assert dict(rows(own, "rel_path", "owner"))["packages/p/package.json"] == "@core"


def test_scan_tree_and_gate(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.js").write_text('const k = {"secret": "abcd1234efgh"};\n')
    (tmp_path / "node_modules/b.js").write_text("eval(1)")
    (tmp_path / "__init__.py").write_text("")
    (tmp_path / "x.png").write_bytes(b"\xff")
    listed = src.listing(spark, str(tmp_path))
    assert rows(listed, "rel_path") == [("__init__.py",), ("src/a.js",)]
    assert rows(src.tree(listed), "path", "level") == [("src", 1)] and rows(src.top_level(spark, str(tmp_path)), "name") == [("__init__.py",), ("src",), ("x.png",)]
    found = cli.scan(spark, str(tmp_path), rules=[("Own", "Low", "const")])
    assert rows(found, "file", "line", "severity") == [("src/a.js", 1, "Critical"), ("src/a.js", 1, "Low")]


def test_bulk_import(spark):
    lines = spark.createDataFrame([("# c",), ("/srv/shop.git/",), ("Shop,/srv/x,prod,Ann,a,b",), ("Bad",), ("Name,,prod",)], "value string")
    good, bad = src.bulk_rows(lines)
    got = {r["path"]: (r["name"], r["tags"]) for r in good.collect()}
    assert got["/srv/shop.git/"] == ("shop", []) and got["/srv/x"] == ("Shop", ["a", "b"]) and rows(bad, "line") == [("Name,,prod",)]


def test_history_properties(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 2)], "scan_id long, previous_id long")
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "c"), (3, "b"), (3, "c")], "scan_id long, fingerprint string")
    assert rows(history.diff(pairs, r, "fingerprint"), "scan_id", "change", "fingerprint") == [(2, "new", "c"), (2, "new", "c"), (2, "resolved", "a")]
    log = spark.createDataFrame([(1, "f", "fixed", None, 1), (1, "f", "open", None, 2), (1, "g", "open", "ann", 1)], "app_id long, fingerprint string, state string, assignee string, updated_at long")
    assert rows(state.upsert(log), "fingerprint", "assignee") == [("g", "ann")]
    with pytest.raises(ValueError):
        state.checked_rule("r", "2030-01-01", "2001-01-01")


def test_cache(spark):
    f = files(spark, **{"a.js": "1", "b.js": "2"})
    cache = incremental.next_cache(f.withColumn("result", F.lit("[]")), "v1")
    assert rows(incremental.split_by_cache(f, cache, "v1"), "hit") == [(True,), (True,)] and rows(incremental.split_by_cache(f, cache, "v2"), "hit") == [(False,), (False,)]
    assert incremental.version_of(["a"], ["s"]) != incremental.version_of(["b"], ["s"])


def test_render(spark):
    pages = spark.createDataFrame([("a.md", "# T\n- x\n- [b](b.md) **y** <i>\n"), ("b.md", "[gone](c.md)")], "path string, content string")
    html = pages.where("path = 'a.md'").select(render.to_html(F.col("content"))).collect()[0][0]
    assert "<h1>T</h1>" in html and '<a href="b.html">b</a>' in html and "&lt;i&gt;" in html and html.count("<ul>") == 1
    assert rows(render.broken_links(pages), "path", "target") == [("b.md", "c.md")]
    e = spark.createDataFrame([("r", "a", "b")], "entry string, src string, dst string")
    assert render.flowchart(e).collect()[0]["text"].startswith("flowchart TD\n")
    i = spark.createDataFrame([(1, "f", k, "High", "c", "s") for k in range(12)], "app_id long, file string, line int, severity string, category string, summary string")
    assert render.webhook_text(i, "High").collect()[0]["text"].endswith("+ 2 more") and render.issue_pages(i).collect()[0]["content"].count("\n") == 14


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.timed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "400 days")
    q = events.tumbling(stream).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(spark.table("t"), "start", "event_type", "n") == rows(want, "start", "event_type", "n")
    seen = []
    events.progress_feed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == batch.count()


def test_schedules(spark):
    a = spark.createDataFrame([(1, 60, "Done", "2001-01-01 00:00:00"), (2, 60, "Scanning", None), (3, 0, "Done", None), (4, 60, None, None), (5, 600, "Done", "2001-01-01 00:30:00")], "app_id long, schedule_minutes int, status string, s string").withColumn("scanned_at", F.col("s").cast("timestamp"))
    assert rows(events.due(a, F.lit("2001-01-01 01:00:00").cast("timestamp")), "app_id") == [(1,), (4,)]


def test_pages_of_components_and_models(spark):
    c = spark.createDataFrame([(1, "src/a.js", "import", "./b", "", 1), (1, "src/a.js", "class", "A", "B", 3), (1, "src/a.js", "function", "f", "x, y", 2), (1, "src/b.js", "export", "z", "", 1), (1, "m.py", "function", "g", "", 1)], "app_id long, rel_path string, kind string, name string, extra string, line int")
    got = {r["path"]: r["content"] for r in pages.component_pages(c).collect()}
    assert set(got) == {"Components/src.md", "Components/root.md"}
    assert got["Components/src.md"] == "# Components: src\n\n## `src/a.js`\n\n**Imports**\n\n`./b`\n\n**Classes**\n\n- `A` of `B` (line 3)\n\n**Functions**\n\n- `f(x, y)` (line 2)\n\n## `src/b.js`\n\n_none found_\n\n"
    fields = spark.createDataFrame([(1, "s.sql", "sql", "T", "id", "INT", 1), (1, "s.sql", "sql", "T", "name", "TEXT", 1), (1, "s.sql", "sql", "T", "z", "INT", 1)], "app_id long, rel_path string, origin string, model string, field string, type string, line int")
    texts = spark.createDataFrame([("T", "id", "the key", "some id"), ("T", "name", None, "a name")], "model string, field string, written string, generated string")
    (page,) = pages.dictionary_pages(fields, texts).collect()
    assert page["path"] == "Data-Dictionary/t.md" and page["content"].endswith("| `id` | INT | the key _(edited)_ |\n| `name` | TEXT | a name _(generated)_ |\n| `z` | INT | — |\n")
    routes = spark.createDataFrame([(2, "GET", "/x", "h", "a.js")], "app_id long, method string, path string, handler string, rel_path string")
    by_app = {r["app_id"]: r["content"] for r in pages.model_pages(fields, routes).collect()}
    assert "| T | sql | `s.sql` | 3 |" in by_app[1] and by_app[1].endswith("## Routes\n\n_none found_\n") and "| GET | `/x` | `h` | `a.js` |" in by_app[2]


def test_change_stream_keeps_the_last_scan(spark, tmp_path):
    schema = "app_id long, scan_id long, scanned_at timestamp, fingerprints array<string>"
    folder = str(tmp_path / "scans")
    for day, found in ((1, ["a", "b"]), (3, ["b", "c", "c"]), (2, ["z"]), (4, None)):
        spark.createDataFrame([(7, day, f"2024-01-0{day} 00:00:00", found), (8, 10 + day, f"2024-01-0{day} 00:00:00", ["k"])], schema.replace("timestamp", "string")).selectExpr("app_id", "scan_id", "cast(scanned_at as timestamp) scanned_at", "fingerprints").coalesce(1).write.mode("append").parquet(folder)
    stream = changes.change_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(spark.table("changes"), "app_id", "scan_id", "new", "resolved", "late")
    assert [r for r in got if r[0] == 7] == [(7, 1, 0, 0, False), (7, 2, 0, 0, True), (7, 3, 2, 1, False), (7, 4, 0, 3, False)]
    assert [r[2:] for r in got if r[0] == 8] == [(0, 0, False), (0, 0, True), (0, 0, False), (0, 0, False)]
