"""Registered queries of extractors, manifests and graphs over projects derived from `part`; their twins parse the same
texts by regular expressions and JSON functions of the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.operators import extract, graph, lexer, metrics
from loomscan.plans.sources import Tree, lines, register
from loomscan.sources import files as src
from loomscan.sources import manifests, stores

CODE = {
    "src/p§k/app.js": """import express from 'express';
import { list, load } from './users';
const app = express();
app.get('/§t/:id', auth('§b'), show);
app.post("/§w", async (req, res) => { if (!req.body) { return res.status(§n).json({}); } try { await load(req.body); res.status(201).json({}); } catch (e) { res.status(500).end(); } });
export function show(req, res) { list(req); §f(); axios.get('/x'); }
function helper() { return process.env.API_§n || process.env['CACHE_§k']; }
""",
    "src/p§k/users.ts": """import { db } from './lib';
export class Users§n extends Base {
}
export const list = async (q) => { return db.find(q); };
export async function load(body) { list(body); store(body); }
function store(body) { deep(body); }
function deep(x) { return x; }
@Entity()
export class Account§n {
  @PrimaryGeneratedColumn()
  id: number;
  @Column({ length: §n })
  §w?: string;
}
""",
    "src/p§k/lib/index.js": "const schema§n = new mongoose.Schema({ title: String, tags: [String], §w: { type: ObjectId, required: true } });\nmodule.exports = { db: require('../§o') };\n",
    "src/p§k/lonely.js": "module.exports = §n;\n",
    "src/p§k/unused.js": "import './unused';\nexport default class Nobody§k {}\n",
    "tool/p§k/main.py": """import os
from tool.p§k.jobs import run
from . import views
TOKEN = os.environ['TOKEN_§n']
class Job§n(Base):
    def work(self, n): pass
class Note§n(models.Model):
    §w = models.CharField(max_length=§n)
    when = models.DateTimeField()

@app.route('/notes§n', methods=['GET', '§r'])
def notes(): return run()
@api.get("/items§n/{id}")
async def item(id): return os.getenv("HOST_§n")
""",
    "tool/p§k/jobs.py": "def run(): pass\n",
    "tool/p§k/views.py": "def page(): pass\n",
    "svc/p§k/main.go": 'package main\nfunc main() { r.GET("/ping§n", ping) }\nfunc (s *Server) Serve§n(port int) {}\ntype Server struct {}\nfunc init() { http.HandleFunc("/h§n", hello) }\n',
    "svc/p§k/Api.java": '@RestController\n@RequestMapping("/§t")\npublic class Api§n {\n  @GetMapping("/§n")\n  public List<Order> orders() { return x; }\n}\nclass Plain§n {\n  @PostMapping("/own§n")\n  public void own() { }\n}\n',
    "web/p§k/routes.php": "<?php\nRoute::get('§t§n', [OrderController::class, 'index']);\n",
    "p§k/config/routes.rb": "resources :§t§n\nget '/about§n', to: 'pages#about'\n",
    "db/p§k/schema.sql": "CREATE TABLE users§n (\n  id INT PRIMARY KEY,\n  §w DECIMAL(10,2) NOT NULL,\n  CONSTRAINT u UNIQUE (id)\n);\ncreate table if not exists notes (body§n text);\n",
    "db/p§k/main.prisma": "model Post§n {\n  id Int @id\n  §w String[]\n}\n",
    "app/p§k/page.tsx": "export default function Page() {}\n",
    "app/(shop)/p§k/[id]/route.ts": "export async function GET() {}\nexport async function §r() {}\n",
    "pages/api/p§k.js": "export default function h() {}\n",
}
MARKS = {
    "§f": "CASE WHEN p_size % 2 = 0 THEN 'helper' ELSE 'gone' END", "§o": "CASE WHEN p_size % 3 = 0 THEN 'lonely' ELSE 'none' END",
    "§r": "CASE WHEN p_size % 2 = 0 THEN 'POST' ELSE 'DELETE' END", "§d": "concat('', p_size % 40)", "§y": "CASE WHEN p_size % 2 = 0 THEN '(MIT OR GPL-3.0)' ELSE 'MIT' END",
}
PROJECT = Tree(CODE, MARKS)
#: Files of an app from its own root: manifests count at certain places only.
ROOT = Tree({
    "package.json": '{"dependencies": {"lodash": "^4.17.§d", "react": "17", "left-pad": "1.0.§n"}, "devDependencies": {"react": "18.2.§n", "express": "~4.17.§d"}, "main": "lib/§w.js", "scripts": {"start": "node §n"}}',
    "packages/§t/package.json": '{"name": "§t"}',
    "apps/x/y/package.json": "{}",
    "bad/package.json": "{not json",
    "node_modules/lodash/package.json": '{"name": "lodash", "version": "4.17.§d", "license": "MIT"}',
    "node_modules/react/package.json": '{"name": "react", "version": "18.2.§n", "license": "§y"}',
    "node_modules/@s/odd/package.json": '{"name": "@s/odd", "version": "1.0.§n", "licenses": [{"type": "MPL-2.0"}, {"type": "MIT"}]}',
    "node_modules/none/package.json": '{"name": "none§n", "version": "0.1.0"}',
    "requirements.txt": "flask==1.§n # web\nDjango[bcrypt] == 4.§d\n-r more.txt\nuvicorn>=§n\n",
    "go.mod": "module x\nrequire github.com/a/§w v1.2.§n\n\tgolang.org/x/net v0.5.§d // indirect\n",
    "main.py": "print(§n)\n",
    "src/lib/§w.js": "x", "src/§t.js": "x", "src/gen/main.py": "x", "web/§b.js": "x", "tool/§t.py": "x", "tool/x/§w.js": "x",
}, MARKS)


def over(name: str, make, sql: str, tree: Tree = PROJECT, *more: str) -> None:
    """A query over a tree's files, and SQL over the tables `code`, `l` (lines) and others."""
    tables = ", ".join([tree.sql(), f"l AS ({lines()})", *more])
    text = f"WITH {tables}{'' if sql.startswith(',') else ' '}{sql}"
    register(name, lambda spark, sf: make(tree.files(spark, sf)), text, f"{name} over source files derived from part.")


def parts(kind: str, where: str):
    return lambda f: extract.components(f.where(where), [kind]).select("rel_path", "name", "line")


def of_line(name: str, pattern: str, where: str, group: int = 1, kind: str = "") -> str:
    """SQL: rows of lines that a pattern meets, its group as the name."""
    return f"SELECT rel_path, {kind}regexp_extract(l, '{pattern}', {group}) AS name, line FROM l WHERE {where} AND regexp_matches(l, '{pattern}')"


JS, SRC = "rel_path rlike '^src/.*[jt]s$'", "regexp_matches(rel_path, '^src/.*[jt]s$')"
FUNCTIONS = "^ *(?:export )?(?:(?:async )?function |const )([A-Za-z]+)(?:[(]| = async [(])"
over("extract_js_functions", parts("function", JS), of_line("", FUNCTIONS, SRC))
over("extract_js_classes", parts("class", JS), of_line("", "^(?:export )?(?:default )?class ([A-Za-z0-9]+)", SRC))
over("extract_js_imports", parts("import", JS), of_line("", "(?:^import |from |require[(])''([^'']+)''", SRC))
over("extract_js_exports", parts("export", JS), of_line("", "^export (?:default )?(?:async )?(?:function|class|const) ([A-Za-z0-9]+)", SRC))
PY = "rel_path LIKE '%.py'"
over(
    "extract_python", lambda f: extract.components(f).where(PY).select("rel_path", "kind", "name", "line"),
    " UNION ALL ".join(of_line("", p, PY, kind=f"'{k}' AS kind, ") for k, p in (
        ("import", "^import ([a-z]+)"), ("import", "^from ([.a-z0-9]+) import"), ("class", "^class ([A-Za-z0-9]+)"), ("function", "^ *(?:async )?def ([a-z]+)[(]"),
    )),
)
over(
    "extract_other_languages", lambda f: extract.components(f).where("rel_path like 'svc/%'").select("rel_path", "kind", "name", "line"),
    " UNION ALL ".join(of_line("", p, "rel_path LIKE 'svc/%'", kind=f"'{k}' AS kind, ") for k, p in (
        ("function", "^func (?:[(][^)]*[)] )?([A-Za-z0-9]+)[(]"), ("class", "^(?:public )?class ([A-Za-z0-9]+)"),
    )),
)
ENV = "SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(content, '(?:process[.]env[.]|process[.]env[[]''|os[.]environ[[]''|getenv[(]\")([A-Z][A-Z0-9_]*)', 1)) AS name FROM code)"
over("extract_env_vars", extract.env_vars, ENV)
over(
    "env_descriptions", lambda f: extract.env_vars(f).select("name", F.coalesce(F.when(F.col("name").startswith("API_"), F.concat(F.lit("service "), F.substring("name", 5, 9))), F.lit("")).alias("description")),
    f"SELECT name, CASE WHEN name LIKE 'API!_%' ESCAPE '!' THEN 'service ' || name[5:] ELSE '' END AS description FROM ({ENV})",
)


def models(name: str, origin: str, path: str, model: str, fields: str, end: str = "$$none") -> None:
    """Models of one file a project: the model's name and its fields are matches in the file's text."""
    over(
        name, lambda f: extract.models(f, [origin]).select("rel_path", "model", "field", "type"),
        f"""SELECT rel_path, regexp_extract(t, '{model}', 1) AS model, regexp_extract(x, '{fields}', 1) AS field, regexp_extract(x, '{fields}', 2) AS type
FROM (SELECT rel_path, t, unnest(regexp_extract_all(substr(t, strpos(t, regexp_extract(t, '{model}')) + len(regexp_extract(t, '{model}'))), '{fields}')) AS x
  FROM (SELECT rel_path, unnest(string_split(content, '{end}')) AS t FROM code WHERE rel_path LIKE '{path}') WHERE regexp_matches(t, '{model}'))""",
    )


models("extract_sql_tables", "sql", "db/%.sql", "(?i)create table (?:if not exists )?([a-z0-9]+) [(]", "(?:^|\n) *([a-z0-9_]+) (INT|DECIMAL[(]10,2[)]|text)", ");\n")
models("extract_prisma", "prisma", "db/%.prisma", "model ([A-Za-z0-9]+) [{]", "\n  ([a-z_]+) ([A-Z][a-z]+(?:\\[\\])?)")
models("extract_mongoose", "mongoose", "src/%/lib/index.js", "const ([a-z0-9]+) = new mongoose", "([a-z_]+): (?:[{] type: |\\[)?([A-Z][A-Za-z]+)")
models("extract_django", "django", "tool/%/main.py", "class ([A-Za-z0-9]+)[(]models[.]Model[)]:", "\n    ([a-z_]+) = models[.]([A-Za-z]+)")
models("extract_typeorm", "typeorm", "src/%/users.ts", "@Entity[(][)]\nexport class ([A-Za-z0-9]+)", "[)]\n  ([a-z_]+)[?]?: ([a-z]+);")


def routes(name: str, where: str, sql: str, found=extract.routes) -> None:
    over(name, lambda f: found(f).where(where).select("rel_path", "method", "path", "handler", "line"), sql)


def routed(pattern: str, where: str, method: str, path: str, handler: str, source: str = "l", line: str = "line") -> str:
    """SQL: routes of lines that a pattern meets; its groups are named by $1, $2 ..."""
    fill = lambda t: "".join(f"regexp_extract(l, '{pattern}', {x[0]}){x[1:]}" if i else x for i, x in enumerate(t.split("$")))
    return f"SELECT rel_path, {fill(method)} AS method, {fill(path)} AS path, {fill(handler)} AS handler, {line} AS line FROM {source} WHERE {where} AND regexp_matches(l, '{pattern}')"


routes(
    "extract_express", "rel_path like 'src/%'",
    routed("app[.]([a-z]+)[(][''\"](/[^''\"]+)[''\"], (?:auth[(][^)]*[)], )?([a-z]+)", "rel_path LIKE 'src/%'", "upper($1)", "$2", "CASE WHEN $3 = 'async' THEN '(inline)' ELSE $3 END"),
)
routes(
    "extract_flask", "path like '/notes%'",
    " UNION ALL ".join(routed("app[.]route[(]''([^'']+)'', methods=[[]''([A-Z]+)'', ''([A-Z]+)", "rel_path LIKE 'tool/%'", m, "$1", "'notes'") for m in ("$2", "$3")),
)
routes("extract_fastapi", "path like '/items%'", routed("@api[.]([a-z]+)[(]\"([^\"]+)\"", "rel_path LIKE 'tool/%'", "upper($1)", "$2", "'item'"))
routes(
    "extract_go_routes", "rel_path like 'svc/%.go'",
    routed("r[.]GET[(]\"([^\"]+)\", ([a-z]+)", "rel_path LIKE 'svc/%'", "'GET'", "$1", "$2") + " UNION ALL " + routed("HandleFunc[(]\"([^\"]+)\", ([a-z]+)", "rel_path LIKE 'svc/%'", "'ANY'", "$1", "$2"),
)
SEVEN = "(VALUES ('index', 'GET', ''), ('new', 'GET', '/new'), ('create', 'POST', ''), ('show', 'GET', '/:id'), ('edit', 'GET', '/:id/edit'), ('update', 'PATCH', '/:id'), ('destroy', 'DELETE', '/:id')) AS seven(action, verb, suffix)"
routes(
    "extract_rails", "rel_path like '%config/routes.rb'",
    routed("^resources :([a-z0-9]+)", "rel_path LIKE '%.rb'", "verb", "'/' || $1 || suffix", "$1 || '#' || action", f"l CROSS JOIN {SEVEN}")
    + " UNION ALL " + routed("^get ''([^'']+)'', to: ''([^'']+)''", "rel_path LIKE '%.rb'", "'GET'", "$1", "$2"),
)
routes(
    "extract_spring", "rel_path like 'svc/%.java'",
    """SELECT rel_path, upper(regexp_extract(l, '@([A-Z][a-z]+)Mapping', 1)) AS method,
  CASE WHEN contains(l, 'Get') THEN regexp_extract(content, '@RequestMapping[(]"([^"]+)"', 1) ELSE '' END || regexp_extract(l, 'Mapping[(]"([^"]+)"', 1) AS path,
  CASE WHEN contains(l, 'Get') THEN 'orders' ELSE 'own' END AS handler, line
FROM l JOIN code USING (app_id, rel_path) WHERE regexp_matches(l, '@(Get|Post)Mapping')""",
)
routes("extract_laravel", "rel_path like 'web/%'", routed("Route::get[(]''([^'']+)'', [[]OrderController::class, ''([a-z]+)''", "rel_path LIKE 'web/%'", "'GET'", "'/' || $1", "$2"))
routes(
    "extract_next", "handler = '(file)'",
    """SELECT rel_path, 'GET' AS method, '/p' || app_id AS path, '(file)' AS handler, 1 AS line FROM code WHERE rel_path LIKE 'app/%/page.tsx'
UNION ALL SELECT rel_path, regexp_extract(l, 'function ([A-Z]+)', 1), '/p' || app_id || '/:id', '(file)', 1 FROM l WHERE rel_path LIKE 'app/%/route.ts' AND l <> ''
UNION ALL SELECT rel_path, 'ANY', '/api/p' || app_id, '(file)', 1 FROM code WHERE rel_path LIKE 'pages/%'""", extract.next_routes,
)


def imports(f: DataFrame) -> DataFrame:
    return extract.components(f, ["import"]).select(F.col("rel_path").alias("from_path"), F.col("name").alias("spec"))


#: SQL: imports of files, the paths that they may mean, and the first that exists.
IMPORTS = """spec AS (SELECT rel_path, line, unnest(regexp_extract_all(l, '(?:^import |from |require[(])''([^'']+)''', 1)) AS s FROM l WHERE rel_path NOT LIKE '%.py'
  UNION ALL SELECT rel_path, line, regexp_extract(l, '^(?:from|import) ([.a-z0-9]+)', 1) FROM l WHERE rel_path LIKE '%.py' AND regexp_matches(l, '^(from|import) ')),
folder AS (SELECT *, regexp_replace(rel_path, '[^/]*$', '') AS f FROM spec),
base AS (SELECT rel_path, line, s, CASE WHEN rel_path LIKE '%.py' THEN CASE WHEN s = '.' THEN rtrim(f, '/') WHEN s LIKE '.%' THEN f || replace(ltrim(s, '.'), '.', '/') ELSE replace(s, '.', '/') END
  WHEN s LIKE './%' THEN f || s[3:] WHEN s LIKE '../%' THEN regexp_replace(f, '[^/]*/$', '') || s[4:] END AS b FROM folder)"""
MEANT = """meant AS (SELECT rel_path, line, s, i, b || x AS target FROM base, (SELECT unnest(['', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs', '.py', '/index.js', '/index.ts', '/__init__.py']) AS x, unnest(range(11)) AS i) WHERE b IS NOT NULL),
edge AS (SELECT rel_path AS from_path, arg_min(m.target, i) AS to_path, min(m.line) AS line FROM meant m WHERE m.target IN (SELECT c.rel_path FROM code c) GROUP BY rel_path, s)"""
over("graph_edges", lambda f: graph.edges(imports(f), f).select("from_path", "to_path"), "SELECT DISTINCT from_path, to_path FROM edge WHERE from_path <> to_path", PROJECT, IMPORTS, MEANT)
over(
    "graph_dead_code", lambda f: graph.unreferenced(imports(f), f.where("rel_path rlike '^(src|tool)/.*'"), graph.entry_like(F.col("rel_path"), ["main.py", "app.js"])).select("rel_path"),
    "SELECT rel_path FROM code WHERE regexp_matches(rel_path, '^(src|tool)/') AND NOT regexp_matches(rel_path, '/(main[.]py|app[.]js)$') AND rel_path NOT IN (SELECT m.target FROM meant m)", PROJECT, IMPORTS, MEANT,
)
over(
    "graph_degrees",
    lambda f: extract.components(f.where("rel_path like 'src/%'"), ["function", "class"]).groupBy("rel_path").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes")),
    f"""SELECT rel_path, count(*) FILTER (WHERE regexp_matches(l, '{FUNCTIONS}')) AS functions, count(*) FILTER (WHERE regexp_matches(l, '^(export )?(default )?class ')) AS classes
FROM l WHERE rel_path LIKE 'src/%' GROUP BY 1 HAVING functions + classes > 0""",
)


def call_graph(f: DataFrame) -> DataFrame:
    facts = stores.cut(extract.components(f, ["function", "import"]).select("rel_path", "kind", "name"), "components")  # read twice, parsed once
    found = facts.where("kind = 'import'").select(F.col("rel_path").alias("from_path"), F.col("name").alias("spec"))
    return metrics.resolved(metrics.calls(metrics.functions_of(f)), facts.where("kind = 'function'"), graph.edges(found, f))


#: SQL: functions, each on a line of its own, the names called in their bodies, and where these lead.
CALLS = r"""fn AS (SELECT rel_path, CASE WHEN l LIKE 'app.post%' THEN '(anonymous)' ELSE regexp_extract(l, '(?:function|const) ([a-z]+)', 1) END AS name, regexp_replace(l, '^.*?[)] (=> )?[{]', '') AS body
  FROM l WHERE rel_path LIKE 'src/%' AND regexp_matches(l, '^(export )?(async )?function [a-z]+[(]|^export const|^app.post')),
called AS (SELECT DISTINCT rel_path, name, unnest(regexp_extract_all(body, '(?:^|[^.a-z])([a-z]+)[(]', 1)) AS callee FROM fn),
led AS (SELECT c.*, coalesce((SELECT any_value(k.rel_path) FROM fn k WHERE k.rel_path = c.rel_path AND k.name = c.callee), (SELECT min(k.rel_path) FROM fn k JOIN edge e ON e.to_path = k.rel_path WHERE e.from_path = c.rel_path AND k.name = c.callee)) AS place FROM called c)"""
over("call_resolution", lambda f: call_graph(f).select("src", "dst").distinct(), "SELECT rel_path || '#' || name AS src, place || '#' || callee AS dst FROM led WHERE place IS NOT NULL", PROJECT, IMPORTS, MEANT, CALLS)


def traced(f: DataFrame) -> DataFrame:
    starts = f.where("rel_path like 'src/%app.js'").select(F.concat("rel_path", F.lit("#(anonymous)")).alias("start"))
    return graph.trace(starts, call_graph(f), hops=2, budget=3).select("start", "node", "depth", "rn")


over(
    "entry_trace", traced,
    """, step AS (SELECT DISTINCT rel_path || '#' || name AS src, place || '#' || callee AS dst FROM led WHERE place IS NOT NULL),
one AS (SELECT src AS start, dst FROM step WHERE src LIKE '%app.js#(anonymous)'), two AS (SELECT start, s.dst FROM one JOIN step s ON s.src = one.dst)
SELECT start, start AS node, 0 AS depth, 1 AS rn FROM one UNION SELECT start, dst, 1, 2 FROM one UNION ALL SELECT start, min(dst), 2, 3 FROM two GROUP BY start""", PROJECT, IMPORTS, MEANT, CALLS,
)


def handlers(f: DataFrame) -> DataFrame:
    return extract.route_calls(extract.routes(f), metrics.blocks_of(f)).where("rel_path like 'src/%'").select("rel_path", "method", "path", "name", "line")


over(
    "route_handlers", handlers,
    """SELECT r.rel_path, upper(regexp_extract(r.l, '^app[.]([a-z]+)', 1)) AS method, regexp_extract(r.l, '[(][''"]([^''"]+)', 1) AS path,
  CASE WHEN r.l LIKE '%async%' THEN '(anonymous)' ELSE 'show' END AS name, CASE WHEN r.l LIKE '%async%' THEN r.line ELSE h.line END AS line
FROM l r JOIN l h ON h.rel_path = r.rel_path AND h.l LIKE 'export function show%' WHERE regexp_matches(r.l, '^app[.](get|post)')""",
)
over(
    "handler_steps",
    lambda f: metrics.steps(metrics.body_trace(metrics.blocks_of(f))).where("rel_path like 'src/%app.js' and responds").select("rel_path", "name", F.array_join("steps", "; ").alias("steps")),
    r"""SELECT rel_path, '(anonymous)' AS name, len(regexp_extract_all(l, '\bif\b')) || ' branch; handles errors'
  || CASE WHEN len(s) > 0 THEN '; answers ' || array_to_string(list_sort(list_distinct(s)), ', ') ELSE '' END AS steps
FROM (SELECT *, regexp_extract_all(l, 'status[(]([0-9][0-9][0-9])', 1) AS s FROM l WHERE l LIKE 'app.post%')""",
)
LEXED = Tree({"p§k/a.js": "x = /['\"]/; // y§n\n`a${§n}` + 'c§w' / 2 / §n;", "p§k/b.py": "x = '#§n' # c\n\"\"\"§w\ne\"\"\" + f§n"})
over(
    "lexer_masked", lambda f: lexer.masked(f).select("rel_path", "masked"),
    r"""SELECT rel_path, string_agg(CASE WHEN ext = '.js' AND line = 1 THEN 'x =       ;' || repeat(' ', len(l) - 11) WHEN ext = '.js' THEN repeat(' ', strpos(l, '+') - 1) || '+' || repeat(' ', strpos(l, ' /') - strpos(l, '+') - 1) || l[strpos(l, ' /') :]
  WHEN line = 1 THEN 'x =' || repeat(' ', len(l) - 3) WHEN line = 2 THEN repeat(' ', len(l)) ELSE repeat(' ', 4) || l[5:] END, chr(10) ORDER BY line) AS masked
FROM (SELECT rel_path, CASE WHEN rel_path LIKE '%.js' THEN '.js' ELSE '.py' END AS ext, l, line FROM l) GROUP BY rel_path""", LEXED,
)

J = "json_extract_string(content, '$.{0}')"
ROOTED = "rel_path = 'package.json'"
DEPS = f"""dep AS (SELECT app_id, rel_path, name, arg_max(version, kind) AS version FROM (
  SELECT app_id, rel_path, unnest(json_keys(content, '$.dependencies')) AS name, json_extract_string(content, '$.dependencies.' || unnest(json_keys(content, '$.dependencies'))) AS version, 0 AS kind FROM code WHERE {ROOTED}
  UNION ALL SELECT app_id, rel_path, unnest(json_keys(content, '$.devDependencies')), json_extract_string(content, '$.devDependencies.' || unnest(json_keys(content, '$.devDependencies'))), 1 FROM code WHERE {ROOTED}) GROUP BY 1, 2, 3)"""
HAVE = """have AS (SELECT app_id, json_extract_string(content, '$.name') AS name, json_extract_string(content, '$.version') AS version,
  coalesce(json_extract_string(content, '$.license'), array_to_string(list_transform(json_extract(content, '$.licenses')::json[], lambda x: json_extract_string(x, '$.type')), ' OR ')) AS license FROM code WHERE rel_path LIKE 'node_modules/%')"""
PIP = "pip AS (SELECT app_id, regexp_extract(l, '^([A-Za-z0-9]+)', 1) AS name, regexp_extract(l, '== ?([0-9.]+)', 1) AS version FROM l WHERE rel_path = 'requirements.txt' AND contains(l, '=='))"


def rooted(name: str, make, sql: str, *more: str) -> None:
    over(name, make, sql, ROOT, *more)


def spark_of(f: DataFrame) -> SparkSession:
    return f.sparkSession


rooted(
    "manifest_files", lambda f: manifests.manifests(f, spark_of(f)).select("app_id", "rel_path", "ecosystem"),
    "SELECT app_id, rel_path, CASE rel_path WHEN 'package.json' THEN 'Node.js' WHEN 'go.mod' THEN 'Go' ELSE 'Python' END AS ecosystem FROM code WHERE rel_path IN ('package.json', 'go.mod', 'requirements.txt')",
)
rooted(
    "manifest_frameworks", lambda f: manifests.frameworks(f, spark_of(f)),
    """SELECT DISTINCT app_id, CASE lower(name) WHEN 'react' THEN 'React' WHEN 'express' THEN 'Express' WHEN 'flask' THEN 'Flask' WHEN 'django' THEN 'Django' END AS framework
FROM (SELECT app_id, name FROM dep UNION ALL SELECT app_id, name FROM pip) WHERE lower(name) IN ('react', 'express', 'flask', 'django')""", DEPS, PIP,
)
rooted(
    "manifest_entries", manifests.entry_points,
    f"SELECT app_id, rel_path AS entry FROM code WHERE rel_path = 'main.py' UNION SELECT app_id, {J.format('main')} FROM code WHERE {ROOTED} UNION SELECT app_id, 'npm start: ' || {J.format('scripts.start')} FROM code WHERE {ROOTED}",
)
rooted("manifest_packages", manifests.sub_packages, "SELECT app_id, regexp_replace(rel_path, '/package.json$', '') AS package FROM code WHERE regexp_matches(rel_path, '^([^/]+|packages/[^/]+)/package.json$')")
rooted("npm_declared", manifests.npm_deps, "SELECT * FROM dep", DEPS)
rooted("npm_installed", manifests.installed_versions, "SELECT app_id, name, dep.version AS declared, have.version FROM dep JOIN have USING (app_id, name)", DEPS, HAVE)
rooted("pip_pinned", lambda f: manifests.pip_deps(f).select("app_id", "name", "version"), "SELECT * FROM pip", PIP)
rooted(
    "go_required", lambda f: manifests.go_deps(f).select("app_id", "name", "version"),
    "SELECT app_id, regexp_extract(l, '([^ \t]+[.][a-z]+/[^ ]+) v', 1) AS name, regexp_extract(l, ' v([0-9.]+)', 1) AS version FROM l WHERE rel_path = 'go.mod' AND contains(l, ' v')",
)
rooted(
    "dependency_findings", lambda f: manifests.advisory_findings(f, spark_of(f)).select("app_id", "file", "line", "severity", "category", "source", "summary"),
    """SELECT app_id, rel_path AS file, 1 AS line, 'High' AS severity, 'Outdated/Vulnerable Dependency' AS category, 'dependency-audit' AS source, name || '@' || version || ' is below ' || fixed AS summary
FROM dep JOIN (VALUES ('lodash', '4.17.21'), ('express', '4.17.3')) AS adv(name, fixed) USING (name) WHERE regexp_extract(version, '([0-9]+)$', 1)::int < regexp_extract(fixed, '([0-9]+)$', 1)::int""", DEPS,
)
rooted(
    "license_issues", lambda f: manifests.license_issues(f).select("app_id", "severity", "category", "source", "summary"),
    """SELECT app_id, CASE WHEN license IS NULL THEN 'Low' WHEN contains(license, 'GPL') THEN 'High' ELSE 'Medium' END AS severity, 'License Compliance' AS category, 'dependency-audit' AS source,
  name || CASE WHEN license IS NULL THEN ': no licence' ELSE ': restrictive licence ' || license END AS summary FROM have WHERE license IS NULL OR regexp_matches(license, 'GPL|MPL')""", HAVE,
)
rooted(
    "file_tree_filter", lambda f: src.visible(f, ["src/lib/**"], "*.py\n!main.py\n/web\n").where("rel_path rlike '^(src|tool|web|main)'").select("app_id", "rel_path"),
    """SELECT app_id, rel_path FROM code WHERE regexp_matches(rel_path, '^(src|tool|web|main)') AND rel_path NOT LIKE 'src/lib/%' AND rel_path NOT LIKE 'web/%'
AND NOT (rel_path LIKE '%.py' AND NOT regexp_matches(rel_path, '(^|/)main[.]py$'))""",
)
rooted(
    "code_owners", lambda f: manifests.owners(f.where("rel_path like '%.py' or rel_path like 'tool/%'"), [("*.py", "@py"), ("/tool/", "@tool")]).select("app_id", "rel_path", "owner", "origin"),
    "SELECT app_id, rel_path, CASE WHEN rel_path LIKE 'tool/%' THEN '@tool' ELSE '@py' END AS owner, 'rule' AS origin FROM code WHERE rel_path LIKE '%.py' OR rel_path LIKE 'tool/%'",
)

#: An audit report of each part: as many packages as its size, severities in turn; every seventh part has none.
AUDIT = """CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('{"vulnerabilities": {', array_join(transform(sequence(1, p_size), i ->
  concat('"p', lpad(concat('', i), 2, '0'), '": {"severity": "', element_at(array('low', 'moderate', 'high', 'critical'), 1 + i % 4), '", "range": "<', i, '"}')), ', '), '}}') END"""


def audits(spark: SparkSession, sf: str) -> DataFrame:
    reports = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("app_id"), F.lit("npm").alias("tool"), F.expr(AUDIT).alias("report"))
    return manifests.audit_findings(reports).groupBy("app_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.min("summary").alias("first"))


register(
    "audit_findings", audits,
    """WITH v AS (SELECT p_partkey AS app_id, p_size, unnest(range(1, p_size + 1)) AS i FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT app_id, ['Low', 'Medium', 'High', 'Critical'][1 + i % 4] AS severity, 'Outdated/Vulnerable Dependency' AS category, 'p' || lpad(i::varchar, 2, '0') || ' <' || i AS summary FROM v WHERE i <= 30
UNION ALL SELECT DISTINCT app_id, 'Low', 'Outdated/Vulnerable Dependency', (p_size - 30) || ' more advisories' FROM v WHERE p_size > 30
UNION ALL SELECT p_partkey, 'Low', 'Scan Limitation', 'npm: not available' FROM part WHERE p_partkey % 7 = 0)
SELECT app_id, severity, category, count(*) AS n, min(summary) AS first FROM r GROUP BY ALL""",
    "Findings of audit reports: the first 30 rows of a report, and one that counts the rest.",
)
