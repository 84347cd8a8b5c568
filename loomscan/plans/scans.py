"""Registered queries of the detectors over source files derived from `part`, each with a twin that parses the same
texts by regular expressions written for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.operators import detect, lexer, metrics
from loomscan.plans.portfolio import SQL
from loomscan.plans.sources import Tree, lines, matches, quoted, register

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
GIT = "ghp_" + "0123456789abcdefghijklmnopqrstuvwxyzAB"
SLACK = "xoxb-" + "1234567890-abcdef"
BLOCK = "-----BEGIN " + "RSA PRIVATE KEY-----"

#: Path and text of each file of an app.
TEMPLATES = {
    "p§k/keys.js": f"""const a = {{"api_key": "abcd§k_efgh", 'password': 'changeme'}};
const b = {{"password": "§w"}};
const c = {{"aws_secret_key": "wJalrXUtnFEMI1K7"}}; const d = {{"token": "${{env.TOKEN}}"}};
const e = '§A9'; const f = "§G";
const g = `§S`;
const h = "§P";
const i = "POSTGRES://user:pass@db§k.example.com/x"; const j = "mysql://localhost/db";
const k = {{"Secret-Key": "process.env.SECRET_VALUE", "secret_key": "q1w2e3r4t5"}};
""",
    "p§k/strings.ts": """const id = "550E8400-e29b-41d4-a716-446655440000";
const s = "q8Zt3Lw0Xn§kRb7Vy2Kc9Hd4M";
const p = "/usr/q8Zt3Lw0Xn5Rb7Vy2Kc9Hd4M"; const b64 = 'q8Zt/3Lw0X/n5Rb7Vy+2Kc9Hd4M==';
const t = {"token": "Zq8Zt3Lw0Xn5Rb7Vy2Kc9Hd4M"};
// "q8Zt3Lw0Xn5Rb7Vy2Kc9Hd4M"
const low = "aaaaaaaaaaaaaaaaaaaa§k";
""",
    "p§k/inject.js": """db.query(`select * from t where §w = ${id}`);
db.execute("select " +
  name);
db.query("select 1"); conn.query(sql);
el.innerHTML = `<b>${escapeHtml(name)}</b> ${rows.§l} ${§n}`;
el.innerHTML = `<b>${name}</b>`; el.innerHTML = "<i>" + x;
el.innerHTML = value; el.innerHTML = `<b>${safe({a: {b: 1}})}</b>`;
<div dangerouslySetInnerHTML={{__html: body}} /> <p dangerouslySetInnerHTML={{ __html: '<b>x</b>' }} />
child_process.exec("§w " + dir); execSync(`rm ${f}`); execFile("ls", [dir]); exec("ls");
""",
    "p§k/code.js": """§e(code); obj.eval (x); // eval(comment)
const t = "eval(text)"; const r = /eval(x)/;
const f = new Function ("return 1"); medieval(1);
function sessionId() {
  const seed = §n;
  return Math.random();
}
const §c = 1;
const x1 = 1;
const x2 = 2;
const x3 = 3;
const x4 = 4;
const shade = Math.random(); const note = "Math.random()";
crypto.createHash('§h').update(§x);
crypto.createHash( "SHA1" ).digest(); crypto.createHash('sha256');
const doc = "use createHash('md5') here"; // createHash('md5')
console.§d(1); console.debug(2); // console.log(3)
console.info(4);
// §T first thing
//FIXME: second; // HACK third
// TODOS no, and todo no
""",
    "p§k/quiet.go": "package main\n// XXX here\nfunc main() { fmt.Println(\"console.log(1)\") }\n",
    "p§k/paged.js": """for (const u of await db.user.findMany({ where: {§g} })) {
}
for (const u of await db.user.findMany({ take: 10 })) { }
for (let v of users.findAll()) {}
for (const w of list) { first(w); }
""",
    "p§k/loops.js": """async function load(ids) {
  for (const id of ids) { §q }
  ids.forEach((x) => { db.§m(x); });
  for (const id of ids) { later(() => { db.query(id); }); }
  while (more) { step(); }
}
""",
    "p§k/effects.jsx": """function A() {
  useEffect(() => { const t = setInterval(f, §n); §u }, []);
  useEffect(() => { window.addEventListener('x', f); §v });
  useEffect(() => { load(); return 1; });
}
""",
    "p§k/branches.js": "const pick = (x) => {\n§B};\n",
    "p§k/deep.js": "function deep(a) {\n§D§E\n}\n",
    "p§k/long.ts": "function longest() {\n§L}\n",
}
case = lambda cond, yes, no: f"CASE WHEN {cond} THEN '{yes}' ELSE '{no}' END"
MARKS = {
    "§A": case("p_size % 3 = 0", KEY, "none"), "§G": case("p_size % 4 = 0", GIT, "none"), "§S": case("p_size % 5 = 0", SLACK, "none"), "§P": case("p_size % 2 = 0", BLOCK, "none"),
    "§l": case("p_size % 2 = 0", "length", "name"), "§e": case("p_size % 2 = 0", "eval", "evil"), "§c": case("p_size % 2 = 0", "token", "colour"), "§h": case("p_size % 3 = 0", "md5", "sha512"),
    "§x": case("p_size % 2 = 0", "password", "text"), "§d": case("p_size % 2 = 0", "log", "warn"), "§T": case("p_size % 3 = 1", "TODO", "Note"), "§g": case("p_size % 2 = 0", " take: 5 ", ""),
    "§q": case("p_size % 2 = 0", "await db.user.findOne(id);", "use(id);"), "§m": case("p_size % 3 = 0", "query", "write"),
    "§u": case("p_size % 2 = 0", "return () => clearInterval(t);", ""), "§v": case("p_size % 3 = 0", "return () => window.removeEventListener(0);", ""),
    "§B": "repeat(concat('  if (x && y) { f(); }', chr(10)), p_size % 9)", "§D": "repeat('if (a) { ', p_size % 9)", "§E": "repeat('} ', p_size % 9)", "§L": "repeat(concat('  go();', chr(10)), p_size * 4)",
}
TREE = Tree(TEMPLATES, MARKS)


#: SQL that hides comments and literals that do not span lines.
HIDDEN = r"""regexp_replace(content, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\\n]|\\.)*`|//[^\n]*|= /(?:[^/\n])+/', ' ', 'g')"""


SHOWN = ["file", "line", "category", "severity"]


def live(files: DataFrame, category: str) -> DataFrame:
    """Findings of a category on live code; files that cannot have any are read, but not lexed."""
    return detect.code_findings(lexer.masked(files.where(detect.may_have(category))), [category])


def rule(name: str, id_: str, pattern: str, keep: str = "true", text: str = "content") -> None:
    """A rule of the detectors, and its twin."""
    r = next(x for x in detect.RAW_RULES + detect.CODE_RULES if x.id == id_)
    raw = r in detect.RAW_RULES

    def make(spark: SparkSession, sf: str) -> DataFrame:
        own = TREE.files(spark, sf)
        found = detect.raw_findings(own, [r]) if raw else live(own, r.category).where((F.col("category") == r.category) & (F.col("severity") == r.severity))
        return found.select(*SHOWN)

    sql = f"WITH {TREE.sql()} SELECT rel_path AS file, line, {quoted(r.category)} AS category, {quoted(r.severity)} AS severity FROM ({matches(pattern, text)}) WHERE {keep}"
    register(name, make, sql, f"{r.category}: rule {r.id}.")


CREDENTIAL = r"""(?i)["'](aws_?access_?key|aws_?secret_?key|api[-_]?key|secret[-_]?key|secret|passwd|password|auth[-_]?token|token|private[-_]?key)["']\s*(:|=)\s*["'][^"']{8,}["']"""
VALUE = r"""regexp_extract(m, '["''][^"'']*["''][^"'']*["'']([^"'']*)["'']', 1)"""
rule(
    "scan_credentials", "D1", CREDENTIAL,
    f"lower({VALUE}) NOT IN ('changeme', 'xxxxxxxx', 'your_api_key', 'placeholder', 'example', 'test', 'dummy', 'todo', 'secret', 'password', 'yourpassword') AND NOT contains({VALUE}, 'process.env') AND NOT contains({VALUE}, '${{')",
)
rule("scan_cloud_keys", "D2", "AKIA([A-Z]|[0-9]){16}")
rule("scan_private_keys", "D3", "-----BEGIN ((RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----")
rule("scan_chat_tokens", "D4", r"\bxox[abprs]-[-A-Za-z0-9]{10,}")
rule("scan_forge_tokens", "D5", r"\bgh[oprsu]_[A-Za-z0-9]{36,}")
rule("scan_connection_strings", "D6", r"""(?i)\b(postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp)://[^\s:/'"]+:[^\s/@'"]+@[^\s/'"]+""")
#: SQL: a template of whose values one is no number, length or escaped text, or text put together with a plus.
UNSAFE = r"""(NOT regexp_matches(m, '^[^=]*=\s*`') OR len(list_filter(regexp_extract_all(m, '\$\{([^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*)\}', 1),
  lambda v: NOT regexp_matches(trim(v), '(?i)^[\w.]*\b(escape|sanitize|purify|encode)\w*\s*\(') AND NOT regexp_matches(trim(v), '^[0-9]+$|^[\w.]+\.(length|count|size|line|lineNo|lineNumber|column|col|index|idx|row)$'))) > 0
  OR len(regexp_extract_all(m, '\$\{([^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*)\}', 1)) = 0)"""
PARTS = r"""(`[^`]*\$\{[^`]*\}[^`]*`|["'][^"']*["']\s*\+)"""
rule("scan_sql_injection", "D8", r"\.(execute|query)\(\s*" + PARTS)
rule("scan_eval", "D9", r"\beval\s*\(", text=HIDDEN)
rule("scan_function_constructor", "D10", r"new\s+Function\s*\(", text=HIDDEN)
rule("scan_inner_html", "D11", r"\.innerHTML\s*=\s*" + PARTS, UNSAFE)
rule("scan_dangerous_html", "D12", r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*[^}]+\}\}", r"NOT regexp_matches(m, '__html\s*:\s*''[^'']*''\s*\}')")
rule("scan_command_injection", "D13", r"\b(exec|execSync)\(\s*" + PARTS)
rule("scan_todos", "D17", r"//\s*(TODO|FIXME|HACK|XXX)\b[^\n]*")
rule(
    "scan_unpaged_loops", "D22", r"for\s*\(\s*(const|let|var)\s+\w+\s+of\s+(await\s+)?(?s:.*?)\)\s*\{",
    r"regexp_matches(m, '\.(findMany|findFirst|findUnique|findById|findOne|findAll|query|execute|aggregate)\s*\(') AND NOT regexp_matches(m, '(?i)\b(take|limit|first|pageSize)\b')",
)


def code_category(name: str, category: str, sql: str) -> None:
    register(name, lambda spark, sf: live(TREE.files(spark, sf), category).select(*SHOWN), sql, f"{category}.")


code_category(
    "scan_weak_random", "Weak Random Number Generation",
    f"""WITH {TREE.sql()} SELECT rel_path AS file, line, 'Weak Random Number Generation' AS category, 'High' AS severity FROM ({matches(r"Math\.random\(\)", HIDDEN)})
WHERE regexp_matches(array_to_string(string_split(content, chr(10))[greatest(line - 5, 1) : line], ' '), '(?i)token|session|password|secret|csrf|nonce|otp|api[_-]?key|auth')""",
)
CALL = r"""createHash\(\s*('(md5|sha1)'|"(md5|sha1)")"""
code_category(
    "scan_weak_hash", "Weak Password Hashing",
    f"""WITH {TREE.sql()}, code2 AS (SELECT app_id, rel_path, regexp_replace(regexp_replace(content, '"[^"\\n]*createHash[^"\\n]*"', ' ', 'g'), '//[^\\n]*', ' ', 'g') AS content FROM code)
SELECT rel_path AS file, line, 'Weak Password Hashing' AS category, CASE WHEN regexp_matches(string_split(content, chr(10))[line], '(?i)password|passwd|credential') THEN 'Critical' ELSE 'Medium' END AS severity
FROM ({matches("(?i)" + CALL, source="code2")})""",
)
code_category(
    "scan_debug_logging", "Leftover Debug Logging",
    f"WITH {TREE.sql()} SELECT rel_path AS file, min(line) AS line, 'Leftover Debug Logging' AS category, 'Low' AS severity FROM ({matches(r'console.(log|debug)[(]', HIDDEN)}) GROUP BY 1",
)

LITERAL = r"""["']([^"'\n]*)["']"""
register(
    "scan_entropy", lambda spark, sf: detect.entropy_findings(lexer.masked(TREE.files(spark, sf).where(F.col("content").rlike(detect.LITERAL)))).select(*SHOWN),
    f"""WITH {TREE.sql()}, s AS (SELECT rel_path, line, m[2:-2] AS v FROM ({matches(LITERAL, "regexp_replace(content, '//[^" + chr(92) + "n]*', ' ', 'g')", "rel_path LIKE '%/strings.ts'")})),
keyed AS (SELECT rel_path, line FROM ({matches(CREDENTIAL, where="rel_path LIKE '%/strings.ts'")})),
c AS (SELECT DISTINCT rel_path, line, v FROM s WHERE len(v) BETWEEN 20 AND 200 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '\\s|^(https?://|/|\\./|\\.\\./)')
  AND NOT regexp_matches(v, '(?i)^(c[0-9a-z]{{24}}|[0-9a-f]{{24}}|[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})$|^[A-Za-z0-9_-]{{21}}$') AND (rel_path, line) NOT IN (SELECT (rel_path, line) FROM keyed)),
p AS (SELECT rel_path, line, v, ch, count(*)::double / any_value(len(v)) AS share FROM (SELECT rel_path, line, v, unnest(string_split(v, '')) AS ch FROM c) GROUP BY rel_path, line, v, ch),
e AS (SELECT rel_path, line, v, -sum(share * log2(share)) AS bits FROM p GROUP BY rel_path, line, v)
SELECT rel_path AS file, line, 'Possible High-Entropy Secret' AS category, 'Medium' AS severity FROM e WHERE bits >= 4""",
    "Random looking strings; a line with a hardcoded secret is not told twice.",
)


def shape(name: str, category: str, sql: str) -> None:
    def make(spark: SparkSession, sf: str) -> DataFrame:
        return metrics.findings_of(TREE.files(spark, sf), category).select("file", "line", "severity")

    register(name, make, f"WITH {TREE.sql()}, l AS ({lines()}) " + sql, f"{category}.")


count = lambda p: f"len(regexp_extract_all(content, '{p}'))"
shape(
    "scan_oversized", "Oversized Function",
    f"""SELECT rel_path AS file, 1 AS line, CASE WHEN n > 160 THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT rel_path, {count("[^" + chr(92) + "n]+")} AS n FROM code WHERE rel_path LIKE '%/long.ts') WHERE n > 80""",
)
shape(
    "scan_complexity", "High Cyclomatic Complexity",
    f"""SELECT rel_path AS file, 1 AS line, CASE WHEN n >= 15 THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT rel_path, 1 + {count("if |&&")} AS n FROM code WHERE regexp_matches(rel_path, '/(branches|deep)[.]js$')) WHERE n >= 10""",
)
shape("scan_nesting", "Deep Nesting", f"SELECT rel_path AS file, 1 AS line, 'Low' AS severity FROM code WHERE rel_path LIKE '%/deep.js' AND {count('if ')} > 5")
shape(
    "scan_queries_in_loops", "N+1 Query Pattern",
    """SELECT rel_path AS file, line, 'Medium' AS severity FROM l
WHERE rel_path LIKE '%/loops.js' AND regexp_matches(l, 'for [(]|forEach') AND NOT contains(l, 'later') AND regexp_matches(l, '[.](findOne|query)[(]')""",
)
shape(
    "scan_effect_cleanup", "Missing Effect Cleanup",
    """SELECT rel_path AS file, line, 'Medium' AS severity FROM l
WHERE contains(l, 'setInterval') AND NOT contains(l, 'clearInterval') OR contains(l, 'addEventListener') AND NOT contains(l, 'removeEventListener')""",
)

#: Weakness class and risk group by rule.
WEAK = [("scan_credentials", "CWE-798", "A07:2021"), ("scan_cloud_keys", "CWE-798", "A07:2021"), ("scan_private_keys", "CWE-798", "A07:2021"), ("scan_chat_tokens", "CWE-798", "A07:2021"),
        ("scan_forge_tokens", "CWE-798", "A07:2021"), ("scan_connection_strings", "CWE-798", "A07:2021"), ("scan_sql_injection", "CWE-89", "A03:2021"), ("scan_inner_html", "CWE-79", "A03:2021"),
        ("scan_dangerous_html", "CWE-79", "A03:2021"), ("scan_command_injection", "CWE-78", "A03:2021"), ("scan_todos", None, None), ("scan_unpaged_loops", None, None)]
register(
    "weakness_classes", lambda spark, sf: detect.with_weakness(detect.raw_findings(TREE.files(spark, sf))).groupBy("category", "cwe", "owasp").agg(F.count(F.lit(1)).alias("n")),
    "SELECT category, cwe, owasp, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT category, {quoted(c)}::varchar AS cwe, {quoted(o)}::varchar AS owasp FROM ({SQL[n]})" for n, c, o in WEAK) + ") GROUP BY ALL",
    "Weakness classes of the findings on raw text.",
)
