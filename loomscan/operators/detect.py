"""Detectors: rules as data, matched by Spark's own regular expressions with line numbers. All rules read a file in one
pass; those that need quoting read the masked text that the lexer's Arrow pass prepares."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions.text import entropy, matches_with_lines
from loomscan.operators.balanced import nested

CODE_EXT = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]


class Rule(NamedTuple):
    """A detector: `keep` says of a match (a struct with match and line) whether it counts; one of `needs` is in every match."""

    id: str
    category: str
    severity: str
    pattern: str
    fix: str
    keep: Callable[[Column], Column] | None = None
    needs: tuple[str, ...] = ()


#: Keys of credentials, values that are none, token formats, schemes of connection strings.
CREDENTIAL = (
    r"(?i)['\"](?:aws_?(?:access|secret)_?key|api[_-]?key|secret|secret[_-]?key|password|passwd|token|auth[_-]?token|private[_-]?key)['\"]"
    r"\s*[:=]\s*['\"]([^'\"]{8,})['\"]"
)
NO_CREDENTIAL = "changeme xxxxxxxx your_api_key placeholder example test dummy todo secret password yourpassword".split()
CONNECTION = r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:/\s'\"]+:[^@/\s'\"]+@[^/\s'\"]+"
#: Text built from parts: a template with a value in it, or a literal and a plus.
BUILT = r"(?:`[^`]*\$\{[^`]*\}[^`]*`|['\"][^'\"]*['\"]\s*\+)"
INTERPOLATION = r"\$\{(" + nested("{", "}", 4) + r")\}"
#: Expressions that carry no markup.
HARMLESS = (
    r"(?i:^[\w.]*\b(?:escape|sanitize|purify|encode)\w*\s*\()|^\d+$"
    r"|^[\w.]+\.(?:length|count|size|line|lineNo|lineNumber|column|col|index|idx|row)$"
)
MARKUP = r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*([^}]+)\}\}"
LOOP_OVER = r"\bfor\s*\(\s*(?:const|let|var)\s+\w+\s+of\s+(?:await\s+)?(" + nested("(", ")", 5) + r")\)\s*\{"
#: Methods that query, words that say that a query is read in pages, words of secrets and of passwords.
QUERY = r"\.(?:findMany|findFirst|findUnique|findById|findOne|findAll|query|execute|aggregate)\s*\("
PAGED = r"(?i)\b(?:take|limit|first|pageSize)\b"
SENSITIVE = r"(?i)token|session|password|secret|csrf|nonce|otp|api[_-]?key|auth"
PASSWORD = r"(?i)password|passwd|credential"
#: Strings that are URLs or paths, and shapes of generated ids.
LOCATION = r"^(?:https?://|/|\./|\.\./|[A-Za-z]:[\\/])"
ID_SHAPES = r"(?i:^c[0-9a-z]{24}$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{24}$)|^[A-Za-z0-9_-]{21}$"
ENTROPY = 4.0


def real_value(x: Column) -> Column:
    value = F.regexp_extract(x["match"], CREDENTIAL, 1)
    return ~F.lower(value).isin(NO_CREDENTIAL) & ~F.contains(value, F.lit("process.env")) & ~F.contains(value, F.lit("${"))


def unsafe_markup(x: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(x["match"], F.lit(INTERPOLATION), 1), lambda p: F.trim(p))
    template = F.regexp_extract(x["match"], r"=\s*(.)", 1) == "`"
    return ~(template & (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(HARMLESS)))


def no_literal(x: Column) -> Column:
    return ~F.trim(F.regexp_extract(x["match"], MARKUP, 1)).rlike(r"^(['\"]).*\1$")


def whole_query(x: Column) -> Column:
    source = F.regexp_extract(x["match"], LOOP_OVER, 1)
    return source.rlike(QUERY) & ~source.rlike(PAGED)


#: Rules on raw text. The first six are the hardcoded secrets.
RAW_RULES = [
    Rule("D1", "Hardcoded Secret", "Critical", CREDENTIAL, "Move the value to the environment or a secret store.", real_value),
    Rule("D2", "Hardcoded Secret", "Critical", r"AKIA[0-9A-Z]{16}", "Revoke the key and use a role.", needs=("AKIA",)),
    Rule("D3", "Hardcoded Secret", "Critical", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "Remove the key from the source and replace it.", needs=("PRIVATE KEY-----",)),
    Rule("D4", "Hardcoded Secret", "Critical", r"\bxox[baprs]-[0-9A-Za-z-]{10,}", "Revoke the token.", needs=("xox",)),
    Rule("D5", "Hardcoded Secret", "Critical", r"\bgh[oprsu]_[0-9A-Za-z]{36,}", "Revoke the token.", needs=("gh",)),
    Rule("D6", "Hardcoded Secret", "Critical", CONNECTION, "Read the connection string from the environment.", needs=("://",)),
    Rule("D8", "SQL Injection Risk", "High", r"\.(?:query|execute)\(\s*" + BUILT, "Bind parameters instead of building the statement.", needs=(".query(", ".execute(")),
    Rule("D11", "Cross-Site Scripting (XSS) Risk", "High", r"\.innerHTML\s*=\s*" + BUILT, "Set text, or sanitise the markup.", unsafe_markup, needs=(".innerHTML",)),
    Rule("D12", "Cross-Site Scripting (XSS) Risk", "High", MARKUP, "Sanitise the markup.", no_literal, needs=("dangerouslySetInnerHTML",)),
    Rule("D13", "Command Injection Risk", "Critical", r"\b(?:child_process\.)?(?:exec|execSync)\(\s*" + BUILT, "Pass arguments as a list.", needs=("exec(", "execSync(")),
    Rule("D17", "Unresolved TODO", "Low", r"//\s*(?:TODO|FIXME|HACK|XXX)\b[^\n]*", "Resolve or file the note.", needs=("//",)),
    Rule("D22", "Unbounded Loop Over Unpaginated Data", "Low", LOOP_OVER, "Read in pages.", whole_query, needs=("for",)),
]
SECRET_RULES = RAW_RULES[:6]
#: Rules on masked code (comments and strings blanked).
CODE_RULES = [
    Rule("D9", "Code Injection Risk", "High", r"\beval\s*\(", "Avoid evaluating text.", needs=("eval",)),
    Rule("D10", "Code Injection Risk", "Medium", r"new\s+Function\s*\(", "Avoid building functions from text.", needs=("Function",)),
]
#: Weakness class and risk group of the categories that have one.
WEAKNESSES = [
    ("Hardcoded Secret", "CWE-798", "A07:2021"), ("Possible High-Entropy Secret", "CWE-798", "A07:2021"), ("SQL Injection Risk", "CWE-89", "A03:2021"), ("Code Injection Risk", "CWE-94", "A03:2021"),
    ("Cross-Site Scripting (XSS) Risk", "CWE-79", "A03:2021"), ("Command Injection Risk", "CWE-78", "A03:2021"), ("Weak Random Number Generation", "CWE-338", "A02:2021"),
    ("Weak Password Hashing", "CWE-916", "A02:2021"), ("Outdated/Vulnerable Dependency", "CWE-1104", "A06:2021"),
]
RANDOM, HASHING, DEBUG = "Weak Random Number Generation", "Weak Password Hashing", "Leftover Debug Logging"
LOGGING = r"console\.(?:log|debug)\("
WEAK_HASH = r"(?i)createHash\(\s*(['\"])(?:md5|sha1)\1"
FINDING = "array<struct<line:int,severity:string,category:string,summary:string,suggested_fix:string>>"


def pattern_rows(files: DataFrame, pattern: str, column: str = "content") -> DataFrame:
    """(rel_path, match, line) of all matches; files without one leave before anything is exploded."""
    hit = files.where(F.col(column).rlike(pattern)).select("rel_path", F.explode(matches_with_lines(F.col(column), pattern)).alias("x"))
    return hit.select("rel_path", "x.match", "x.line")


def issue_rows(rows: DataFrame, category: str, severity: Column | str, fix: str, summary: Column | None = None) -> DataFrame:
    shown = F.concat(F.lit(f"{category} near: "), F.substring(F.trim("match"), 1, 80)) if summary is None else summary
    return rows.select(F.col("rel_path").alias("file"), "line", (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"), shown.alias("summary"), F.lit(fix).alias("suggested_fix"), F.lit("static").alias("source"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finding(x: Column, category: str, severity: Column | str, fix: str, summary: Column | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    shown = F.concat(F.lit(f"{category} near: "), F.substring(F.trim(x["match"]), 1, 80)) if summary is None else summary
    return F.struct(x["line"].cast("int").alias("line"), level.alias("severity"), F.lit(category).alias("category"), shown.alias("summary"), F.lit(fix).alias("suggested_fix"))


def hits(rule: Rule, text: Column) -> Column:
    """array of findings of a rule in a text."""
    found = matches_with_lines(text, rule.pattern, rule.needs)
    kept = F.filter(found, rule.keep) if rule.keep else found
    return F.transform(kept, lambda x: finding(x, rule.category, rule.severity, rule.fix)).cast(FINDING)


def exploded(files: DataFrame, found: Column) -> DataFrame:
    return files.select(F.col("rel_path").alias("file"), F.explode(found).alias("x")).select("file", "x.*", F.lit("static").alias("source"))


def custom_rules(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rel_path, category, severity, match, line) of user rules (name, severity, pattern) on raw text, in one pass."""

    def own(name: str, severity: str, pattern: str) -> Column:
        return F.transform(matches_with_lines(F.col("content"), pattern), lambda x: F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"), x["match"].alias("match"), x["line"].alias("line")))

    found = F.concat(*[own(*rule) for rule in rules])
    return files.select("rel_path", F.explode(found).alias("x")).select("rel_path", "x.*")


def raw_findings(files: DataFrame, rules: list[Rule] = RAW_RULES) -> DataFrame:
    """Findings on raw text; a file is read once. Each rule first asks whether it matches at all, so only files with a match
    pay for its lines."""
    return exploded(files, F.concat(*[hits(r, F.col("content")) for r in rules]))


def debug_logging(code: Column) -> Column:
    found = matches_with_lines(code, LOGGING)
    told = F.concat(F.size(found).cast("string"), F.lit(" console calls"))
    return F.transform(F.slice(found, 1, 1), lambda x: finding(x, DEBUG, "Low", "Remove the calls or use a logger.", told)).cast(FINDING)


def weak_random(code: Column, content: Column) -> Column:
    """Math.random() where its line or one of the five above speaks of a secret."""
    lines = F.split(content, "\n")
    first = lambda x: F.greatest(x["line"] - 5, F.lit(1))
    near = lambda x: F.array_join(F.slice(lines, first(x), x["line"] - first(x) + 1), "\n").rlike(SENSITIVE)
    found = F.filter(matches_with_lines(code, r"Math\.random\(\)"), near)
    return F.transform(found, lambda x: finding(x, RANDOM, "High", "Use a cryptographic generator.")).cast(FINDING)


def weak_hash(words: Column, content: Column) -> Column:
    """MD5 and SHA-1 in live code (short strings of which are still there); worse on lines that speak of passwords."""
    lines = F.split(content, "\n")
    level = lambda x: F.when(F.get(lines, x["line"] - 1).rlike(PASSWORD), "Critical").otherwise("Medium")
    return F.transform(matches_with_lines(words, WEAK_HASH), lambda x: finding(x, HASHING, level(x), "Use a slow, salted hash.")).cast(FINDING)


def code_findings(masked: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Findings on code without comments and strings; masked: lexer.masked(files). With `categories` only their rules are
    tried."""
    code, content = F.col("masked"), F.col("content")
    parts = [*((r.category, hits(r, code)) for r in CODE_RULES), (RANDOM, weak_random(code, content)), (HASHING, weak_hash(F.col("words"), content)), (DEBUG, debug_logging(code))]
    return exploded(masked, F.concat(*[found for category, found in parts if categories is None or category in categories]))


#: What live code of a category's findings has: a pattern that the raw text must meet, as masking only blanks.
LIVE = {"Code Injection Risk": r"\beval|Function", RANDOM: r"Math\.random\(\)", HASHING: r"(?i)createHash\(", DEBUG: LOGGING}
#: A quote and the 20 characters without a blank that a random looking literal has at least, a digit and a letter among 200.
LITERAL = r"""["'](?=\S{0,199}[0-9])(?=\S{0,199}[A-Za-z])\S{20}"""


def may_have(category: str) -> Column:
    """Whether a file's raw text has what a finding of a category of code_findings() cannot do without; a file that has it
    may still have no finding."""
    return F.col("content").rlike(LIVE[category])


def entropy_findings(masked: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """String literals that look random: 20 to 200 characters without blanks, digits and letters, no path, URL or id, and not
    on a line that has a hardcoded secret."""
    secret = F.concat(*[F.transform(hits(r, F.col("content")), lambda x: x["line"]) for r in SECRET_RULES])
    v = F.col("match")
    told_of = masked.select("rel_path", "strings", F.explode(F.array(secret)).alias("flagged"))  # exploded: once a file, not once a string
    s = told_of.select("rel_path", "flagged", F.explode("strings").alias("x")).select("rel_path", "flagged", F.col("x.value").alias("match"), "x.line")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(r"\s")
    shaped = s.where(F.length(v).between(20, 200) & mixed & ~v.rlike(LOCATION) & ~v.rlike(ID_SHAPES) & ~F.array_contains("flagged", F.col("line")))
    scored = shaped.withColumn("e", entropy(v, None)).where(F.col("e") >= threshold)
    told = F.concat(F.lit("entropy "), F.round("e", 2).cast("string"))
    return issue_rows(scored, "Possible High-Entropy Secret", "Medium", "Check whether the value is a secret.", told)


def dead_code(unreferenced: DataFrame) -> DataFrame:
    """Findings of files (rel_path) that nothing refers to."""
    return issue_rows(unreferenced.withColumn("line", F.lit(1)), "Possible Dead Code", "Low", "Remove the file if nothing uses it.", F.lit("No import refers to this file."))


def with_weakness(findings: DataFrame) -> DataFrame:
    """Findings with the weakness class and risk group of their category; none for categories that are no weakness."""
    dims = findings.sparkSession.createDataFrame(WEAKNESSES, "category string, cwe string, owasp string")
    return findings.join(F.broadcast(dims), "category", "left")  # a fixed list


def with_proposals(findings: DataFrame, proposals: DataFrame) -> DataFrame:
    """Findings with a proposed fix (fingerprint, proposal) in place of the general one."""
    own = findings.join(proposals.select("fingerprint", "proposal"), "fingerprint", "left")
    return own.withColumn("suggested_fix", F.coalesce("proposal", "suggested_fix")).drop("proposal")


def license_class(text: Column) -> Column:
    """Class of the licences that a text names: any restrictive one wins; the lesser licence's name holds the stricter's."""
    strict = text.rlike("(?:^|[^L])GPL|CC BY-NC|GNU General Public|GNU Affero")
    return F.when(strict, "restrictive").when(text.rlike("LGPL|MPL|EPL|GNU Lesser"), "weak").when(text.rlike("MIT|Apache|BSD|ISC"), "permissive").otherwise("unknown")
