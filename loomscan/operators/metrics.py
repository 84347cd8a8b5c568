"""Structure of code: bodies of functions, loops and effects by balanced braces, and the findings and calls they give.

One Arrow pass over masked code finds the bodies; everything else is plain expressions over them. A function's body is
blanked where other functions lie inside it, so that their branches are their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions.joins import sorted_side
from loomscan.functions.text import newlines
from loomscan.operators import detect, lexer
from loomscan.operators.balanced import nested
from loomscan.operators.detect import CODE_EXT, issue_rows, union
from loomscan.operators.lexer import blank

BLOCKS = "rel_path string, kind string, name string, line int, lines int, depth int, body string, raw string, queried int, place int"
FUNCTION = (
    r"(?=[A-Za-z_$=])(?:\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)?\s*\([^)]*\)[^{;]*\{"
    r"|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)[^={;]*=>\s*\{"
    r"|(?<![\w$.])(?!(?:if|for|while|switch|catch|function|return|with)\b)([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*\{|=>\s*\{)"
)
LOOP = r"\b(?:for|while)\s*(?:await\s*)?\(" + nested("(", ")", 5) + r"\)\s*\{|\bdo\s*\{"
EACH = r"\.(?:forEach|map)\(\s*(?:async\s*)?(?:(?:\([^)]*\)|[\w$]+)\s*=>|function\s*[\w$]*\s*\([^)]*\))\s*(\{)?"
EFFECT = r"\buseEffect\(\s*(?:async\s*)?(?:\([^)]*\)\s*=>|function\s*[\w$]*\s*\([^)]*\))\s*(\{)?"
HEADS = [("function", re.compile(FUNCTION)), ("loop", re.compile(LOOP)), ("loop", re.compile(EACH)), ("effect", re.compile(EFFECT))]
DECISION = r"(?<![.\w$])(?:if|for|while|case|catch)\b|&&(?!=)|\|\|(?!=)|\?\?(?!=)|(?<![?.])\?(?![?.:])"
CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)[^{};()]*\{")
FLOW = re.compile(r"(?<![.\w$])(if|for|while|do|switch|try|catch|finally|else)\b|[{}();]")
CLEANUP = re.compile(r"\breturn\s+(?:async\s*)?(?:(?:\([^)]*\)|[\w$]+)\s*=>|function\b)")
QUERY = re.compile(detect.QUERY)
FAR = 1 << 60


def closings(text: str) -> dict[int, int]:
    """Place of the closing partner of every brace and parenthesis; the text's end where there is none."""
    out, open_ = {}, []
    for m in re.finditer("[{}()]", text):
        if m[0] in "{(":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out | dict.fromkeys(open_, len(text))


def enclosing(text: str, places: list[int]) -> dict[int, int]:
    """The brace that is open around each of some ascending places; one pass."""
    out, open_, at = {}, [], 0
    for m in re.finditer("[{}]", text):
        while at < len(places) and places[at] <= m.start():
            out[places[at]] = open_[-1] if open_ else -1
            at += 1
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            open_.pop()
    return out | {p: open_[-1] if open_ else -1 for p in places[at:]}


def nesting(body: str) -> int:
    """Deepest control flow: if, loops, switch, try, catch; an `else if` lies in its `if`, a catch in its try."""
    most = parens = 0
    frames = [[0, 0, 0]]  # level, level of the last if, of the last try
    pending: tuple[int, int] | None = None  # level of the statement whose block is awaited, parentheses around it
    after_else = after_do = False
    for m in FLOW.finditer(body):
        token = m[0]
        frame = frames[-1]
        here = pending[0] if pending and pending[1] == parens else frame[0]
        if token == "(":
            parens += 1
        elif token == ")":
            parens = max(parens - 1, 0)
        elif token == ";":
            if pending and pending[1] == parens:
                pending = None
        elif token == "{":
            frames.append([pending[0] if pending and pending[1] == parens else frame[0], 0, 0])
            if pending and pending[1] == parens:
                pending = None
        elif token == "}":
            if len(frames) > 1:
                frames.pop()
        elif token == "else":
            pending, after_else = (frame[1], parens), True
            continue
        elif token == "finally":
            pending = (frame[2], parens)
        elif token == "while" and after_do:
            after_do = False
        else:
            level = frame[1] + 1 if token == "if" and after_else else frame[2] + 1 if token == "catch" else here + 1
            if token == "if":
                frame[1] = level
            elif token == "try":
                frame[2] = level
            after_do = token == "do" or after_do
            most, pending = max(most, level), (level, parens)
        after_else = False
    return most


def headed(code: str, close: dict[int, int], heads: list[tuple[str, re.Pattern]]) -> list[tuple[str, str, int, int, int]]:
    """(kind, name, place of the head, start and end of the body) of what some heads open."""
    found = []
    classes = sorted((m.end(), close.get(m.end() - 1, len(code)), m[1]) for m in CLASS.finditer(code)) if "class" in code else []

    def of_class(place: int, name: str) -> str:
        at = bisect_right(classes, (place, FAR)) - 1
        while at >= 0 and classes[at][1] < place:
            at -= 1
        return f"{classes[at][2]}.{name}" if at >= 0 and owner.get(place) == classes[at][0] - 1 else name

    owner = enclosing(code, [m.start() for m in HEADS[0][1].finditer(code) if m[3]]) if classes else {}
    for kind, head in heads:
        for m in head.finditer(code):
            if code[m.end() - 1] == "{":
                start, end = m.end(), close.get(m.end() - 1, len(code))
            else:  # an expression: up to the end of the call around it
                start, end = m.end(), close.get(code.index("(", m.start()), len(code))
            name = next((g for g in m.groups() if g and g != "{"), None)
            if kind == "function" and m[3]:  # a method is named with its class
                name = of_class(m.start(), name)
            found.append((kind, name or "(anonymous)", m.start(), start, end))
    return found


def without(code: str, a: int, b: int, inner: list[tuple[int, int]]) -> str:
    """A stretch of code in which sorted stretches inside it are blanked."""
    own, at = [], a
    for c, d in inner:
        if c >= at:
            own += [code[at:c], blank(code[c:d])]
            at = d
    return "".join([*own, code[at:b]])


def bodies(code: str, content: str) -> list[dict]:
    """Functions, loops and effects with their bodies; what lies in functions inside (and for loops, in inner loops) is
    blanked. One pass for the braces; a body costs its own length."""
    found = headed(code, closings(code), HEADS)
    functions = sorted((a, b) for kind, _, _, a, b in found if kind == "function")
    loops = sorted((a, b) for kind, _, _, a, b in found if kind == "loop")
    line = LineOf(code)
    out = []
    for kind, name, head, a, b in found:
        body = without(code, a, b, sorted([*within(functions, a, b), *(within(loops, a, b) if kind == "loop" else ())]))
        query = QUERY.search(body) if kind == "loop" else None
        out.append({
            "kind": kind, "name": name, "line": line(head), "lines": line(b) - line(head) + 1, "depth": nesting(body) if kind == "function" else 0, "body": body,
            "raw": content[a:b], "queried": line(a + query.start()) if query else None, "place": head,
        })
        if kind == "effect":
            out[-1]["queried"] = leaks(code[a:b], body)
    return out


def function_bodies(code: str) -> list[tuple[str, int, str, int]]:
    """(name, line, body, place) of the functions of bodies(), without what only findings ask for."""
    found = headed(code, closings(code), HEADS[:1])
    spans, line = sorted((a, b) for _, _, _, a, b in found), LineOf(code)
    return [(name, line(head), without(code, a, b, within(spans, a, b)), head) for _, name, head, a, b in found]


def within(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Spans of a sorted list that lie inside (a, b)."""
    low, high = bisect_right(spans, (a, FAR)), bisect_right(spans, (b, FAR))
    return [s for s in spans[low:high] if s[1] <= b]


def leaks(effect: str, own: str) -> int | None:
    """1 if an effect starts a timer, 2 if a listener, 3 if both, without a returned function that stops it."""
    m = CLEANUP.search(own)
    undo = effect[m.start() :] if m else ""
    timer = re.search(r"\b(?:setInterval|setTimeout)\s*\(", effect) and not re.search(r"\b(?:clearInterval|clearTimeout)\s*\(", undo)
    listener = re.search(r"\.addEventListener\s*\(", effect) and not re.search(r"\.removeEventListener\s*\(", undo)
    return bool(timer) + 2 * bool(listener) or None


class LineOf:
    """Line of a place, by bisection over the line ends."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1


def blocks(masked: DataFrame) -> DataFrame:
    """Bodies of the functions, loops and effects of masked JavaScript and TypeScript files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 50):
                part = b.slice(i, 50)
                rows = [{"rel_path": p, **x} for p, code, content in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in bodies(code, content)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return masked.where(F.col("ext").isin(CODE_EXT)).select("rel_path", "masked", "content").mapInArrow(run, BLOCKS)


def blocks_of(files: DataFrame, may: Column | None = None) -> DataFrame:
    """blocks() of files; those of other languages are not lexed, nor those of which `may` is false."""
    own = files.where(F.col("ext").isin(CODE_EXT))
    return blocks(lexer.masked(own if may is None else own.where(may)))


def functions_of(files: DataFrame) -> DataFrame:
    """(rel_path, kind, name, line, body, place): the functions of blocks_of(), lexed and parsed in one pass. Files whose raw text
    lacks what a function's head holds are not lexed: masking only blanks."""
    text = F.col("content")
    may = F.contains(text, F.lit("{")) & (F.contains(text, F.lit(")")) | F.contains(text, F.lit("=>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                files_ = zip(*(c.to_pylist() for c in b.slice(i, 100).columns), strict=True)
                rows = [(p, "function", *x) for p, e, t in files_ for x in function_bodies(lexer.lex(t, e)[0])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rel_path", "kind", "name", "line", "body", "place"])

    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
    own = files.where(F.col("ext").isin(CODE_EXT) & may).select("rel_path", "ext", "content")
    return own.mapInArrow(run, "rel_path string, kind string, name string, line int, body string, place int")


def methods(files: DataFrame) -> DataFrame:
    """(rel_path, name, line) of the methods of classes, named with them; files without the word `class` are not lexed."""
    return blocks_of(files, F.contains(F.col("content"), F.lit("class"))).where("kind = 'function' and name like '%.%'").select("rel_path", "name", "line")


OVERSIZED, COMPLEX, NESTED, LOOPED, LEAKING = "Oversized Function", "High Cyclomatic Complexity", "Deep Nesting", "N+1 Query Pattern", "Missing Effect Cleanup"


def may_have(category: str, long: int = 80, branches: int = 10, deep: int = 5) -> Column:
    """Whether a file's raw text has what a finding of the category cannot do without: masking only blanks, so a word of live
    code stands in the text too, and a body has no more words and lines than its file. It may be true without a finding."""
    text = F.col("content")
    return {
        OVERSIZED: newlines(text) >= long, COMPLEX: F.regexp_count(text, F.lit(r"if|for|while|case|catch|&&|\|\||\?\??")) >= branches - 1,
        NESTED: F.regexp_count(text, F.lit("if|for|while|do|switch|try|catch")) > deep,
        LOOPED: text.rlike(detect.QUERY.replace(r"\s*\(", "")), LEAKING: F.contains(text, F.lit("useEffect(")),
    }[category]


def findings_of(files: DataFrame, category: str) -> DataFrame:
    """Findings of one category; files that cannot have any are read, but not lexed."""
    return findings(blocks_of(files, may_have(category))).where(F.col("category") == category)


SCHEMA = pa.schema([
    ("rel_path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("lines", pa.int32()), ("depth", pa.int32()),
    ("body", pa.string()), ("raw", pa.string()), ("queried", pa.int32()), ("place", pa.int32()),
])


def findings(blocks_: DataFrame, long: int = 80, branches: int = 10, deep: int = 5) -> DataFrame:
    """Oversized, branching and deeply nested functions, queries in loops, effects that leave timers or listeners."""
    f = blocks_.where("kind = 'function'").withColumn("branches", F.regexp_count("body", F.lit(DECISION)) + 1).withColumn("match", F.col("name"))
    told = lambda what, c: F.concat(F.col("name"), F.lit(f": {what} "), F.col(c).cast("string"))
    worse = lambda cond: F.when(cond, "Medium").otherwise("Low")
    level = lambda rows, cond, c, s, fix, summary: issue_rows(rows.where(cond), c, s, fix, summary)
    loops = blocks_.where("kind = 'loop' and queried is not null").withColumn("match", F.regexp_extract("body", detect.QUERY, 0)).withColumn("line", F.col("queried"))
    effects = blocks_.where("kind = 'effect' and queried is not null").withColumn("match", F.get(F.array(F.lit("a timer"), F.lit("a listener"), F.lit("a timer and a listener")), F.col("queried") - 1))
    return union([
        level(f, F.col("lines") > long, OVERSIZED, worse(F.col("lines") > 2 * long), "Split the function.", told("lines", "lines")),
        level(f, F.col("branches") >= branches, COMPLEX, worse(F.col("branches") >= branches + 5), "Reduce the branches.", told("branches", "branches")),
        level(f, F.col("depth") > deep, NESTED, "Low", "Return early or split.", told("depth", "depth")),
        issue_rows(loops, LOOPED, "Medium", "Query once for all elements."),
        issue_rows(effects, LEAKING, "Medium", "Return a function that undoes the effect."),
    ])


def calls(blocks_: DataFrame) -> DataFrame:
    """(rel_path, caller, callee, ord) of the calls in each function's own body, in order."""
    own = blocks_.where("kind = 'function'").select("rel_path", F.col("name").alias("caller"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\("), 1)).alias("ord", "callee"))
    return own.where(~F.col("callee").isin("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new"))


def resolved(calls_: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, ord): calls that lead to a function of the same file, else of a file that it imports; others go.

    Nodes are `path#name`. functions(rel_path, name), edges(from_path, to_path).
    """
    node = lambda path, name: F.concat(F.col(path), F.lit("#"), F.col(name))
    known = functions.select(F.col("rel_path").alias("at"), F.col("name").alias("callee")).distinct()
    to = edges.groupBy(F.col("from_path").alias("rel_path")).agg(F.collect_set("to_path").alias("to"))
    probe = lambda rank, at: F.struct(F.lit(rank).alias("rank"), at.alias("at"))
    far = F.transform(F.coalesce("to", F.array().cast("array<string>")), lambda p: probe(1, p))
    tried = calls_.join(sorted_side(to), "rel_path", "left").select("rel_path", "caller", "callee", "ord", F.inline(F.concat(F.array(probe(0, F.col("rel_path"))), far)))  # the calls are read once
    best = tried.join(sorted_side(known), ["at", "callee"]).groupBy("rel_path", "caller", "callee", "ord").agg(F.min(F.struct("rank", "at")).alias("m"))
    return best.select(node("rel_path", "caller").alias("src"), F.concat("m.at", F.lit("#"), "callee").alias("dst"), "ord")


#: What a call's text says about where it leaves the app, and the name of that, in order.
EXTERNAL = [
    (r"(?i)\.(?:findMany|findFirst|findUnique|findById|findOne|findAll|query|execute|aggregate)$", "Database call"),
    (r"(?i)^(?:axios|fetch|got|superagent)(?:\.|$)", "Outbound HTTP call"),
    (r"(?i)^https?\.request$", "Outbound HTTP call"),
    (r"^fs(?:Promises)?\.", "File I/O"),
    (r"(?i)\.(?:readFile|writeFile|readFileSync|writeFileSync|unlink|mkdir)$", "File I/O"),
    (r"(?i)\.(?:publish|sendMessage|produce)$", "Queue/event publish"),
]
DOTTED = r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*+)\s*\("
KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new"]


def whole_calls(blocks_: DataFrame) -> DataFrame:
    """(rel_path, caller, callee, ord) of the calls in each function's own body, as written (`db.user.findOne`), in order."""
    named = F.regexp_extract_all("body", F.lit(DOTTED), 1)
    own = blocks_.where("kind = 'function'").select("rel_path", F.col("name").alias("caller"), "place", F.posexplode(named).alias("ord", "callee"))
    return own.where(~F.col("callee").isin(KEYWORDS)).withColumn("callee", F.replace("callee", F.lit("?."), F.lit(".")))


def classified(calls_: DataFrame, functions: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls_ with (kind, to_path, target): the first that holds of
    `external` (the call leaves the app; target says how), `local` (a function of the file), `imported` (a function of the file
    that the name was imported from), `opaque-project` (that file, but no function of it). Other calls are left out.

    functions (rel_path, name, line): a method is found by its own name too, the first of equals by line.
    bindings (rel_path, local, to_path). All joins are by equality, the calls are read once, and one aggregate picks the best
    candidate of a call.
    """
    key = [c for c in calls_.columns]
    dotted = F.split("callee", r"\.")
    c = calls_.withColumn("base", dotted[0]).withColumn("member", F.get(dotted, 1))
    label = F.lit(None).cast("string")
    for pattern, name in reversed(EXTERNAL):
        label = F.when(F.col("callee").rlike(pattern), name).otherwise(label)
    parts = F.split("name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = functions.select("rel_path", "name", "line", F.explode(suffixes).alias("called"))
    known = known.groupBy(F.col("rel_path").alias("to_path"), "called").agg(F.min(F.struct("line", "name")).alias("f")).select("to_path", "called", F.col("f.name").alias("target"))
    probe = lambda rank, kind, to, called: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), to.alias("to_path"), called.alias("called"))
    bound = sorted_side(bindings.select("rel_path", F.col("local").alias("base"), F.col("to_path").alias("bound")).distinct())
    met = c.withColumn("label", label).join(bound, ["rel_path", "base"], "left")
    none, own, other = F.lit(None).cast("string"), F.col("rel_path"), F.col("bound")
    probes = F.when(F.col("label").isNotNull(), F.array(probe(0, "external", none, none))).otherwise(F.filter(F.array(
        probe(1, "local", own, F.col("callee")), probe(2, "local", own, F.col("base")), probe(3, "imported", other, F.col("member")), probe(4, "imported", other, F.col("base")), probe(5, "opaque-project", other, none),
    ), lambda p: p["to_path"].isNotNull()))
    tried = met.select(*key, "label", F.explode(probes).alias("p")).select(*key, "label", "p.*")
    out = tried.join(sorted_side(known), ["to_path", "called"], "left").where(F.col("rank").isin(0, 5) | F.col("target").isNotNull()).withColumn("target", F.coalesce("target", "label"))
    best = out.groupBy(*key).agg(F.min(F.struct("rank", "to_path", "target", "kind")).alias("m"))
    return best.select(*key, "m.kind", "m.to_path", "m.target")


#: Calls of a handler that reach data or the network.
SIDE_EFFECTS = r"\b(?:db|prisma|repository|model|axios|fetch|cache|queue)\b(?:\.\w+)*+\s*\("


def body_trace(blocks_: DataFrame) -> DataFrame:
    """What a handler does: status codes, branches, error handling, whether it answers."""
    body = F.col("body")
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col("raw"), F.lit(r"\.(?:status|sendStatus)\(\s*(\d{3})"), 1)))
    effects = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(SIDE_EFFECTS), 0), lambda c: F.regexp_replace(c, r"\s*\($", "")))
    return blocks_.where("kind = 'function'").select("rel_path", "name", effects.alias("side_effects"), codes.alias("status_codes"), F.regexp_count(body, F.lit(r"\bif\b")).alias("branches"), body.rlike(r"\bcatch\b|\bnext\(").alias("handles_errors"), body.rlike(r"\bres\b[^;\n]*\.(?:json|send|end|render|redirect|sendStatus)\s*\(").alias("responds"))


def steps(traces: DataFrame) -> DataFrame:
    """body_trace rows with what a handler does in words."""
    branches = F.when(F.col("branches") == 1, "1 branch").when(F.col("branches") > 1, F.concat(F.col("branches").cast("string"), F.lit(" branches")))
    answers = F.when(F.size("status_codes") > 0, F.concat(F.lit("answers "), F.array_join("status_codes", ", "))).when(F.col("responds"), "answers")
    calls_out = F.when(F.size("side_effects") > 0, F.concat(F.lit("calls "), F.array_join("side_effects", ", "))) if "side_effects" in traces.columns else F.lit(None)
    return traces.withColumn("steps", F.array_compact(F.array(branches, calls_out, F.when(F.col("handles_errors"), "handles errors"), answers)))
