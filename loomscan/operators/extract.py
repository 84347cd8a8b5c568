"""Components, data models, routes and environment variables of source files, by Spark's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.joins import sorted_side
from loomscan.functions.text import matches_with_lines
from loomscan.operators.balanced import Head, spans

JS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
#: What a Rails `resources` line declares: action, method, suffix.
RESOURCES = [("index", "GET", ""), ("new", "GET", "/new"), ("create", "POST", ""), ("show", "GET", "/:id"), ("edit", "GET", "/:id/edit"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id")]


def rows(files: DataFrame, exts: list[str] | None, pattern: str, *groups: tuple[str, int]) -> DataFrame:
    """(rel_path, line, groups...) of a pattern's matches in files of some extensions; others are not searched."""
    own = files if exts is None else files.where(F.col("ext").isin(exts))
    hit = own.where(F.col("content").rlike(pattern)).select("rel_path", F.explode(matches_with_lines(F.col("content"), pattern)).alias("x"))
    return hit.select("rel_path", "x.line", *[F.regexp_extract("x.match", pattern, i).alias(n) for n, i in groups])


def env_vars(files: DataFrame) -> DataFrame:
    js = rows(files, None, r"process\.env(?:\.([A-Z_][A-Z0-9_]*)|\[[\"']([A-Z_][A-Z0-9_]*)[\"']\])", ("a", 1), ("b", 2)).select(F.coalesce(F.nullif("a", F.lit("")), "b").alias("name"))
    py = rows(files, None, r"os\.(?:environ(?:\.get)?|getenv)\s*[\[(]\s*[\"']([A-Z_][A-Z0-9_]*)[\"']", ("name", 1)).select("name")
    return js.union(py).distinct()


COMPONENT = "array<struct<kind:string,name:string,extra:string,line:int>>"
OTHER = [".go", ".rs", ".java", ".kt", ".cs", ".rb", ".php", ".swift", ".scala"]
#: Kind, extensions, pattern, and whether a second group holds parameters or a base.
COMPONENTS = [
    ("function", JS, r"(?m)^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)", True),
    ("function", JS, r"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|[\w$]+)\s*=>", True),
    ("class", JS, r"(?m)^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?", True),
    ("import", JS, r"(?=[fir])(?:from\s+|import\s+|require\(\s*|import\(\s*)[\"']([^\"'\n]+)[\"']", False),
    ("export", JS, r"(?m)^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)", False),
    ("function", [".py"], r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)", True),
    ("class", [".py"], r"(?m)^[ \t]*class\s+([A-Za-z_]\w*)(?:\(([^)]*)\))?\s*:", True),
    ("import", [".py"], r"(?m)^[ \t]*import\s+([\w.]+)", False),
    ("import", [".py"], r"(?m)^[ \t]*from\s+(\.+)\s*import\s+\w+", False),
    ("import", [".py"], r"(?m)^[ \t]*from\s+(\.*\w[\w.]*)\s+import\b", False),
    (
        "function", OTHER,
        r"(?m)^[ \t]*(?:(?:pub|public|private|protected|static|async|final|override)\s++)*+(?:func|fn|fun|def|function)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)", True,
    ),
    ("class", OTHER, r"(?m)^[ \t]*(?:(?:pub|public|private|abstract|final|sealed|data)\s++)*+(?:class|struct|interface|trait)\s+([A-Za-z_]\w*)", False),
]


def components(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(rel_path, kind, name, extra, line): functions, classes, imports and exports, by language family, in one pass; with
    `kinds` only the patterns of these are tried."""

    def part(kind: str, exts: list[str], pattern: str, more: bool) -> Column:
        extra = lambda x: F.regexp_extract(x["match"], pattern, 2) if more else F.lit("")
        row = lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x["match"], pattern, 1).alias("name"), extra(x).alias("extra"), x["line"].alias("line"))
        return F.when(F.col("ext").isin(exts), F.transform(matches_with_lines(F.col("content"), pattern), row).cast(COMPONENT)).otherwise(F.array().cast(COMPONENT))

    known = files.where(F.col("ext").isin(JS + [".py"] + OTHER))
    return known.select("rel_path", F.explode(F.concat(*[part(*c) for c in COMPONENTS if kinds is None or c[0] in kinds])).alias("x")).select("rel_path", "x.*")


ROUTE = "array<struct<method:string,path:string,handler:string,line:int>>"
#: Method, path and handler of a match, by framework: groups of the pattern.
EXPRESS = r"\b(?:app|router|\w+Router)\.(get|post|put|patch|delete|all)\(\s*[\"'`](/[^\"'`]*)[\"'`]\s*,\s*(?:[\w.]++(?:\([^()]*+\))?+\s*+,\s*+)*+([A-Za-z_$][\w$.]*)?"
FLASK = r"@\w+\.route\(\s*[\"']([^\"']+)[\"']([^)]*)\)\s*(?:@[^\n]*+\n\s*+)*+(?:async\s+)?def\s+(\w+)"
FASTAPI = r"@\w+\.(get|post|put|patch|delete)\(\s*[\"']([^\"']*)[\"'][^)]*\)\s*(?:async\s+)?def\s+(\w+)"
GO = r"\b\w+\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]+)\"\s*,\s*(?:func\b|([\w.]+))"
GO_HANDLED = r"http\.HandleFunc\(\s*\"([^\"]+)\"\s*,\s*(\w+)?"
RAILS = r"(?m)^[ \t]*(get|post|put|patch|delete)\s+[\"']([^\"']+)[\"'](?:\s*,\s*to:\s*|\s*=>\s*)?[\"']?([\w#/]*)"
RAILS_RESOURCES = r"(?m)^[ \t]*resources\s+:(\w+)"
SPRING = (
    r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@[^\n]*+\n\s*+)*+"
    r"(?:public\s+|private\s+|fun\s+)?(?:[\w<>\[\], ?]+\s+)?(\w+)\s*\("
)
#: A class, with the prefix of its mapping if it has one; each class of a file has its own.
SPRING_CLASS = (
    r"(?:@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@[^\n]*+\n\s*+)*+)?"
    r"\b(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+\w+"
)
LARAVEL = r"Route::(get|post|put|patch|delete)\(\s*[\"']([^\"']+)[\"']\s*,\s*(?:\[\s*[\w\\]+::class\s*,\s*[\"'](\w+)[\"'])?"


def routes(files: DataFrame) -> DataFrame:
    """(rel_path, method, path, handler, line) over eight frameworks; a file is read once. Handlers of files that are routes
    by their place are `(file)`, which no name in code can be: next_routes() gives these alone."""
    content = F.col("content")
    group = lambda x, pattern, i: F.regexp_extract(x["match"], pattern, i)
    rooted = lambda path: F.concat(F.lit("/"), F.ltrim(path, F.lit("/")))

    def route(x: Column, method: Column, path: Column, handler: Column) -> Column:
        return F.struct(F.upper(method).alias("method"), path.alias("path"), F.coalesce(F.nullif(handler, F.lit("")), F.lit("(inline)")).alias("handler"), x["line"].cast("int").alias("line"))

    def plain(pattern: str, path=lambda p: p, handler=lambda h: h) -> Column:
        return F.transform(matches_with_lines(content, pattern), lambda x: route(x, group(x, pattern, 1), path(group(x, pattern, 2)), handler(group(x, pattern, 3)))).cast(ROUTE)

    def flask() -> Column:
        named = lambda x: F.regexp_extract_all(F.regexp_extract(group(x, FLASK, 2), r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"[\"'](\w+)[\"']"), 1)
        methods = lambda x: F.when(F.size(named(x)) > 0, named(x)).otherwise(F.array(F.lit("GET")))
        return F.flatten(F.transform(matches_with_lines(content, FLASK), lambda x: F.transform(methods(x), lambda m: route(x, m, group(x, FLASK, 1), group(x, FLASK, 3))))).cast(ROUTE)

    def resources() -> Column:
        seven = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(m).alias("method"), F.lit(s).alias("suffix")) for a, m, s in RESOURCES])
        name = lambda x: group(x, RAILS_RESOURCES, 1)
        of = lambda x: F.transform(seven, lambda r: route(x, r["method"], F.concat(F.lit("/"), name(x), r["suffix"]), F.concat(name(x), F.lit("#"), r["action"])))
        return F.flatten(F.transform(matches_with_lines(content, RAILS_RESOURCES), of)).cast(ROUTE)

    handled = F.transform(matches_with_lines(content, GO_HANDLED), lambda x: route(x, F.lit("ANY"), group(x, GO_HANDLED, 1), group(x, GO_HANDLED, 2))).cast(ROUTE)

    def prefixed(x: Column) -> Column:
        above = F.filter(matches_with_lines(content, SPRING_CLASS), lambda c: c["line"] <= x["line"])
        own = F.regexp_extract(F.coalesce(F.try_element_at(above, F.lit(-1))["match"], F.lit("")), SPRING_CLASS, 1)
        prefix, p = F.regexp_replace(own, "/+$", ""), group(x, SPRING, 2)
        return F.concat(prefix, F.when((p != "") | (prefix == ""), rooted(p)).otherwise(p))

    spring = F.transform(matches_with_lines(content, SPRING), lambda x: route(x, group(x, SPRING, 1), prefixed(x), group(x, SPRING, 3))).cast(ROUTE)
    ext, none = F.col("ext"), F.array().cast(ROUTE)
    by_family = [
        (ext.isin(JS), plain(EXPRESS, handler=lambda h: F.when(h.isin("async", "function"), "").otherwise(h))), (ext == ".py", F.concat(flask(), plain(FASTAPI))), (ext == ".go", F.concat(plain(GO), handled)),
        (F.col("rel_path").endswith("config/routes.rb"), F.concat(plain(RAILS, rooted), resources())), (ext.isin(".java", ".kt"), spring), (ext == ".php", plain(LARAVEL, rooted)),
    ]
    found, some = none, F.lit(False)
    for cond, column in by_family:
        found, some = F.when(cond, column).otherwise(found), some | cond
    return files.where(some).select("rel_path", F.posexplode(found).alias("ord", "x")).select("rel_path", "x.*", "ord").unionByName(next_routes(files).withColumn("ord", F.lit(0)))


#: What binds names of another file: an import clause, or a name or pattern that takes a require().
IMPORT_CLAUSE = r"\bimport\s+(?:type\s+)?([\w$*{][^'\";=]*?)\s*\bfrom\s*[\"']([^\"'\n]+)[\"']"
REQUIRED = r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*(?:await\s+)?(?:require|import)\(\s*[\"']([^\"'\n]+)[\"']\s*\)"


def bindings(files: DataFrame) -> DataFrame:
    """(rel_path, local, spec, line): the names that JavaScript files bind by imports and requires, renamed ones by their new
    name; `* as x` binds x."""
    content = F.col("content")

    def part(pattern: str) -> Column:
        return F.transform(matches_with_lines(content, pattern), lambda x: F.struct(F.regexp_extract(x["match"], pattern, 1).alias("clause"), F.regexp_extract(x["match"], pattern, 2).alias("spec"), x["line"].alias("line")))

    found = files.where(F.col("ext").isin(JS)).select("rel_path", F.explode(F.concat(part(IMPORT_CLAUSE), part(REQUIRED))).alias("x"))
    pieces = F.split(F.translate("x.clause", "{}", ",,"), ",")
    each = found.select("rel_path", "x.spec", "x.line", F.explode(pieces).alias("piece")).withColumn("piece", F.trim(F.regexp_replace("piece", r"\s+", " ")))
    local = F.regexp_extract(F.regexp_replace("piece", r"\s*=.*$", ""), r"([\w$]+)$", 1)
    return each.select("rel_path", local.alias("local"), "spec", "line").where("local <> ''").distinct()


def route_calls(routes_: DataFrame, blocks: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Routes with the function that handles them: an inline one on the route's line (the n-th route of a line has its n-th
    handler), else a named one of the same file, else of the file that the name is imported from (bound: rel_path, local,
    to_path). A method is found by its own name too. `in_path` and `place` tell which function of which file it is."""
    own = blocks.where("kind = 'function'").select("rel_path", "name", F.col("line").alias("at"), "body", "place")
    nth = lambda order: F.row_number().over(Window.partitionBy("rel_path", "line").orderBy(*order))
    inline = routes_.where("handler = '(inline)'")
    ordered = inline.withColumn("n", nth([*(["ord"] if "ord" in routes_.columns else []), "path", "method"]))
    anonymous = own.where("name = '(anonymous)'").withColumn("line", F.col("at")).withColumn("n", nth(["place"]))
    shown = lambda file: ["rel_path", "method", "path", "name", F.col("at").alias("line"), "body", F.col(file).alias("in_path"), "place"]
    out = ordered.join(sorted_side(anonymous), ["rel_path", "line", "n"]).select(*shown("rel_path"))
    named = routes_.where("handler <> '(inline)'").drop("line")
    by_name = own.withColumn("wanted", F.element_at(F.split("name", r"\."), -1)).groupBy("rel_path", "wanted").agg(F.min(F.struct("at", "name", "body", "place")).alias("f"))
    by_name = by_name.select("rel_path", "wanted", "f.name", "f.at", "f.body", "f.place")
    wanted = F.element_at(F.split("handler", r"\."), -1)
    local = named.withColumn("wanted", wanted).join(sorted_side(by_name), ["rel_path", "wanted"])
    out = out.unionByName(local.select(*shown("rel_path")))
    if bound is None:
        return out
    far = by_name.select(F.col("rel_path").alias("to_path"), "wanted", "name", "at", "body", "place")
    left = named.withColumn("wanted", wanted).join(sorted_side(by_name.select("rel_path", "wanted")), ["rel_path", "wanted"], "left_anti")
    met = left.withColumn("local", F.split("handler", r"\.")[0]).join(sorted_side(bound.select("rel_path", "local", "to_path").distinct()), ["rel_path", "local"]).join(sorted_side(far), ["to_path", "wanted"])
    return out.unionByName(met.select(*shown("to_path")))


def next_path(path: Column) -> Column:
    """URL of a file under app/ or pages/: the page suffix, groups and index go, [id] becomes :id."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(?:src/)?(?:app|pages)", ""), r"\.[jt]sx?$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"/(?:page|route|index)$", ""), r"/\([^)]*\)", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"\[(?:\.\.\.)?(\w+)\]", ":$1"), F.lit("")), F.lit("/"))


def next_routes(files: DataFrame) -> DataFrame:
    p = F.col("rel_path")
    page = p.rlike(r"^(?:src/)?app/(?:.*/)?(?:page|route)\.[jt]sx?$") | (p.rlike(r"^(?:src/)?pages/.*\.[jt]sx?$") & ~p.rlike(r"/_\w+\.[jt]sx?$"))
    api = p.rlike(r"/route\.[jt]s$")
    exported = F.regexp_extract_all("content", F.lit(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE)\b"), 1)
    method = F.when(api & (F.size(exported) > 0), exported).when(api | p.rlike(r"^(?:src/)?pages/api/"), F.array(F.lit("ANY"))).otherwise(F.array(F.lit("GET")))
    return files.where(page).select("rel_path", F.explode(method).alias("method"), next_path(p).alias("path"), F.lit("(file)").alias("handler"), F.lit(1).alias("line"))


#: What opens a model's body; a Django class is a run of indented lines, which needs no counting.
MODEL_HEADS = [
    Head("sql", [".sql"], r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[']?([\w.]+)[\"`\]']?\s*\(", "--", "create"),
    Head("prisma", [".prisma"], r"(?m)^\s*model\s+(\w+)\s*\{", word="model"),
    Head("mongoose", JS, r"(\w+)\s*=\s*new\s+(?:mongoose\.)?Schema\(\s*\{", word="Schema("),
    Head("typeorm", JS, r"@Entity\([^)]*\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{", word="@Entity("),
]
DJANGO = r"(?m)^class\s+(\w+)\([^)\n]*\bModel\)\s*:[^\n]*\n((?:[ \t]++[^\n]*+\n?+|\n)*+)"
#: Statements that a body's fields are, where commas do not part them.
DJANGO_FIELD = r"(?m)^[ \t]+\w+\s*=\s*models\.\w+\([^)]*\)?"
TYPEORM_FIELD = (
    r"@(?:PrimaryGeneratedColumn|PrimaryColumn|Column|CreateDateColumn|UpdateDateColumn|OneToMany|ManyToOne|ManyToMany|OneToOne)"
    r"\((?:[^()]++|\([^()]*+\))*+\)\s*\w+[?!]?\s*:?\s*[\w<>\[\].]*"
)
TABLE_LEVEL = r"(?i)^(?:primary\s+key|unique|index|key|constraint|check|foreign\s+key)\b"
#: Field, type and the rest of a part, by origin.
FIELDS = {
    "sql": r"(?s)^[\"`\[']?(\w+)[\"`\]']?\s+(\w+(?:\s*\([\d\s,]*\))?)(.*)$",
    "prisma": r"(?s)^(\w+)\s+(\w+(?:\[\])?)(\??.*)$",
    "mongoose": r"(?s)^[\"']?(\w+)[\"']?\s*:\s*(?:\{(?:.*?[{,\s])??type\s*:\s*)?\[?\s*([\w.]+)(.*)$",
    "django": r"(?s)^\s*(\w+)\s*=\s*models\.(\w+)\((.*)$",
    "typeorm": r"(?s)^@\w+\(.*\)\s*(\w+)[?!]?\s*:?\s*([\w<>\[\].]*)$",
}
NULLABLE = {"sql": None, "prisma": r"^\?", "mongoose": None, "django": r"null\s*=\s*True", "typeorm": r"nullable\s*:\s*true"}
DEFAULT = {
    "sql": r"(?i)\bdefault\s+([^\s,]+)", "prisma": r"@default\(([^)]*\)?)\)", "mongoose": r"\bdefault\s*:\s*([^\s,}]+)",
    "django": r"\bdefault\s*=\s*([^\s,)]+)", "typeorm": r"\bdefault\s*:\s*([^\s,}]+)",
}
#: Constraints by origin: name and what tells it.
CONSTRAINTS = {
    "sql": [("primary key", r"(?i)\bprimary\s+key\b"), ("unique", r"(?i)\bunique\b"), ("foreign key", r"(?i)\breferences\s")],
    "prisma": [("primary key", r"@id\b"), ("unique", r"@unique\b"), ("foreign key / relation", r"@relation\b")],
    "mongoose": [("unique", r"\bunique\s*:\s*true")],
    "django": [("unique", r"unique\s*=\s*True"), ("foreign key", r"models\.(?:ForeignKey|OneToOneField|ManyToManyField)\(")],
    "typeorm": [("primary key", r"^@Primary"), ("unique", r"unique\s*:\s*true")],
}
REFERENCES = r"(?i)\breferences\s+[\"`\[']?(\w+)[\"`\]']?\s*\(\s*[\"`\[']?(\w+)"
RELATIONS = r"^@(OneToMany|ManyToOne|ManyToMany|OneToOne)\("


def model_parts(files: DataFrame, origins: list[str] | None = None) -> DataFrame:
    """(rel_path, origin, model, line, part): the pieces of each model's body; Prisma's are lines, others' are statements.
    With `origins` only the files that may hold such models are searched."""
    asked = lambda name: origins is None or name in origins
    found = spans(files, [h for h in MODEL_HEADS if asked(h.kind)])
    lines = F.filter(F.transform(F.split("body", "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("@@"))
    pieces = F.when(F.col("kind") == "prisma", lines).when(F.col("kind") == "typeorm", F.regexp_extract_all("body", F.lit(TYPEORM_FIELD), F.lit(0))).otherwise(F.col("parts"))
    braced = found.select("rel_path", F.col("kind").alias("origin"), F.col("name").alias("model"), "line", F.posexplode(pieces).alias("ord", "part"))
    classes = rows(files, [".py"], DJANGO, ("model", 1), ("body", 2))
    statements = F.transform(F.regexp_extract_all("body", F.lit(DJANGO_FIELD), F.lit(0)), lambda s: F.trim(s))
    django = classes.select("rel_path", F.lit("django").alias("origin"), "model", "line", F.posexplode(statements).alias("ord", "part"))
    return braced if not asked("django") else braced.unionByName(django) if any(asked(h.kind) for h in MODEL_HEADS) else django


def models(files: DataFrame, origins: list[str] | None = None) -> DataFrame:
    """(rel_path, origin, model, field, type, line, nullable, default_value, constraints) of SQL tables, Prisma, Django,
    TypeORM and Mongoose models."""
    parts = model_parts(files, origins).where(~((F.col("origin") == "sql") & F.col("part").rlike(TABLE_LEVEL)) & ~F.col("part").rlike(RELATIONS))
    origin, part = F.col("origin"), F.col("part")

    def by_origin(of) -> Column:
        out = F.lit(None)
        for name in FIELDS:
            out = F.when(origin == name, of(name)).otherwise(out)
        return out

    told = lambda name: F.array_compact(F.array(*[F.when(part.rlike(p), c) for c, p in CONSTRAINTS[name]]))
    rest = lambda name: F.regexp_extract(part, FIELDS[name], 3) if name == "prisma" else part
    nullable = {
        "sql": ~part.rlike(r"(?i)\bnot\s+null\b|\bprimary\s+key\b"), "mongoose": ~part.rlike(r"\brequired\s*:\s*true"),
        **{n: rest(n).rlike(p) for n, p in NULLABLE.items() if p},
    }
    return parts.select(
        "rel_path", "origin", "model", by_origin(lambda n: F.regexp_extract(part, FIELDS[n], 1)).alias("field"), by_origin(lambda n: F.regexp_extract(part, FIELDS[n], 2)).alias("type"), "line",
        by_origin(lambda n: nullable[n]).alias("nullable"), F.nullif(by_origin(lambda n: F.regexp_extract(part, DEFAULT[n], 1)), F.lit("")).alias("default_value"), by_origin(told).alias("constraints"),
    ).where("field <> ''")


def relationships(files: DataFrame) -> DataFrame:
    """(rel_path, model, field, type, target): foreign keys of SQL, of its table level too, and relations of Prisma, Django
    and TypeORM."""
    p, parts = F.col("part"), model_parts(files)
    get = lambda pattern, i: F.regexp_extract(p, pattern, i)
    keyed = F.coalesce(F.nullif(get(r"(?i)foreign\s+key\s*\(\s*[\"`']?(\w+)", 1), F.lit("")), get(FIELDS["sql"], 1))
    django = r"^(\w+)\s*=\s*models\.(ForeignKey|OneToOneField|ManyToManyField)\(\s*['\"]?(\w+)?"
    orm = r"(?s)^@(OneToMany|ManyToOne|ManyToMany|OneToOne)\(\s*([^,]*?)\s*(?:,.*)?\)\s*(\w+)[?!]?\s*:?\s*[\w<>\[\].]*$"
    row = lambda field, kind, target: F.struct(field.alias("field"), kind.alias("type"), target.alias("target"))
    found = (
        F.when((F.col("origin") == "sql") & p.rlike(REFERENCES), row(keyed, F.lit("foreignKey"), F.concat(get(REFERENCES, 1), F.lit("."), get(REFERENCES, 2))))
        .when((F.col("origin") == "prisma") & p.rlike(r"@relation\b"), row(get(FIELDS["prisma"], 1), F.lit("relation"), get(FIELDS["prisma"], 2)))
        .when((F.col("origin") == "django") & p.rlike(django), row(get(django, 1), get(django, 2), F.coalesce(F.nullif(get(django, 3), F.lit("")), F.lit("?"))))
        .when((F.col("origin") == "typeorm") & p.rlike(RELATIONS), row(get(orm, 3), get(orm, 1), get(orm, 2)))
    )
    return parts.withColumn("x", found).where("x is not null").select("rel_path", "model", "x.*")
