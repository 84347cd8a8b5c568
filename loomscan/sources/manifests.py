"""Manifests: ecosystems, frameworks, entry points, sub-packages, dependencies, advisories, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions.globs import version_less
from loomscan.functions.text import basename

#: Manifest file, ecosystem, package manager.
MANIFESTS = [
    ("package.json", "Node.js", "npm/yarn/pnpm"), ("requirements.txt", "Python", "pip"), ("pyproject.toml", "Python", "poetry/pip"), ("Pipfile", "Python", "pipenv"), ("go.mod", "Go", "go modules"), ("Cargo.toml", "Rust", "cargo"),
    ("pom.xml", "Java", "maven"), ("build.gradle", "Java/Kotlin", "gradle"), ("build.gradle.kts", "Kotlin", "gradle"), ("Gemfile", "Ruby", "bundler"), ("composer.json", "PHP", "composer"),
]
#: Dependency, framework.
FRAMEWORKS = [
    ("express", "Express"), ("fastify", "Fastify"), ("koa", "Koa"), ("@nestjs/core", "NestJS"), ("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("@angular/core", "Angular"), ("svelte", "Svelte"),
    ("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"), ("sequelize", "Sequelize"), ("typeorm", "TypeORM"), ("prisma", "Prisma"), ("mongoose", "Mongoose"),
]
#: Files that start a program, and folders that hold sub-packages.
ENTRIES = "server.js index.js app.js main.js server.ts index.ts app.ts main.ts main.py app.py manage.py wsgi.py asgi.py main.go cmd/main.go main.rs src/main.rs Program.cs".split()
WORKSPACES = ["packages", "apps", "services", "libs", "modules"]
#: Package and first version without a known fault.
ADVISORIES = [("lodash", "4.17.21"), ("minimist", "1.2.6"), ("express", "4.17.3"), ("axios", "0.21.2"), ("node-fetch", "2.6.7")]
#: Licences without conditions on users, and those with, by severity.
PERMISSIVE = "MIT ISC BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear Apache-2.0 0BSD Unlicense CC0-1.0 WTFPL Zlib Python-2.0 BlueOak-1.0.0".split()
RESTRICTIVE_HIGH = "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later".split()
RESTRICTIVE_MEDIUM = "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MPL-2.0 MPL-1.1 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1".split()
PACKAGE = "dependencies map<string,string>, devDependencies map<string,string>, main string, scripts map<string,string>"
INSTALLED = "name string, version string, license string, licenses array<struct<type:string>>"
TOP = 30
#: Packages asked for at once, ids shown of one.
BATCH, IDS = 500, 3


def app_of(files: DataFrame) -> list[str]:
    """The app column of a table that holds the files of many apps, each with paths from its own root; none for one tree."""
    return ["app_id"] if "app_id" in files.columns else []


def manifests(files: DataFrame, spark: SparkSession) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame(MANIFESTS, "rel_path string, ecosystem string, manager string"))  # a fixed list
    return files.join(dim, "rel_path").select(*app_of(files), "rel_path", "ecosystem", "manager")


def packages(files: DataFrame) -> DataFrame:
    """(rel_path, pkg): parsed package.json files; broken ones are left out."""
    own = files.where(basename(F.col("rel_path")) == "package.json")
    return own.select(*app_of(files), "rel_path", F.from_json("content", PACKAGE).alias("pkg")).where("pkg is not null")


def npm_deps(files: DataFrame) -> DataFrame:
    """(rel_path, name, version): declared dependencies; a development version wins over another."""
    keys = [*app_of(files), "rel_path"]
    own = files.where(basename(F.col("rel_path")) == "package.json")
    row = lambda i: lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(i).alias("kind"))
    listed = [F.coalesce(F.transform(F.map_entries(f"pkg.{k}"), row(i)), F.array()) for i, k in enumerate(("dependencies", "devDependencies"))]
    parsed = own.select(*keys, F.explode(F.array(F.from_json("content", PACKAGE))).alias("pkg"))  # exploded: parsed once
    both = parsed.select(*keys, F.inline(F.concat(*listed)))
    return both.groupBy(*keys, "name").agg(F.max_by("version", "kind").alias("version"))


def lines(files: DataFrame, name: str) -> DataFrame:
    own = files.where(basename(F.col("rel_path")) == name)
    keys = [*app_of(files), "rel_path"]
    return own.select(*keys, F.explode(F.split("content", r"\r?\n")).alias("line")).select(*keys, F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))


def pip_deps(files: DataFrame) -> DataFrame:
    """Pinned requirements only: name==version."""
    r = lines(files, "requirements.txt").where("line rlike '^[A-Za-z0-9]'")
    p = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([0-9][^\s;#,]*)\s*(?:[;#].*)?$"
    return r.where(F.col("line").rlike(p)).select(*app_of(files), "rel_path", F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("version"))


def go_deps(files: DataFrame) -> DataFrame:
    p = r"^(?:require\s+)?([\w.-]+\.[\w.-]+/\S+|[\w.-]+\.[a-z]+)\s+v([0-9]\S*)"
    return lines(files, "go.mod").where(F.col("line").rlike(p)).select(*app_of(files), "rel_path", F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("version"))


def frameworks(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Frameworks by exact name in package.json, and by substring in requirements.txt."""
    dim = F.broadcast(spark.createDataFrame(FRAMEWORKS, "dep string, framework string"))  # a fixed list
    shown = [*app_of(files), "framework"]
    exact = npm_deps(files).join(dim, F.col("name") == F.col("dep")).select(*shown)
    text = files.where("rel_path = 'requirements.txt'").withColumn("c", F.lower("content")).join(dim, F.contains("c", F.col("dep"))).select(*shown)
    return exact.union(text).distinct()


def entry_points(files: DataFrame) -> DataFrame:
    keys = app_of(files)
    fixed = files.where(F.col("rel_path").isin(ENTRIES)).select(*keys, F.col("rel_path").alias("entry"))
    root = packages(files.where("rel_path = 'package.json'"))
    named = root.select(*keys, F.col("pkg.main").alias("entry")).union(root.select(*keys, F.concat(F.lit("npm start: "), F.try_element_at("pkg.scripts", F.lit("start"))).alias("entry")))
    return fixed.union(named.where("entry is not null")).distinct()


def sub_packages(files: DataFrame) -> DataFrame:
    """Folders with a manifest of their own: at the top, or one level down in a workspace folder."""
    parts = F.split("rel_path", "/")
    own = files.where(F.element_at(parts, -1).isin([m for m, *_ in MANIFESTS]))
    direct, nested = F.size(parts) == 2, (F.size(parts) == 3) & parts[0].isin(WORKSPACES)
    return own.where(direct | nested).select(*app_of(files), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("package")).distinct()


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies below an advisory's first good version (name, fixed)."""
    return deps.join(advisories, "name").where(version_less(F.col("version"), F.col("fixed")))


def audit_rows(report: Column) -> Column:
    """Rows of an audit report (JSON text): name, severity, range; null text means the audit was not available."""
    entry = F.from_json(report, "vulnerabilities map<string, struct<severity:string, range:string>>")["vulnerabilities"]
    level = lambda s: F.when(s == "critical", "Critical").when(s == "high", "High").when(s == "moderate", "Medium").otherwise("Low")
    return F.transform(F.map_entries(entry), lambda e: F.struct(e["key"].alias("name"), level(e["value"]["severity"]).alias("severity"), e["value"]["range"].alias("range")))


def capped(rows: DataFrame, order: list, what: str) -> DataFrame:
    """The report's first rows, and one row that says how many more there are."""
    more = rows.agg((F.count(F.lit(1)) - TOP).alias("n")).where("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(f" more {what}")).alias("summary"))
    return rows.orderBy(*order).limit(TOP).unionByName(more, allowMissingColumns=True)


def advisory_hits(answers: DataFrame) -> DataFrame:
    """(name, ids) of a batch's answers (names, results by position): packages with ids, at most TOP of them with at most IDS
    ids each, and a row that says how many more there are."""
    both = F.filter(F.arrays_zip("names", "results"), lambda x: F.size(x["results"]) > 0)
    rows = answers.select(F.transform(F.slice("names", 1, BATCH), lambda n: n).alias("names"), "results").select(both.alias("x"))
    shown = rows.select(F.explode(F.slice("x", 1, TOP)).alias("x")).select(F.col("x.names").alias("name"), F.slice("x.results", 1, IDS).alias("ids"))
    more = rows.where(F.size("x") > TOP).select(F.concat((F.size("x") - TOP).cast("string"), F.lit(" more")).alias("name"), F.array().cast("array<string>").alias("ids"))
    return shown.union(more)


def installed(files: DataFrame) -> DataFrame:
    """(name, version, license) of package.json files under node_modules; the older list form is joined by OR."""
    own = files.where(F.col("rel_path").rlike(r"(^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json$")).select(*app_of(files), F.from_json("content", INSTALLED).alias("p"), F.get_json_object("content", "$.license.type").alias("typed"))
    listed = F.when(F.size("p.licenses") > 0, F.array_join(F.transform("p.licenses", lambda x: x["type"]), " OR "))
    plain = F.when(~F.col("p.license").startswith("{"), F.col("p.license"))
    return own.where("p.name is not null").select(*app_of(files), "p.name", "p.version", F.coalesce("typed", plain, listed).alias("license"))


def license_findings(packages_: DataFrame) -> DataFrame:
    """(name, license, status, severity): any restrictive part of an expression decides, also under OR."""
    parts = F.transform(F.split("license", r"(?i)\s+(?:OR|AND)\s+"), lambda t: F.regexp_replace(F.trim(t), r"^\(|\)$", ""))
    some = lambda names: F.exists(parts, lambda t: t.isin(names))
    missing = F.col("license").isNull() | (F.trim("license") == "")
    status = F.when(missing, "missing").when(some(RESTRICTIVE_HIGH + RESTRICTIVE_MEDIUM), "restrictive").when(F.forall(parts, lambda t: t.isin(PERMISSIVE)), "permissive").otherwise("unrecognized")
    first = F.element_at(F.filter(parts, lambda t: t.isin(RESTRICTIVE_HIGH + RESTRICTIVE_MEDIUM)), 1)
    severity = F.when(missing, "Low").when(some(RESTRICTIVE_HIGH + RESTRICTIVE_MEDIUM), F.when(first.isin(RESTRICTIVE_HIGH), "High").otherwise("Medium")).otherwise("Low")
    return packages_.select(*app_of(packages_), "name", "license", status.alias("status"), severity.alias("severity")).where("status <> 'permissive'")


def installed_versions(files: DataFrame) -> DataFrame:
    """(name, declared, version): declared dependencies with the version that is installed; missing ones are left out."""
    keys = [*app_of(files), "name"]
    declared = npm_deps(files.where("rel_path not like '%node_modules/%'")).select(*keys, F.col("version").alias("declared"))
    return declared.join(installed(files).select(*keys, "version"), keys).select(*keys, "declared", "version")


def dependency_issue(file: Column, severity: Column, category: str, summary: Column, fix: str) -> list[Column]:
    return [file.alias("file"), F.lit(1).alias("line"), severity.alias("severity"), F.lit(category).alias("category"), summary.alias("summary"), F.lit(fix).alias("suggested_fix"), F.lit("dependency-audit").alias("source")]


def advisory_findings(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Findings of declared packages below the first good version of the built-in list."""
    advisories = F.broadcast(spark.createDataFrame(ADVISORIES, "name string, fixed string"))  # a fixed list
    told = F.concat(F.col("name"), F.lit("@"), F.col("version"), F.lit(" is below "), F.col("fixed"))
    own = npm_deps(files.where("rel_path not like '%node_modules/%'"))
    return vulnerable(own, advisories).select(*app_of(files), *dependency_issue(F.col("rel_path"), F.lit("High"), "Outdated/Vulnerable Dependency", told, "Upgrade the package."))


def license_issues(files: DataFrame) -> DataFrame:
    """Findings of installed packages whose licence is restrictive, missing or not recognised."""
    text = F.when(F.col("status") == "missing", F.lit(": no licence")).when(F.col("status") == "restrictive", F.concat(F.lit(": restrictive licence "), F.col("license"))).otherwise(F.concat(F.lit(": unknown licence "), F.col("license")))
    return license_findings(installed(files)).select(*app_of(files), *dependency_issue(F.lit("package.json"), F.col("severity"), "License Compliance", F.concat(F.col("name"), text), "Check that the licence fits."))


def audit_findings(reports: DataFrame) -> DataFrame:
    """Findings of audit reports (tool, report): at most TOP rows a tool and one that counts the rest; a tool without a report
    gives one row that says so. Reports are the scan's own, so a tool's rows fit one array."""
    keys = app_of(reports)
    rows = reports.where("report is not null").select(*keys, "tool", F.array_sort(audit_rows(F.col("report"))).alias("r"))
    shown = rows.select(*keys, "tool", F.explode(F.slice("r", 1, TOP)).alias("x")).select(*keys, "tool", F.col("x.severity").alias("severity"), F.concat("x.name", F.lit(" "), "x.range").alias("summary"))
    more = rows.where(F.size("r") > TOP).select(*keys, "tool", F.lit("Low").alias("severity"), F.concat((F.size("r") - TOP).cast("string"), F.lit(" more advisories")).alias("summary"))
    found = shown.union(more).select(*keys, *dependency_issue(F.lit("package.json"), F.col("severity"), "Outdated/Vulnerable Dependency", F.col("summary"), "Upgrade the package."))
    missing = reports.where("report is null").select(*keys, *dependency_issue(F.lit("package.json"), F.lit("Low"), "Scan Limitation", F.concat(F.col("tool"), F.lit(": not available")), "Run the audit where it is available."))
    return found.union(missing)


def owners(files: DataFrame, rules: list[tuple[str, str]], committers: DataFrame | None = None) -> DataFrame:
    """(rel_path, owner, origin): the last code-owner rule that matches, else the most frequent committer."""
    owner = F.lit(None).cast("string")
    for pattern, name in rules:
        owner = F.when(ignored_by_one(F.col("rel_path"), pattern), name).otherwise(owner)
    keys = [*app_of(files), "rel_path"]
    out = files.select(*keys, owner.alias("ruled"))
    if committers is None:
        return out.select(*keys, F.col("ruled").alias("owner"), F.when(F.col("ruled").isNotNull(), "rule").alias("origin"))
    most = committers.groupBy("rel_path").agg(F.mode("author", deterministic=True).alias("author"))
    return out.join(most, "rel_path", "left").select("rel_path", F.coalesce("ruled", "author").alias("owner"), F.when(F.col("ruled").isNotNull(), "rule").when(F.col("author").isNotNull(), "commits").alias("origin"))


def ignored_by_one(path: Column, pattern: str) -> Column:
    from loomscan.functions.globs import gitignore_rules

    (rule,) = gitignore_rules(pattern)
    return path.rlike(rule[2])
