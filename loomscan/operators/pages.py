"""Documentation pages and messages as rows: (app_id, path, content) and (app_id, text).

A page's lines are made in columns and joined in order inside one aggregate of its key (a file, a model, a route
group, an app's change), so no page is put together on the driver. Inputs carry `app_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions.text import folded, slug
from loomscan.operators.state import rank

NONE = "_none found_"


def ticked(c: Column | str) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def in_order(*order: Column | str, text: Column) -> Column:
    """The group's texts in an order, one a line."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def page(path: Column, title: Column, body: Column) -> list[Column]:
    return [path.alias("path"), F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n")).alias("content")]


def component_pages(components: DataFrame) -> DataFrame:
    """One page a top folder, from (app_id, rel_path, kind, name, extra, line): a section a file, its imports, classes
    and functions."""
    some = lambda kind, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", "name", text.alias("text"))))), lambda r: r["text"]), "\n")
    imports = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("kind") == "import", F.col("name")))), ticked), ", ")
    line = F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    base = F.when(F.col("extra") != "", F.concat(F.lit(" of "), ticked("extra"))).otherwise("")
    files = components.groupBy("app_id", "rel_path").agg(
        imports.alias("imports"), some("class", F.concat(F.lit("- "), ticked("name"), base, line)).alias("classes"),
        some("function", F.concat(F.lit("- "), ticked(F.concat(F.col("name"), F.lit("("), F.col("extra"), F.lit(")"))), line)).alias("functions"),
    )
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n\n**{title}**\n\n"), F.col(c))).otherwise("")
    bare = F.when((F.col("classes") == "") & (F.col("functions") == ""), F.lit(f"\n\n{NONE}")).otherwise("")
    section = F.concat(F.lit("## "), ticked("rel_path"), part("Imports", "imports"), part("Classes", "classes"), part("Functions", "functions"), bare, F.lit("\n"))
    unit = F.when(F.contains("rel_path", F.lit("/")), F.element_at(F.split("rel_path", "/"), 1)).otherwise("root")
    pages = files.groupBy("app_id", unit.alias("unit")).agg(in_order("rel_path", text=section).alias("body"))
    return pages.select("app_id", *page(F.concat(F.lit("Components/"), slug(F.col("unit")), F.lit(".md")), F.concat(F.lit("Components: "), F.col("unit")), F.col("body")))


def dictionary_pages(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """One page a model, from (app_id, rel_path, origin, model, field, type, line) and (model, field, written, generated):
    a person's text before a generated one."""
    known = fields.join(texts, ["model", "field"], "left")
    said = F.coalesce(F.concat("written", F.lit(" _(edited)_")), F.concat("generated", F.lit(" _(generated)_")), F.lit("—"))
    row = F.concat(F.lit("| "), ticked("field"), F.lit(" | "), F.col("type"), F.lit(" | "), said, F.lit(" |"))
    models = known.groupBy("app_id", "rel_path", "origin", "model", "line").agg(in_order("field", text=row).alias("rows"))
    source = F.concat(F.lit("Source: "), F.col("origin"), F.lit(", "), ticked("rel_path"), F.lit(", line "), F.col("line").cast("string"))
    body = F.concat(source, F.lit("\n\n| Field | Type | Description |\n|---|---|---|\n"), F.col("rows"))
    return models.select("app_id", *page(F.concat(F.lit("Data-Dictionary/"), slug(F.col("model")), F.lit(".md")), F.col("model"), body))


def model_pages(fields: DataFrame, routes: DataFrame) -> DataFrame:
    """One page an app: its models with their number of fields, and its routes."""
    models = fields.groupBy("app_id", "rel_path", "origin", "model").agg(F.count(F.lit(1)).cast("string").alias("n"))
    table = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    m = models.groupBy("app_id").agg(in_order("model", "rel_path", text=table("model", "origin", ticked("rel_path"), "n")).alias("m"))
    r = routes.groupBy("app_id").agg(in_order("path", "method", "rel_path", text=table("method", ticked("path"), ticked("handler"), ticked("rel_path"))).alias("r"))
    part = lambda title, head, c: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.concat(F.lit(head), F.col(c)), F.lit(NONE)))
    body = F.concat(part("Models", "| Model | Source | File | Fields |\n|---|---|---|---|\n", "m"), F.lit("\n\n"), part("Routes", "| Method | Path | Handler | File |\n|---|---|---|---|\n", "r"))
    return m.join(r, "app_id", "full").select("app_id", *page(F.lit("Data-Model.md"), F.lit("Data Model"), body))


def route_group(path: Column) -> Column:
    """First segment of a route's path without parameters, capitalised; `Root` if there is none."""
    first = F.regexp_extract(path, r"^/*([^/:{<]*)", 1)
    return F.when(first == "", "Root").otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2))))


def flow_pages(routes: DataFrame) -> DataFrame:
    """One page a route group, from (app_id, method, path, handler, rel_path, line, steps): the steps numbered."""
    steps = F.coalesce(F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"), F.lit(""))
    section = F.concat(F.lit("## "), F.col("method"), F.lit(" "), ticked("path"), F.lit("\n\nHandled in "), ticked("rel_path"), F.lit(" (line "), F.col("line").cast("string"), F.lit(") by "), ticked("handler"), F.lit(".\n\n"), steps, F.lit("\n"))
    groups = routes.groupBy("app_id", route_group(F.col("path")).alias("grp")).agg(in_order("path", "method", "rel_path", "line", text=section).alias("body"))
    return groups.select("app_id", *page(F.concat(F.lit("Process-Flows/"), slug(F.col("grp")), F.lit(".md")), F.concat(F.lit("Process Flow: "), F.col("grp")), F.col("body")))


def home_pages(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """One page an app: active findings by severity (app_id, severity, n), and links to its other pages."""
    c = counts.groupBy("app_id").agg(in_order(rank(F.col("severity")).alias("r"), text=F.concat(F.lit("- "), F.col("severity"), F.lit(": "), F.col("n").cast("string"))).alias("c"))
    link = F.concat(F.lit("- ["), F.regexp_replace("path", r"\.md$", ""), F.lit("]("), F.col("path"), F.lit(")"))
    p = pages.groupBy("app_id").agg(in_order("path", text=link).alias("p"))
    body = F.concat(F.lit("## Findings\n\n"), F.coalesce("c", F.lit(NONE)), F.lit("\n\n## Pages\n\n"), F.coalesce("p", F.lit(NONE)))
    return c.join(p, "app_id", "full").select("app_id", *page(F.lit("Home.md"), F.lit("Home"), body))


def change_pages(changes: DataFrame) -> DataFrame:
    """One page an app, from (app_id, scanned_at, change, n): its scans, newest first."""
    scans = changes.groupBy("app_id", "scanned_at").agg(F.sum(F.when(F.col("change") == "new", F.col("n")).otherwise(0)).alias("new"), F.sum(F.when(F.col("change") == "resolved", F.col("n")).otherwise(0)).alias("gone"))
    line = F.concat(F.lit("- "), F.date_format("scanned_at", "yyyy-MM-dd"), F.lit(": "), F.col("new").cast("string"), F.lit(" new, "), F.col("gone").cast("string"), F.lit(" resolved"))
    return scans.groupBy("app_id").agg(in_order((-F.unix_micros(F.col("scanned_at").cast("timestamp"))).alias("t"), text=line).alias("body")).select("app_id", *page(F.lit("Change-Log.md"), F.lit("Change Log"), F.col("body")))


def progress_pages(units: DataFrame) -> DataFrame:
    """One page an app, from (app_id, unit, ord, status): how far the scan of each folder is."""
    row = F.concat(F.lit("| "), F.col("unit"), F.lit(" | "), F.coalesce("status", F.lit("Not Started")), F.lit(" |"))
    body = F.concat(F.lit("| Directory | Status |\n|---|---|\n"), in_order("ord", "unit", text=row))
    return units.groupBy("app_id").agg(body.alias("body")).select("app_id", *page(F.lit("Progress.md"), F.lit("Progress"), F.col("body")))


def architecture_pages(apps: DataFrame, folders: DataFrame, manifests: DataFrame, entries: DataFrame, routes: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One page an app (app_id, models): its folders (path, level), manifests (rel_path, ecosystem, manager), entries (entry),
    and route groups (method, path); a generated note (text) comes first. All sides carry app_id."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    last = F.element_at(F.split("path", "/"), -1)
    by_app = lambda rows, name, *order, text: rows.groupBy("app_id").agg(in_order(*order, text=text).alias(name))
    tree = by_app(folders, "tree", "path", text=F.concat(indent, F.lit("- "), last, F.lit("/")))
    stack = by_app(manifests, "stack", "rel_path", text=F.concat(F.lit("- **"), F.col("ecosystem"), F.lit("**: "), ticked("rel_path"), F.lit(", "), F.col("manager")))
    starts = by_app(entries, "starts", "entry", text=F.concat(F.lit("- "), ticked("entry")))
    n = routes.groupBy("app_id", route_group(F.col("path")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- ["), F.col("grp"), F.lit("](Process-Flows/"), slug(F.col("grp")), F.lit(".md): "), F.col("n").cast("string"), F.lit(" routes"))
    flows = n.groupBy("app_id").agg(in_order("grp", text=line).alias("flows"), F.sum("n").alias("routes"), F.count(F.lit(1)).alias("groups"))
    out = apps
    for side in (tree, stack, starts, flows):
        out = out.join(side, "app_id", "left")
    out = out.join(notes.select("app_id", F.col("text").alias("note")), "app_id", "left") if notes is not None else out.withColumn("note", F.lit(None).cast("string"))
    part = lambda title, c, none=NONE: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(c, F.lit(none)), F.lit("\n\n"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    flow = F.concat(count("routes"), F.lit(" routes in "), count("groups"), F.lit(" groups, "), count("models"), F.lit(" models."))
    body = F.concat(
        F.coalesce(F.concat("note", F.lit("\n\n_(generated)_\n\n")), F.lit("")), part("Directory Structure", F.concat(F.lit("```\n"), F.col("tree"), F.lit("\n```"))),
        part("Tech Stack", F.col("stack")), part("Entry Points", F.col("starts")), part("Data Flow", flow), F.lit("## Process Flow Groups\n\n"), F.coalesce("flows", F.lit(NONE)),
    )
    return out.select("app_id", *page(F.lit("Architecture.md"), F.lit("Architecture"), body))


def no_flow_pages(apps: DataFrame, routes: DataFrame) -> DataFrame:
    """One page for each app (app_id, frameworks) without any route."""
    bare = apps.join(routes.select("app_id").distinct(), "app_id", "left_anti")
    names = F.when(F.size("frameworks") > 0, F.array_join(F.array_sort("frameworks"), ", ")).otherwise("none")
    body = F.concat(F.lit("No entry points were detected, so there is nothing to show.\n\nDetected frameworks: "), names, F.lit("."))
    return bare.select("app_id", *page(F.lit("Process-Flows.md"), F.lit("Process Flows"), body))


def tracker_payloads(issues: DataFrame) -> DataFrame:
    """Title and body under which a finding is filed with an issue tracker; the call itself is made elsewhere."""
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))
    title = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("category"), F.lit(" — "), place)
    body = F.concat(F.col("summary"), F.lit("\n\nFile: "), ticked(place), F.lit("\nSeverity: "), F.col("severity"), F.lit("\nCategory: "), F.col("category"))
    if "fix" in issues.columns:
        body = F.concat(body, F.coalesce(F.concat(F.lit("\n\nSuggested fix: "), F.col("fix")), F.lit("")))
    return issues.select("app_id", "fingerprint", title.alias("title"), body.alias("body"))


def digest_texts(counts: DataFrame, days: int = 7) -> DataFrame:
    """(app_id, text) from (app_id, name, new, resolved, active)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return counts.select("app_id", F.concat(F.lit("Digest of "), F.col("name"), F.lit(": "), n("new"), F.lit(" new, "), n("resolved"), F.lit(f" resolved in {days} days, "), n("active"), F.lit(" active")).alias("text"))


def resolve_pages(wanted: DataFrame, overrides: DataFrame, own: DataFrame, packages: DataFrame) -> DataFrame:
    """(app_id, path, content, origin): an edited page before the app's own, and that before a package's; paths that
    leave the folder find nothing."""
    clean = wanted.where(~F.col("path").startswith("/") & ~folded(F.col("path")).startswith(".."))
    for name, side in (("edited", overrides), ("own", own), ("package", packages)):
        clean = clean.join(side.select("app_id", "path", F.col("content").alias(name)), ["app_id", "path"], "left")
    origin = F.when(F.col("edited").isNotNull(), "edited").when(F.col("own").isNotNull(), "own").when(F.col("package").isNotNull(), "package")
    return clean.select("app_id", "path", F.coalesce("edited", "own", "package").alias("content"), origin.alias("origin"))
