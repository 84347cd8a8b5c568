"""Pages and texts: issue pages, link rewriting, flat wiki names, flowcharts, a small Markdown renderer."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.text import folded, html_escaped
from loomscan.operators.state import rank


def issue_pages(active: DataFrame) -> DataFrame:
    """(app_id, page, content): each app's active findings, worst first."""
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("` "), F.col("category"), F.lit(": "), F.col("summary"))
    rows = active.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct(rank(F.col("severity")).alias("r"), "file", "line", "category", "summary", line.alias("text")))).alias("x"))
    return rows.select("app_id", F.lit("Issues.md").alias("page"), F.concat(F.lit("# Issues\n\n"), F.array_join(F.transform("x", lambda i: i["text"]), "\n"), F.lit("\n")).alias("content"))


def flowchart(edges: DataFrame, key: str = "entry") -> DataFrame:
    """(entry, text): Mermaid text of edges (entry, src, dst); labels over 80 characters are cut and say so."""
    plain = lambda c: F.replace(F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    label = lambda c: F.when(F.length(c) > 80, F.concat(F.substring(plain(c), 1, 79), F.lit("…"))).otherwise(plain(c))
    node = lambda c: F.concat(F.lit("n"), F.substring(F.sha1(F.col(c).cast("binary")), 1, 12), F.lit('["'), label(c), F.lit('"]'))
    line = F.concat(F.lit("  "), node("src"), F.lit(" --> "), node("dst"))
    return edges.groupBy(key).agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("text"))


def flat_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.md$", ""), F.lit("/"), F.lit("-"))


def links(pages: DataFrame) -> DataFrame:
    """(app_id, path, target, meant): a page's links to other pages, as written, and the page that each means: targets are
    read from the page's folder. Pages without app_id are one app's."""
    keys = [*(["app_id"] if "app_id" in pages.columns else []), "path"]
    written = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\]\(([^)#\s]+\.md)(?:#[^)]*)?\)"), 1)))
    found = pages.select(*keys, written.alias("target")).where(~F.col("target").rlike("^https?://"))
    return found.withColumn("meant", folded(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("target"))))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links, as written, whose page does not exist."""
    keys = ["app_id"] if "app_id" in pages.columns else []
    return links(pages).join(pages.select(*keys, F.col("path").alias("meant")), [*keys, "meant"], "left_anti").select(*keys, "path", "target")


def to_html(text: Column) -> Column:
    """Headings, lists, emphasis, code and links of Markdown; everything else is escaped text."""
    t = html_escaped(text)
    for i in range(6, 0, -1):
        t = F.regexp_replace(t, rf"(?m)^#{{{i}}}\s+(.*)$", f"<h{i}>$1</h{i}>")
    for pattern, to in ((r"(?m)^[-*]\s+(.*)$", "<li>$1</li>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"\*([^*\n]+)\*", "<em>$1</em>"), (r"\[([^\]]+)\]\(([^)\s]+)\.md\)", '<a href="$2.html">$1</a>'), (r"\[([^\]]+)\]\((https?:[^)\s]+)\)", '<a href="$2">$1</a>'), (r"(?m)^(?!<(?:h\d|li|ul))(.+)$", "<p>$1</p>"), (r"(?s)((?:<li>[^\n]*</li>\n?)+)", "<ul>$1</ul>")):
        t = F.regexp_replace(t, pattern, to)
    return t


def webhook_text(new_issues: DataFrame, threshold: str, lines: int = 10) -> DataFrame:
    """(app_id, text): the first findings at the threshold or worse, and how many more there are; tasks keep only an
    app's first ones before the shuffle."""
    from loomscan.operators.state import at_least

    bad = new_issues.where(at_least(F.col("severity"), threshold)).select("app_id", rank(F.col("severity")).alias("r"), "file", "line", "summary")
    first = bad.withColumn("rn", F.row_number().over(Window.partitionBy("app_id").orderBy("r", "file", "line", "summary"))).where(F.col("rn") <= lines)
    line = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("summary"))
    shown = first.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("text")))).alias("x"))
    both = shown.join(bad.groupBy("app_id").agg(F.count(F.lit(1)).alias("n")), "app_id")
    more = F.when(F.col("n") > lines, F.concat(F.lit("\n+ "), (F.col("n") - lines).cast("string"), F.lit(" more"))).otherwise("")
    return both.select("app_id", F.concat(F.array_join(F.transform("x", lambda i: i["text"]), "\n"), more).alias("text"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """(path, content) rows as a table, one folder an app: the engine's site output."""
    pages.write.mode("overwrite").parquet(folder)


SITE = "app_id long, path string, html string"


def targets(pages: DataFrame) -> DataFrame:
    """(app_id, path, links): for each page a map of its link targets, as written, to the pages that they mean and that
    exist."""
    known = pages.select("app_id", F.col("path").alias("meant")).distinct()
    own = links(pages).join(known, ["app_id", "meant"])
    return own.groupBy("app_id", "path").agg(F.map_from_entries(F.collect_set(F.struct("target", "meant"))).alias("links"))


def flat_wiki(pages: DataFrame) -> DataFrame:
    """(app_id, path, content): page names without folders, links to pages that exist rewritten to those names."""
    linked = pages.join(targets(pages), ["app_id", "path"], "left")
    pairs = F.coalesce(F.map_entries("links"), F.array().cast("array<struct<key:string,value:string>>"))
    text = F.aggregate(pairs, F.col("content"), lambda acc, e: F.replace(acc, F.concat(F.lit("]("), e["key"], F.lit(")")), F.concat(F.lit("]("), F.replace(e["value"], F.lit("/"), F.lit("-")), F.lit(")"))))
    return linked.select("app_id", F.replace("path", F.lit("/"), F.lit("-")).alias("path"), text.alias("content"))


def inline(text: str, links: dict[str, str]) -> str:
    """Code, emphasis and links of one line; a link to a page that does not exist is its text."""

    def link(m: re.Match) -> str:
        label, target = m.groups()
        if re.match("https?://", target):
            return f'<a href="{target}" target="_blank" rel="noopener">{label}</a>'
        meant = links.get(html.unescape(target))
        return f'<a href="{meant.removesuffix(".md")}.html">{label}</a>' if meant else label

    out = re.sub("`([^`]+)`", r"<code>\1</code>", html.escape(text, quote=True).replace("&#x27;", "'"))
    return re.sub(r"\[([^\]]+)\]\(([^)]+)\)", link, re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", out))


def kind_of(line: str) -> str:
    return (
        "row" if re.match(r"\s*\|.*\|\s*$", line) else "item" if re.match(r"-\s+", line) else "number" if re.match(r"\d+\.\s+", line)
        else "head" if re.match(r"#{1,6}\s+", line) else "rule" if line.strip() == "---" else "text" if line.strip() else "blank"
    )


def markdown_html(text: str, links: dict[str, str]) -> str:
    """HTML of a page: runs of lines of one kind become tables, lists and code blocks."""
    marked, code = [], 0
    for line in text.replace("\r\n", "\n").split("\n"):
        fence = line.startswith("```")
        code += fence
        marked.append(("fence" if fence else "code" if code % 2 else kind_of(line), line))
    out: list[str] = []
    opened = False
    for kind, run in groupby(marked, lambda x: x[0]):
        lines = [line for _, line in run]
        if kind == "fence":
            for _ in lines:
                out.append("</code></pre>" if opened else "<pre><code>")
                opened = not opened
        elif kind == "code":
            out += [html.escape(line).replace("&#x27;", "'") for line in lines]
        elif kind == "row":
            cells = [[c.strip() for c in line.strip()[1:-1].split("|")] for line in lines]
            rows = [c for c in cells if not all(re.fullmatch("-+", x) for x in c)]
            tagged = [("th" if i == 0 else "td", c) for i, c in enumerate(rows)]
            out += ["<table>", *("<tr>" + "".join(f"<{t}>{inline(x, links)}</{t}>" for x in c) + "</tr>" for t, c in tagged), "</table>"]
        elif kind in ("item", "number"):
            tag = "ul" if kind == "item" else "ol"
            out += [f"<{tag}>", *(f"<li>{inline(re.sub(r'^(?:-|[0-9]+[.])[ ]+', '', line), links)}</li>" for line in lines), f"</{tag}>"]
        elif kind == "head":
            for line in lines:
                mark, _, title = line.partition(" ")
                out.append(f"<h{len(mark)}>{inline(title.strip(), links)}</h{len(mark)}>")
        else:
            out += ["<hr>" if kind == "rule" else "" if kind == "blank" else f"<p>{inline(line, links)}</p>" for line in lines]
    return "\n".join(out)


def site(pages: DataFrame) -> DataFrame:
    """(app_id, path, html) of pages (app_id, path, content): every page, and an index that leads to Home where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                made = [markdown_html(t or "", dict(x or ())) for t, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], names=["app_id", "path", "html"])

    linked = pages.select("app_id", "path", "content").join(targets(pages), ["app_id", "path"], "left").select("app_id", "path", "content", "links")
    body = linked.mapInArrow(run, SITE).select("app_id", F.regexp_replace("path", r"\.md$", ".html").alias("path"), "html")
    home = pages.where("path = 'Home.md'").select("app_id", F.lit("index.html").alias("path"), F.lit('<a href="Home.html">Continue</a>').alias("html"))
    return body.unionByName(home)


def portfolio_index(apps: DataFrame, pages: DataFrame) -> DataFrame:
    """(app_id, row, exported): a table row for each app (app_id, name, environment, status, slug, issues), with its pages or the
    reason why there are none."""
    n = pages.groupBy("app_id").agg(F.count(F.lit(1)).alias("pages"))
    own = apps.join(n, "app_id", "left").withColumn("exported", F.col("pages").isNotNull())
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    name = F.when(F.col("exported"), F.concat(F.lit('<a href="'), F.col("slug"), F.lit('/Home.html">'), html_escaped(F.col("name")), F.lit("</a>"))).otherwise(html_escaped(F.col("name")))
    last = F.when(F.col("exported"), F.concat(F.col("pages").cast("string"), F.lit(" page(s)"))).otherwise(F.lit("No wiki generated yet"))
    issues = F.coalesce(F.col("issues").cast("string"), F.lit("—"))
    environment = F.coalesce(F.nullif("environment", F.lit("")), F.lit("—"))
    row = F.concat(F.lit("<tr>"), cell(name), cell(environment), cell(F.col("status")), cell(issues), cell(last), F.lit("</tr>"))
    return own.select("app_id", row.alias("row"), "exported")
