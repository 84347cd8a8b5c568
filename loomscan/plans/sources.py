"""Source files that Spark derives from `part`: every part is an app, and its columns go into the files' texts.

A template names a path and a text; marks in both are replaced by expressions over the part's columns. The expressions are
SQL that both engines read alike, so a twin builds the same files and parses them with its own regular expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.plans.portfolio import QUERIES, SQL
from loomscan.sources.fixtures import read

#: Every mark begins with it.
SIGN = "§"
#: Marks and what they stand for.
MARKS = {
    "§k": "concat('', p_partkey)",
    "§n": "concat('', p_size)",
    "§w": "replace(p_name, ' ', '_')",
    "§b": "p_brand",
    "§t": "lower(p_type)",
}


def quoted(v: object) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return "." + name.rpartition(".")[2] if "." in name else ""


#: Parts that a task takes; their files are some 20 MB.
PARTS = 2000


def spread(parts: DataFrame) -> DataFrame:
    """Parts in tasks of PARTS. A part is a few bytes and its files are kilobytes, so the splits of a scan, which go by bytes
    and end at row groups, would leave the whole table to one task."""
    return parts.repartition(max(1, -(-parts.count() // PARTS)))


class Tree:
    """Templates of one kind of app: {path: text}, with marks of their own."""

    def __init__(self, templates: dict[str, str], marks: dict[str, str] | None = None):
        self.templates, self.marks = templates, MARKS | (marks or {})

    def filled(self, column: str) -> str:
        for mark, expr in self.marks.items():
            column = f"replace({column}, '{mark}', {expr})"
        return column

    def text(self, template: str) -> Column:
        """A template put together in one go from what stands between its marks and the columns of their values."""
        known = {mark: F.col(f"mark_{i}") for i, mark in enumerate(self.marks)}
        return F.concat(F.lit(""), *[known.get(x, F.lit(x)) for x in re.split("(" + "|".join(map(re.escape, known)) + ")", template) if x])

    def files(self, spark: SparkSession, sf: str, keep: str = "true") -> DataFrame:
        """(app_id, rel_path, ext, size_bytes, mtime_ms, content); parts are dealt out, and each makes its own files. Their names
        come first: a text is put together once, and only for files whose path and extension a query asks for. Values of marks
        are made once a part; where one holds the sign of marks or is null, marks are replaced one after the other as in SQL."""
        values = [F.col(f"mark_{i}") for i in range(len(self.marks))]
        valued = spread(read(spark, sf, "part")).select("*", *[F.expr(expr).alias(f"mark_{i}") for i, expr in enumerate(self.marks.values())])
        odd = F.coalesce(F.contains(F.concat(*values), F.lit(SIGN)), F.lit(True))
        heads = [F.struct(F.lit(i).alias("nth"), F.lit(p).alias("path"), self.text(p).alias("plain"), F.lit(extension(p)).alias("ext")) for i, p in enumerate(self.templates)]

        def in_turn(template: Column) -> Column:
            for mark, value in zip(self.marks, values):
                template = F.replace(template, F.lit(mark), value)
            return template

        def of_nth(texts: list[Column]) -> Column:
            out = F.when(F.col("nth") == 0, texts[0])
            for i, t in enumerate(texts[1:], 1):
                out = out.when(F.col("nth") == i, t)
            return out

        path = F.when(F.col("odd"), in_turn(F.col("path"))).otherwise(F.col("plain"))
        named = valued.select("*", odd.alias("odd")).select("*", F.inline(F.array(*heads))).select("*", path.alias("rel_path")).where(keep)
        text = F.when(F.col("odd"), in_turn(of_nth([F.lit(t) for t in self.templates.values()]))).otherwise(of_nth([self.text(t) for t in self.templates.values()]))
        made = named.select("*", F.explode(F.array(text)).alias("content"))  # exploded: a filter on content does not make it again
        return made.select(F.col("p_partkey").alias("app_id"), "rel_path", "ext", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_ms"), "content")

    def sql(self, name: str = "code", where: str = "true") -> str:
        """The same table as a common table expression; `where` sees the template's path."""
        rows = ", ".join(f"({quoted(p)}, {quoted(extension(p))}, {quoted(t)})" for p, t in self.templates.items())
        return f"""{name} AS (SELECT p_partkey AS app_id, {self.filled("path")} AS rel_path, ext, {self.filled("text")} AS content
FROM part CROSS JOIN (VALUES {rows}) AS template(path, ext, text) WHERE {where})"""


def matches(pattern: str, text: str = "content", where: str = "true", source: str = "code") -> str:
    """SQL: (app_id, rel_path, content, m, line) of a pattern's matches, lines counted over the pieces between them."""
    p = quoted(pattern)
    return f"""SELECT app_id, rel_path, content, ms[i] AS m, (1 + len(regexp_replace(array_to_string(parts[1 : i], '') || array_to_string(ms[1 : i - 1], ''), '[^\\n]', '', 'g')))::int AS line
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT app_id, rel_path, content, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS parts
  FROM (SELECT app_id, rel_path, content, {text} AS t FROM {source} WHERE {where})))"""


def lines(where: str = "true", source: str = "code") -> str:
    """SQL: (app_id, rel_path, l, line) of the lines of files."""
    split = "string_split(content, chr(10))"
    return f"SELECT app_id, rel_path, unnest({split}) AS l, unnest(range(1, len({split}) + 1))::int AS line FROM {source} WHERE {where}"


def register(name: str, make, sql: str, doc: str) -> None:
    """A query over files; make(spark, sf)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return make(spark, sf)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], SQL[name] = run, sql
