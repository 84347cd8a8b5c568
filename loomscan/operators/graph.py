"""Import graph: candidate paths, edges, files that nothing refers to, budgeted traces, and the stored graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscan.functions.joins import sorted_side
from loomscan.functions.text import basename, folded
from loomscan.sources.stores import cut, hadoop

#: Suffixes tried in this order when an import names no file.
SUFFIXES = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", "/index.js", "/index.ts", "/__init__.py"]


def based(imports: DataFrame) -> DataFrame:
    """Relative imports with `base`: the path that they name, without a suffix."""
    folder = F.regexp_replace("from_path", "[^/]*$", "")
    python = F.col("from_path").endswith(".py")
    spec = F.when(python & F.col("spec").startswith("."), F.concat(F.lit("./"), F.replace(F.ltrim(F.col("spec"), F.lit(".")), F.lit("."), F.lit("/")))).when(python, F.replace(F.col("spec"), F.lit("."), F.lit("/"))).otherwise(F.col("spec"))
    base = F.when(spec.startswith("."), folded(F.concat(folder, spec))).when(python, spec)
    return imports.withColumn("base", base).where("base is not null")


def candidates(imports: DataFrame) -> DataFrame:
    """(from_path, target, ord): paths that an import (from_path, spec) may mean, relative ones only, best first."""
    kept = [c for c in ("from_path", "spec", "place") if c in imports.columns]
    tries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("suffix")) for i, s in enumerate(SUFFIXES)])
    return based(imports).select(*kept, "base", F.explode(tries).alias("t")).select(*kept, F.concat("base", "t.suffix").alias("target"), F.col("t.ord").alias("ord"))


def existing(imports: DataFrame, files: DataFrame) -> DataFrame:
    """candidates() that are files of the tree. Each file tells by which bases it may be meant, some two, so that an import is
    one row of the join and not one for each suffix."""
    path = F.col("rel_path")
    bases = [F.when(path.endswith(s), F.struct(path.substr(F.lit(1), F.length(path) - len(s)).alias("base"), F.lit(i).alias("ord"))) for i, s in enumerate(SUFFIXES)]
    named = files.select(path.alias("target"), F.inline(F.array_compact(F.array(*bases))))
    kept = [c for c in ("from_path", "spec", "place") if c in imports.columns]
    return based(imports).select(*kept, "base").join(sorted_side(named), "base").select(*kept, "target", "ord")


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (from_path, to_path): the first candidate that exists, no file to itself. If imports tell their place
    (`ord`), so do edges: the place of the first import that leads there."""
    placed = "ord" in imports.columns
    place = F.col("ord") if placed else F.lit(0)
    hit = existing(imports.select("from_path", "spec", place.alias("place")), files)
    first = hit.groupBy("from_path", "spec").agg(F.min(F.struct("ord", "target")).alias("m"), F.min("place").alias("place"))
    met = first.groupBy("from_path", F.col("m.target").alias("to_path")).agg(F.min("place").alias("ord")).where("from_path <> to_path")
    return met if placed else met.drop("ord")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, spec, to_path): the file that each import means, if the tree has it."""
    hit = existing(imports.select("from_path", "spec"), files)
    return hit.groupBy("from_path", "spec").agg(F.min(F.struct("ord", "target")).alias("m")).select("from_path", "spec", F.col("m.target").alias("to_path"))


def unreferenced(imports: DataFrame, files: DataFrame, entries: Column | None = None) -> DataFrame:
    """Files that no import may mean (every candidate counts, self references too), entry files excepted."""
    left = files.join(sorted_side(candidates(imports).select(F.col("target").alias("rel_path"))), "rel_path", "left_anti")
    return left if entries is None else left.where(~entries)


def entry_like(path: Column, names: list[str]) -> Column:
    """A basename that begins or contains an entry's basename is exempt."""
    out = F.lit(False)
    for name in names:
        out = out | F.contains(basename(path), F.lit(name)) | F.lit(name).startswith(F.regexp_replace(basename(path), r"\.[^.]*$", ""))
    return out


def trace(starts: DataFrame, calls: DataFrame, hops: int = 2, budget: int = 25) -> DataFrame:
    """(start, node, depth, rn): nodes reached within `hops` calls(src, dst, ord), at most `budget` a start, in order of
    depth, then of the calls on the way, then of the node.

    A frontier goes from hop to hop: what was seen leaves by an anti-join, what is new is ranked and cut to the budget that
    is left before it goes on, so a start has `budget` rows at most at any time and paths never multiply. A frontier node
    can meet no more than `budget` nodes that were seen, so of its calls only the first 2 * budget matter. Each hop is
    stored, which cuts the plan's lineage.
    """
    by_call = Window.partitionBy("src").orderBy("ord", "dst")
    firsts = calls.groupBy("src", "dst").agg(F.min("ord").cast("int").alias("ord")).withColumn("n", F.row_number().over(by_call)).where(F.col("n") <= 2 * budget).drop("n")
    firsts = cut(firsts, "firsts")  # each hop reads them
    level = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("way"), F.lit(1).alias("rn"))
    level = cut(level, "trace")
    seen = level
    for depth in range(1, hops + 1):
        reached = level.join(sorted_side(firsts), F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("way", F.array("ord"))).alias("way"))
        fresh = reached.join(sorted_side(seen.select("start", "node")), ["start", "node"], "left_anti")
        held = seen.groupBy("start").agg(F.max("rn").alias("held"))
        ranked = fresh.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("way", "node"))).where(F.col("n") <= budget).join(sorted_side(held), "start")
        kept = ranked.withColumn("rn", (F.col("held") + F.col("n")).cast("int")).where(F.col("rn") <= budget)
        level = cut(kept.select("start", "node", F.lit(depth).alias("depth"), "way", "rn"), "trace")
        seen = seen.unionByName(level)
    return seen.select("start", "node", "depth", "rn")


GRAPH = "kind string, src string, dst string, ord long, app_id long"


def write_graph(apps: DataFrame, nodes: DataFrame, edges_: DataFrame, path: str) -> None:
    """Store the graphs of some apps (app_id): nodes (app_id, rel_path), edges (app_id, from_path, to_path, maybe ord).

    Only these apps' partitions are replaced (dynamic overwrite); every app writes a row of its own, so one that has lost
    all its files is emptied too. Partitions are rebalanced at run time, so a large app is split over files and small
    ones share tasks.
    """
    ord_ = F.col("ord").cast("long") if "ord" in edges_.columns else F.lit(None).cast("long")
    none = F.lit(None).cast("string")
    row = lambda df, kind, src, dst, at: df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), at.alias("ord"), F.col("app_id").cast("long").alias("app_id"))
    rows = row(apps.select("app_id").distinct(), "app", none, none, F.lit(None).cast("long"))
    rows = rows.unionByName(row(nodes, "node", F.col("rel_path"), none, F.lit(None).cast("long"))).unionByName(row(edges_, "edge", F.col("from_path"), F.col("to_path"), ord_))
    rows.hint("rebalance", "app_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id").parquet(path)


def read_graph(spark: SparkSession, path: str, kind: str = "edge") -> DataFrame:
    """(app_id, src, dst, ord) of the stored rows of a kind; an app filter reads its partition only. No store: no rows."""
    store, p = hadoop(spark, path)
    if not store.exists(p):
        return spark.createDataFrame([], GRAPH).drop("kind").select("app_id", "src", "dst", "ord")
    return spark.read.schema(GRAPH).parquet(path).where(F.col("kind") == kind).select("app_id", "src", "dst", "ord")
