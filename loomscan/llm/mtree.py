"""Exact top-k inner-product search with paged M-trees, best first.

Inner products become distances: each vector gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its
length, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest are those of the highest product. Vectors are dealt to
the cell of their nearest pivot; cells have covering radii and are cut into shards, and each shard bulk-loads an M-tree
whose pages hold pivots, covering radii and distances to the parent pivot, stored as rows. A query searches a shard of
its own cell first; its k-th score so far then rules out all cells whose ball lies farther off, and bounds the search in
the shards that are left. In a tree pages come by their least possible distance, and entries only if the stored parent
distance and the triangle inequality cannot rule them out. Scores of what remains are exact integers.

Of equal vectors only the k + 1 rows of smallest id can be among anyone's k best, so the others are left out of the trees,
and equal queries are searched once: copies of a vector cost no more than one.

Bounds: pivots are at most CELLS vectors for each vector length (a sample of smallest hashes, which shapes the index and no
result), and the driver holds one row a cell; queries and trees meet by sorted joins, never through the driver; trees hold SHARD vectors on average, searches BLOCK queries at once.

Results: vectors that are null, or hold null or non-finite components, take no part; vectors are compared with those
of the same length only; equal scores go to the smaller id, a missing one comes last; rows that repeat an id are queries and candidates of their
own, and a query leaves out its own row only; a query with fewer candidates gets all; extra columns are ignored.
Products must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.joins import sorted_side
from loomscan.llm.common import stored

PAGE, SHARD, BLOCK = 256, 8192, 256
#: Stands for a missing id inside: the last among equal scores.
NO_ID = (1 << 63) - 1
#: Vectors a cell on average, until there are CELLS cells.
CELL, CELLS = 4096, 1024


def integers(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): usable vectors, each component floor(scale * x) with x as double."""
    v = F.col(embedding)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(good).select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def slack(base: float | np.ndarray) -> float | np.ndarray:
    """What rounding may add to a distance whose square is near `base`."""
    return 1e-6 * (1 + np.sqrt(base))


class Tree:
    """An M-tree over the rows of an integer matrix; node: (pivot row, radius, children or entries, parent distances)."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, x: np.ndarray, m2: float):
        self.ids, self.own, self.x, self.m2 = ids, own, x, m2
        self.aug = augmented(x, m2)
        self.pages: list[tuple] = []
        self.root = self.build(np.arange(len(ids)), np.random.default_rng(0))
        # vectors of a page side by side
        order = np.concatenate([p[2] for p in self.pages if p[3] is None])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.own, self.x, self.aug = self.ids[order], self.own[order], self.x[order], self.aug[order]
        self.pages = [(int(place[pivot]), radius, place[rows], *rest) for pivot, radius, rows, *rest in self.pages]

    def build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        if len(rows) <= PAGE:
            return self.page(rows, None, None)
        pivots = rows[rng.choice(len(rows), min(16, -(-2 * len(rows) // PAGE)), replace=False)]
        gap = np.linalg.norm(self.aug[rows][:, None, :] - self.aug[pivots][None, :, :], axis=2) if len(rows) <= 512 else np.sqrt(np.maximum((self.aug[rows] ** 2).sum(1)[:, None] + (self.aug[pivots] ** 2).sum(1)[None, :] - 2 * self.aug[rows] @ self.aug[pivots].T, 0))
        near = gap.argmin(axis=1)
        groups = [g for p in range(len(pivots)) if len(g := rows[near == p])]
        if len(groups) == 1 or max(map(len, groups)) > 0.9 * len(rows):  # equal or nearly equal vectors
            groups = np.array_split(rows, -(-len(rows) // (PAGE * 8)) if len(rows) > PAGE * 8 else -(-len(rows) // PAGE))
        children = [self.build(g, rng) for g in groups]
        return self.page(np.array([self.pages[c][0] for c in children]), np.array(children), rows)

    def page(self, rows: np.ndarray, children: np.ndarray | None, covered: np.ndarray | None) -> int:
        pivot = rows[((self.aug[rows] - self.aug[rows].mean(axis=0)) ** 2).sum(axis=1).argmin()]
        parent = np.linalg.norm(self.aug[rows] - self.aug[pivot], axis=1)
        under = rows if covered is None else covered
        radius = float(np.linalg.norm(self.aug[under] - self.aug[pivot], axis=1).max())
        radii = np.array([self.pages[c][1] for c in children]) if children is not None else np.zeros(len(rows))
        self.pages.append((pivot, radius, rows, children, parent, radii))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """(score, id, row) of the k best; with a floor only those that reach that score."""
        qf = np.append(q.astype(np.float64), 0.0)
        square = float(qf @ qf)
        base, more = square + self.m2, slack(square + self.m2)
        whole = max(square, self.m2) < 2**53  # products and their sums are exact as doubles
        worst = -(1 << 63) if floor is None else floor
        most = np.inf if floor is None else np.sqrt(max(base - 2.0 * floor, 0.0))
        limit = most
        best_s, best_i, best_o = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        d = float(np.linalg.norm(qf - self.aug[self.pages[self.root][0]]))
        heap = [(max(0.0, d - self.pages[self.root][1]), self.root, d)]
        while heap:
            low, page, d = heapq.heappop(heap)
            if low > limit + more:
                break
            _, _, rows, children, parent, radii = self.pages[page]
            maybe = np.flatnonzero(np.abs(d - parent) - radii <= limit + more)  # else the triangle inequality rules it out
            if not len(maybe):
                continue
            if children is None:
                at = slice(rows[0], rows[-1] + 1) if len(maybe) == len(rows) else rows[maybe]
                s = np.rint(self.aug[at] @ qf).astype(np.int64) if whole else self.x[at] @ q
                if not (good := np.flatnonzero(s >= worst)).size:
                    continue
                s, i, o = np.append(best_s, s[good]), np.append(best_i, self.ids[at][good]), np.append(best_o, self.own[at][good])
                order = np.lexsort((o, i, -s))[:k]
                best_s, best_i, best_o = s[order], i[order], o[order]
                if len(order) == k:
                    worst = int(best_s[-1])
                    limit = min(most, np.sqrt(max(base - 2.0 * worst, 0.0)))
                continue
            gaps = np.linalg.norm(self.aug[rows[maybe]] - qf, axis=1)
            for c, gap, r in zip(children[maybe].tolist(), gaps.tolist(), radii[maybe].tolist(), strict=True):
                if gap - r <= limit + more:
                    heapq.heappush(heap, (max(0.0, gap - r), c, gap))
        return list(zip(best_s.tolist(), best_i.tolist(), best_o.tolist(), strict=True))


def pack(tree: Tree) -> list[bytes]:
    """A tree as pages of bytes: ids, vectors, then nodes."""
    head = np.array([tree.root, tree.x.shape[1], len(tree.ids)], np.int64).tobytes() + np.array([tree.m2]).tobytes()
    out = [head + tree.ids.astype(np.int64).tobytes() + tree.own.astype(np.int64).tobytes(), tree.x.astype(np.int64).tobytes()]
    for pivot, radius, rows, children, parent, radii in tree.pages:
        head = np.array([pivot, len(rows), children is not None], np.int64).tobytes() + np.array([radius]).tobytes()
        out.append(head + rows.astype(np.int64).tobytes() + parent.tobytes() + radii.tobytes() + (b"" if children is None else children.astype(np.int64).tobytes()))
    return out


def unpack(pages: list[bytes]) -> Tree:
    tree = Tree.__new__(Tree)
    tree.root, dim, n = np.frombuffer(pages[0][:24], np.int64).tolist()
    tree.m2 = float(np.frombuffer(pages[0][24:32], np.float64)[0])
    tree.ids, tree.own = np.frombuffer(pages[0], np.int64, n, 32), np.frombuffer(pages[0], np.int64, n, 32 + 8 * n)
    tree.x = np.frombuffer(pages[1], np.int64).reshape(-1, dim)
    tree.aug = augmented(tree.x, tree.m2)
    tree.pages = []
    for p in pages[2:]:
        pivot, n, inner = np.frombuffer(p[:24], np.int64).tolist()
        rows, parent, radii = (np.frombuffer(p, t, n, 32 + 8 * n * j) for j, t in enumerate((np.int64, np.float64, np.float64)))
        children = np.frombuffer(p[32 + 24 * n :], np.int64) if inner else None
        tree.pages.append((pivot, float(np.frombuffer(p[24:32], np.float64)[0]), rows, children, parent, radii))
    return tree


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists as a matrix; empty lists as one zero each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 1), np.int64)


class Cells:
    """The top level: for each vector length the pivots of its cells, and the square of its largest norm."""

    def __init__(self, m2: dict[int, float], pivots: dict[int, np.ndarray]):
        self.m2 = m2
        self.pivots = {dim: augmented(p, m2[dim]) for dim, p in pivots.items()}
        self.radius: dict[int, np.ndarray] = {}

    def gaps(self, dim: int, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of vectors (or queries, whose last component is 0) from all pivots of their length."""
        own = augmented(x, float("-inf") if query else self.m2[dim])
        pivots = self.pivots[dim]
        return np.sqrt(np.maximum((own**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * own @ pivots.T, 0))


def by_length(batches: Iterator[pa.RecordBatch], dim: str, rows: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        lengths = b.column(dim).to_numpy()
        for d in np.unique(lengths):
            own = b.filter(pa.array(lengths == d))
            for i in range(0, own.num_rows, rows):
                yield int(d), own.slice(i, rows)


def deal(rows: DataFrame, k: int) -> tuple[DataFrame, Cells, DataFrame]:
    """Rows (row, vec_id, dim, v) with their cells, the top level, and (dim, cell, parts, held) of every cell."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m2")).collect()  # a row for each vector length
    pivots = {}
    for f in facts:
        wanted = int(min(CELLS, -(-f["n"] // CELL)))
        low = -(1 << 63) + min((1 << 64) - 1, (2 * wanted + 64 << 64) // f["n"])  # about twice as many are under it: tasks send no more, however many they are
        hashed = rows.where(F.col("dim") == f["dim"]).select("v", F.xxhash64("v", "row").alias("h")).where(F.col("h") <= low)
        sample = hashed.orderBy("h").limit(wanted).collect()
        pivots[f["dim"]] = np.unique(np.array([r["v"] or [0] for r in sample], np.int64), axis=0)
    cells = Cells({f["dim"]: f["m2"] for f in facts}, pivots)
    shared = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in by_length(batches, "dim"):
            gaps = shared.value.gaps(dim, matrix(b.column("v")), False)
            cell = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "far"])

    dealt = stored(rows.mapInArrow(run, "row long, vec_id long, dim int, v array<long>, cell int, far double"), "cells")
    held = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("held"), F.max("far").alias("radius")).collect()  # at most CELLS rows a length
    for dim, p in cells.pivots.items():
        cells.radius[dim] = np.full(len(p), -np.inf)  # no vector, no ball
    for r in held:
        # distances by expanded squares lose about 1e-8 of the norms: radii are widened by that
        cells.radius[r["dim"]][r["cell"]] = r["radius"] + slack(4 * cells.m2[r["dim"]])
    table = spark.createDataFrame([(r["dim"], r["cell"], -(-r["held"] // SHARD), r["held"]) for r in held], "dim int, cell int, parts int, held long")
    return dealt, cells, table


def build(dealt: DataFrame, table: DataFrame, m2: dict[int, float]) -> DataFrame:
    """(dim, cell, part, pages): a stored tree for each shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x = np.stack([np.asarray(v, np.int64) for v in pdf["v"]])
        if not dim:
            x = np.zeros((len(x), 1), np.int64)
        pages = pack(Tree(pdf["vec_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), x, m2[dim]))
        return pd.DataFrame({"dim": dim, "cell": pdf["cell"].iloc[0], "part": pdf["part"].iloc[0], "page": range(len(pages)), "body": pages})

    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")
    shards = dealt.join(F.broadcast(table), ["dim", "cell"]).select("row", "vec_id", "dim", "v", "cell", part)
    pages = stored(shards.groupBy("dim", "cell", "part").applyInPandas(run, "dim int, cell int, part int, page int, body binary"), "m-tree")
    return pages.groupBy("dim", "cell", "part").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))


BEST = "key long, dim int, v array<long>, cell int, part int, floor long, best array<struct<score:long,vec_id:long,row:long>>"


def searched(sent: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Queries (key, dim, v, cell, part, floor) with the k best of the shard that each is sent to, blocks of them at once."""
    load = sent.groupBy("dim", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    packed = sent.join(load, ["dim", "cell", "part"]).groupBy("dim", "cell", "part", block).agg(F.collect_list(F.struct("key", "v", "floor")).alias("queries"))
    pairs = packed.join(sorted_side(trees), ["dim", "cell", "part"]).select("dim", "cell", "part", "queries", F.transform("pages", lambda p: p["body"]).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, cell, part = (b.column(j)[i].as_py() for j in range(3))
                tree, out = unpack(b.column(4)[i].as_py()), []
                for q in b.column(3)[i].as_py():
                    found = tree.search(np.array(q["v"] or [0], np.int64), k, q["floor"])
                    floor = found[-1][0] if len(found) == k else q["floor"]
                    out.append({"key": q["key"], "dim": dim, "v": q["v"], "cell": cell, "part": part, "floor": floor, "best": [dict(zip(("score", "vec_id", "row"), x, strict=True)) for x in found]})
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return stored(pairs.mapInArrow(run, BEST), "searched")


FOUND = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
SCHEMA = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("part", pa.int32()), ("floor", pa.int64()), ("best", FOUND)])


def top_k(vectors: DataFrame, wanted: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, v) integer vectors; the rows that `wanted` selects are the queries."""
    rows = stored(vectors.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v", F.size("v").alias("dim"), F.coalesce(wanted, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")), "vectors")
    of_equal = Window.partitionBy("v").orderBy("vec_id", "row")  # limited before the shuffle
    kept = rows.withColumn("n", F.row_number().over(of_equal)).where(F.col("n") <= k + 1)
    dealt, cells, table = deal(kept.select("row", "vec_id", "dim", "v"), k)
    trees = build(dealt, table, cells.m2)
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    once = rows.where("query").groupBy("v", "dim").agg(F.min("row").alias("key"))  # equal queries

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in by_length(batches, "dim"):
            gaps = shared.value.gaps(dim, matrix(b.column("v")), True) - shared.value.radius[dim]
            gaps[:, np.isinf(shared.value.radius[dim])] = np.inf
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("dim"), b.column("v"), pa.array(gaps.argmin(axis=1).astype(np.int32))], names=["key", "dim", "v", "cell"])

    homes = once.select("key", "dim", "v").mapInArrow(home, "key long, dim int, v array<long>, cell int")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
    first = searched(homes.join(F.broadcast(table), ["dim", "cell"]).select("key", "dim", "v", "cell", part, F.lit(None).cast("long").alias("floor")), trees, k + 1)
    parts = {(r["dim"], r["cell"]): r["parts"] for r in table.collect()}

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every other shard whose cell may hold a score that reaches the floor."""
        top = shared.value
        for dim, b in by_length(batches, "dim"):
            x = matrix(b.column("v"))
            base = (x.astype(np.float64) ** 2).sum(axis=1) + top.m2[dim]
            floor = b.column("floor").to_pylist()
            limit = np.array([np.inf if f is None else np.sqrt(max(s - 2.0 * f, 0.0)) for s, f in zip(base, floor, strict=True)]) + slack(base)
            near = top.gaps(dim, x, True) - top.radius[dim] <= limit[:, None] + slack(4 * top.m2[dim])
            cell, own = b.column("cell").to_pylist(), b.column("part").to_pylist()
            to = [[(c, p) for c in np.flatnonzero(near[i]).tolist() for p in range(parts.get((dim, c), 0)) if (c, p) != (cell[i], own[i])] for i in range(len(x))]
            where = pa.array([[{"cell": c, "part": p} for c, p in t] for t in to], pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("dim"), b.column("v"), b.column("floor"), where], names=["key", "dim", "v", "floor", "to"])

    sent = first.select("key", "dim", "v", "cell", "part", "floor").mapInArrow(others, "key long, dim int, v array<long>, floor long, to array<struct<cell:int,part:int>>")
    second = searched(sent.select("key", "dim", "v", "floor", F.explode("to").alias("to")).select("key", "dim", "v", "to.cell", "to.part", "floor"), trees, k + 1)
    found = first.union(second).select("key", F.explode("best").alias("b")).select("key", "b.*")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "row"))).alias("best"))
    own = rows.where("query").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "v").join(sorted_side(once.select("v", "key")), "v").join(sorted_side(best), "key")
    kept = F.slice(F.filter("best", lambda x: x["row"] != F.col("own")), 1, k)
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    out = own.select("query_id", F.posexplode(kept).alias("at", "b"))
    return out.select(named("query_id").alias("query_id"), (F.col("at") + 1).alias("rank"), named("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
