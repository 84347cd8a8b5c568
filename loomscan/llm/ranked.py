"""Ranked lexical search: variable-block-max WAND over sharded posting lists.

A posting holds a document's place in its shard and its impact, the integer part of the score that does not hang on the
query: (10^9 * tf) div (1000 * tf + 12 * m), with the document's length norm m = 75 + (25 * n * N) div L. A term's weight
is floor(1000 * ln((2N + 2) / (2 df + 1))), and a score sums weight * impact over a query's terms, repeats included.

`build_index` cuts the corpus into shards of bounded words and documents. Each list is cut into blocks by dynamic
programming: of all cuts into blocks of at most WIDEST postings, the one with the least bound error, where a block's
error is its length times its largest impact, and each block costs as much as COST typical deviations. So blocks end
where impacts change, and their maxima are close bounds.

`search` takes each shard apart. The blocks of a query's terms cut the shard's documents into stretches in which the sum
of the blocks' bounds is constant; WAND's pivot test is put to a stretch at once: if that sum is under the k-th score so
far, no document in it is a pivot, and the postings of its blocks are never touched. Stretches come by falling bound, so
the k-th score is high early, and the search ends at the first stretch under it. Ties may still win by id, so a stretch
at exactly that score is looked into; results are exact.

Results: null, empty and wordless documents match nothing and count nowhere; wordless queries have no rows. Queries with
the same id and the same words are one, others are searched by themselves. Rows that repeat a document id are apart;
a null id comes last among equal scores. Empty tables give no rows; extra columns are ignored. Ids are of any simple type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomscan.llm.common import as_bytes, ascii_words, fresh_path

#: A shard is closed at this many words or documents: bounds what a build or search task holds.
SHARD_WORDS, SHARD_DOCS = 2_000_000, 65_536
#: Longest block, and a block's cost in typical deviations of the list's impacts.
WIDEST, COST = 64, 16
#: Lists are cut by dynamic programming in pieces of this many postings; a piece's end is a block's end.
PIECE = 1024
#: Query words in one block of queries: bounds a search task's other side.
BLOCK_WORDS = 200_000
#: Documents that a query looks into first; each further turn takes twice as many.
FIRST = 512

INDEX = "kind string, shard long, term binary, n long, place int, doc_id {}, docs binary, impacts binary, ends binary, tops binary"


class Index(NamedTuple):
    """Where an index is stored, the type of its document ids, its documents with words, and their words."""

    path: str
    id_type: str
    documents: int
    words: int


def read_index(spark: SparkSession, index: Index, kind: str) -> DataFrame:
    return spark.read.schema(INDEX.format(index.id_type)).parquet(index.path).where(F.col("kind") == kind)


def cuts(impacts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marks of the last postings of blocks, for the lists in the rows of a padded matrix: the cut of least bound error.

    best[i] = min over blocks (j, i] of best[j] + (i - j) * max(impacts[j:i]) + cost; the WIDEST candidates of a row lie
    in a ring, so a step handles all rows at once.
    """
    rows, width = impacts.shape
    inside = np.arange(width) < lengths[:, None]
    mean = (impacts * inside).sum(axis=1) / lengths
    cost = 1 + COST * np.sqrt((((impacts - mean[:, None]) * inside) ** 2).sum(axis=1) / lengths)
    top, before = np.zeros((rows, WIDEST)), np.full((rows, WIDEST), np.inf)
    start, back = np.zeros(WIDEST), np.zeros((rows, width + 1), np.int32)
    best, every = np.zeros(rows), np.arange(rows)
    for i in range(width):
        ring = i % WIDEST
        before[:, ring], start[ring], top[:, ring] = best, i, 0
        np.maximum(top, impacts[:, i, None], out=top)
        total = top * (i + 1 - start)
        total += before
        chosen = total.argmin(axis=1)
        best = total[every, chosen] + cost
        back[:, i + 1] = start[chosen]
    marks = np.zeros((rows, width), bool)
    at = lengths.copy()
    while (at > 0).any():
        live = at > 0
        marks[every[live], at[live] - 1] = True
        at = np.where(live, back[every, at], 0)
    return marks


def block_ends(impacts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of block ends for consecutive lists that end at `ends`; lists are cut in pieces, alike lengths together."""
    marks = np.zeros(len(impacts), bool)
    marks[ends - 1] = True
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    long = sizes > 2
    pieces = [(a, min(PIECE, b - a)) for s, e in zip(starts[long], ends[long], strict=True) for a in range(s, e, PIECE) for b in (e,)]
    if not pieces:
        return marks
    first, length = np.array(pieces, np.int64).T
    order = np.argsort(length, kind="stable")
    first, length = first[order], length[order]
    done = 0
    while done < len(first):  # rows of a matrix are at least half as long as its width
        stop = min(int(np.searchsorted(length, 2 * length[done], side="left")), done + max(1, 4_000_000 // (2 * int(length[done]) + WIDEST)))
        n, at = length[done:stop], first[done:stop]
        place = at[:, None] + np.arange(n[-1])
        inside = np.arange(n[-1]) < n[:, None]
        found = cuts(np.where(inside, impacts[np.minimum(place, len(impacts) - 1)], 0).astype(np.float64), n)
        marks[place[found & inside]] = True
        done = stop
    return marks


def impacts_of(tf: np.ndarray, words: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impacts of postings from their counts and their documents' lengths, in 64-bit integers where those hold."""
    if int(words.max(initial=0)) * 25 * documents >= 1 << 62:
        norm = np.array([75 + 25 * int(n) * documents // total for n in words], np.int64)
    else:
        norm = 75 + 25 * words * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def shard_batches(key: int, ids: list, words: np.ndarray, codes: np.ndarray, terms: list[bytes], documents: int, total: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard; documents are numbered by id, so that equal scores go to the smaller number."""

    def batch(kind: str, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        types = {"term": pa.binary(), "n": pa.int64(), "place": pa.int32(), "doc_id": id_type} | {c: pa.binary() for c in ("docs", "impacts", "ends", "tops")}
        arrays = [pa.repeat(pa.scalar(v), rows) for v in (kind, key)] + [columns.get(c, pa.nulls(rows, t)) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "shard", *types])

    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    yield batch("doc", len(ids), n=pa.array(words), place=pa.array(place, pa.int32()), doc_id=pa.array(ids, id_type))
    if not len(codes):
        return
    keys, tf = np.unique(codes.astype(np.int64) * len(ids) + np.repeat(place, words), return_counts=True)
    term, docs = np.divmod(keys, len(ids))
    impacts = impacts_of(tf.astype(np.int64), words[order][docs], documents, total)
    ends = np.cumsum(np.bincount(term, minlength=len(terms)))
    blocks = np.flatnonzero(block_ends(impacts, ends)) + 1
    tops = np.maximum.reduceat(impacts, np.concatenate([[0], blocks[:-1]])).astype(np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    block_end = (blocks - np.repeat(starts, np.diff(np.searchsorted(blocks, np.concatenate([[0], ends]), side="right")))).astype(np.int32)
    block_at = np.searchsorted(blocks, np.concatenate([[0], ends]), side="right")
    docs, impacts = docs.astype(np.int32), impacts.astype(np.int32)

    def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
        own = ((at - at[0]) * 4).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(own), pa.py_buffer(values[at[0] : at[-1]].tobytes())])

    posting_at = np.concatenate([[0], ends])
    for i in range(0, len(terms), 20_000):
        j = min(i + 20_000, len(terms))
        own, blocks_of = posting_at[i : j + 1], block_at[i : j + 1]
        columns = {"docs": lists(docs, own), "impacts": lists(impacts, own), "ends": lists(block_end, blocks_of), "tops": lists(tops, blocks_of)}
        yield batch("term", j - i, term=pa.array(terms[i:j], pa.binary()), n=pa.array(np.diff(own)), **columns)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The stored index: a `doc` row for each document with words, a `term` row for each shard and term."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    type_name, id_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_schema(rows.schema).field(0).type

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = words = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                sizes = [len(ascii_words(t)) for t in as_bytes(b.column(0).slice(i, 256))]
                documents, words = documents + sum(n > 0 for n in sizes), words + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([words], pa.int64())], names=["documents", "words"])

    seen = rows.select("text").mapInArrow(measure, "documents long, words long").agg(F.sum("documents"), F.sum("words")).collect()[0]
    documents, total = seen[0] or 0, seen[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, held = TaskContext.get().partitionId() << 24, 0
        code, ids, counts, parts = defaultdict(count().__next__), [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            yield from shard_batches(key, ids, np.array(counts, np.int64), np.concatenate(parts), list(code), documents, total, id_type)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for k, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    words = ascii_words(t)
                    if not words:
                        continue
                    ids.append(k)
                    counts.append(len(words))
                    parts.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                    if held >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                        yield from close()
                        key, held = key + 1, 0
                        code, ids, counts, parts = defaultdict(count().__next__), [], [], []
        if ids:
            yield from close()

    path = fresh_path(spark, "ranked-index")
    rows.mapInArrow(run, INDEX.format(type_name)).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return Index(path, type_name, documents, total)


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """(item, copy, block, term, times) of every query's terms, and the number of query blocks."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    texts = items.select(F.col(item_id).alias("item"), words.alias("words")).where(F.size("words") > 0).distinct().withColumn("copy", F.xxhash64("words"))
    blocks = (texts.agg(F.sum(F.size("words"))).collect()[0][0] or 0) // BLOCK_WORDS + 1
    block = F.pmod(F.xxhash64("item", "copy"), F.lit(blocks)).cast("int")
    terms = texts.select("item", "copy", block.alias("block"), F.explode("words").alias("word")).groupBy("item", "copy", "block", "word").agg(F.count("*").alias("times"))
    return terms.select("item", "copy", "block", F.encode("word", "utf-8").alias("term"), "times"), blocks


class Lists(NamedTuple):
    """A term's part of a query: its weight times its repeats, its postings, and its blocks as first and last document."""

    weight: int
    docs: np.ndarray
    impacts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    tops: np.ndarray


def stretches(lists: list[Lists]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, bound) of the stretches of documents that the blocks cut out, those with a bound over 0."""
    place = np.concatenate([p for t in lists for p in (t.first, t.last + 1)])
    change = np.concatenate([c for t in lists for c in (t.tops * t.weight, -t.tops * t.weight)])
    places, at = np.unique(place, return_inverse=True)
    bound = np.zeros(len(places), np.int64)
    np.add.at(bound, at, change)
    bound = np.cumsum(bound)[:-1]
    live = bound > 0
    return places[:-1][live], places[1:][live], bound[live]


def best(lists: list[Lists], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) of the k best of a shard, and how many postings were looked into."""
    start, stop, bound = stretches(lists)
    order = np.lexsort((start, -bound))
    start, stop, bound = start[order], stop[order], bound[order]
    width = np.cumsum(stop - start)
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    done, turn, touched, least = 0, FIRST, 0, 1
    while done < len(start):
        live = int(np.searchsorted(-bound, -least, side="right"))  # stretches whose bound reaches the k-th score
        if done >= live:
            break
        upto = min(live, int(np.searchsorted(width, (width[done - 1] if done else 0) + turn)) + 1)
        a = np.sort(start[done:upto])
        z = np.sort(stop[done:upto])
        found, parts = [], []
        for t in lists:
            lo, hi = np.searchsorted(t.docs, a), np.searchsorted(t.docs, z)
            n = hi - lo
            if total := int(n.sum()):
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
                found.append(t.docs[at])
                parts.append(t.impacts[at].astype(np.int64) * t.weight)
                touched += total
        if found:
            own, at = np.unique(np.concatenate(found), return_inverse=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, at, np.concatenate(parts))
            docs, scores = np.concatenate([docs, own]), np.concatenate([scores, sums])
            keep = np.lexsort((docs, -scores))[:k]
            keep = keep[scores[keep] > 0]
            docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                least = max(1, int(scores[-1]))
        done, turn = upto, turn * 2
    return docs, scores, touched


def search(index: Index, terms: DataFrame, blocks: int, k: int = 20) -> DataFrame:
    """(item, rank, doc_id, score): each query's k best documents of score over 0."""
    spark = terms.sparkSession
    small = F.broadcast if blocks == 1 else lambda df: df  # a block has BLOCK_WORDS words at most
    counts = read_index(spark, index, "term").join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    uses = F.collect_list(F.struct(F.xxhash64("item", "copy").alias("query"), "times")).alias("uses")
    used = terms.groupBy("block", "term").agg(uses).join(counts, "term").withColumn("weight", weight).where("weight > 0").drop("df")
    hits = read_index(spark, index, "term").select("shard", "term", "docs", "impacts", "ends", "tops").join(small(used), "term")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        queries: dict[int, list[Lists]] = defaultdict(list)
        for r in pdf.itertuples(index=False):
            docs, impacts, ends = (np.frombuffer(b, np.int32) for b in (r.docs, r.impacts, r.ends))
            tops = np.frombuffer(r.tops, np.int32).astype(np.int64)
            first, last = docs[np.concatenate([[0], ends[:-1]])], docs[ends - 1]
            for use in r.uses:
                queries[use["query"]].append(Lists(r.weight * use["times"], docs, impacts, first, last, tops))
        out = []
        for query, lists in queries.items():
            docs, scores, _ = best(lists, k)
            out.append(pd.DataFrame({"shard": pdf["shard"].iloc[0], "query": query, "place": docs.astype(np.int32), "score": scores}))
        return pd.concat(out)

    found = hits.groupBy("shard", "block").applyInPandas(find, "shard long, query long, place int, score long")
    named = found.join(read_index(spark, index, "doc").select("shard", "place", "doc_id"), ["shard", "place"])
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    items = terms.select(F.xxhash64("item", "copy").alias("query"), "item").distinct()
    return ranked.join(small(items), "query").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item (item_id, text)."""
    return search(build_index(docs), *query_terms(items), k)
