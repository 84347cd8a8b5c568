"""Benchmark decontamination over a distributed positional inverted index.

`build_index` cuts the corpus into shards (bounded runs of documents), and stores for each shard and term one posting
list: the places of the term in the shard's numbering, in which documents lie GAP apart so that no window spans two.
Term counts over the whole corpus come from the stored lists. `search` joins the benchmark's terms to the lists and,
shard by shard, intersects offset-adjusted lists from a window's rarest term on. With `slop` it also finds stretches of
at most `slop` words more than the window that hold all its words in any order, each at a place of its own. No document
text is shuffled; one row is a (shard, term) list, so a frequent term is spread over all shards.

Results: null, empty and wordless texts have no words and no hits. A repeated item id counts as one item with several
texts. A document is a row, named by its shard and first place: rows that repeat an id, or have none, are found and
reported one by one. An empty corpus or benchmark gives empty matches. Ids may be of any simple type; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
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

#: Words between two documents of a shard: over any window length and slop that may be asked for.
GAP = 128
#: A shard is closed at this many words or documents: bounds what a search task holds, and keeps places in 32 bits.
SHARD_WORDS, SHARD_DOCS = 2_000_000, 200_000
#: Benchmark words in one block of items: bounds a search task's other side.
BLOCK_WORDS = 200_000
#: Bits of a stretch of places, by which matches meet documents.
STRETCH = 12

INDEX = "kind string, shard long, term binary, n long, doc_id {}, base long, places binary"


class Index(NamedTuple):
    """Where an index is stored, and the type of its document ids (an empty one has no file that tells it)."""

    path: str
    id_type: str


def read_index(spark: SparkSession, index: Index, kind: str) -> DataFrame:
    """`doc` or `term` rows of a stored index."""
    return spark.read.schema(INDEX.format(index.id_type)).parquet(index.path).where(F.col("kind") == kind)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The stored index: a `doc` row for each document (its first place in the shard, its words) and a `term` row for
    each shard and term (ascending places as packed int32 differences)."""
    spark = docs.sparkSession

    ids_of = docs.select(F.col(doc_id).alias("doc_id")).schema
    id_type = to_arrow_schema(ids_of).field(0).type
    type_name = ids_of[0].dataType.simpleString()
    index_schema = INDEX.format(type_name)
    names = ["kind", "shard", "term", "n", "doc_id", "base", "places"]

    def batch(kind: str, key: int, term: pa.Array | None, n: np.ndarray, ids: list | None, base: np.ndarray | None, places: pa.Array | None) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(n), t)
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(kind), len(n)), pa.repeat(pa.scalar(key, pa.int64()), len(n)), none(pa.binary()) if term is None else term, pa.array(n, pa.int64()),
            none(id_type) if ids is None else pa.array(ids, id_type), none(pa.int64()) if base is None else pa.array(base, pa.int64()), none(pa.binary()) if places is None else places,
        ], names=names)

    def shard_rows(key: int, ids: list, counts: list[int], codes: np.ndarray, terms: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, n = np.array(counts, np.int64), len(ids)
        base = np.cumsum(words + GAP) - words - GAP
        yield batch("doc", key, None, words, ids, base, None)
        place = (np.arange(len(codes)) + np.repeat(np.arange(n) * GAP, words))[np.argsort(codes, kind="stable")].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))]).astype(np.int32)
        step = np.diff(place, prepend=np.int32(0))
        step[ends[:-1][: len(terms)]] = place[ends[:-1][: len(terms)]]
        for i in range(0, len(terms), 20_000):
            part = terms[i : i + 20_000]
            own = ends[i : i + len(part) + 1]
            lists = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((own - own[0]) * np.int32(4)), pa.py_buffer(step[own[0] : own[-1]].tobytes())])
            yield batch("term", key, pa.array(part, pa.binary()), np.diff(own), None, None, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, total = TaskContext.get().partitionId() << 24, 0
        code, ids, counts, parts = defaultdict(count().__next__), [], [], []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for k, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    words = ascii_words(t)
                    ids.append(k)
                    counts.append(len(words))
                    parts.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                    total += len(words)
                    if total >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                        yield from shard_rows(key, ids, counts, np.concatenate(parts), list(code))
                        key, total = key + 1, 0
                        code, ids, counts, parts = defaultdict(count().__next__), [], [], []
        if ids:
            yield from shard_rows(key, ids, counts, np.concatenate(parts), list(code))

    path = fresh_path(spark, "positional-index")
    docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, index_schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return Index(path, type_name)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """(item, copy, block, place, term, size) of every benchmark word, and the number of blocks; a block bounds the
    items that are searched together."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    texts = items.select(F.col(item_id).alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
    blocks = (texts.agg(F.sum(F.size("words"))).collect()[0][0] or 0) // BLOCK_WORDS + 1
    texts = texts.withColumn("copy", F.xxhash64("words"))
    exploded = texts.select("item", "copy", F.pmod(F.col("copy"), F.lit(blocks)).cast("int").alias("block"), F.size("words").alias("size"), F.posexplode("words").alias("place", "word"))
    return exploded.select("item", "copy", "block", "size", "place", F.encode("word", "utf-8").alias("term")), blocks


def member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def near(sorted_: np.ndarray, values: np.ndarray, reach: int) -> np.ndarray:
    at = np.searchsorted(sorted_, values - reach)
    return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] <= values + reach)


def stretches(terms: list[bytes], lists: dict[bytes, np.ndarray], count: dict[bytes, int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the shortest stretches of at most `width` words that hold all terms, repeats included."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    wanted = Counter(terms)
    if any(t not in lists for t in wanted):
        return none
    rarest, *others = sorted(wanted, key=lambda t: (count[t], t))
    found = lists[rarest]
    for t in others:
        found = found[near(lists[t], found, width - 1)]
        if not len(found):
            return none
    # all places of terms within reach of what is left, in order; then one pass with two ends
    own = [p[near(found, p, width - 1)] for p in (lists[t] for t in wanted)]
    place = np.concatenate(own)
    term = np.repeat(np.arange(len(own)), [len(p) for p in own])
    order = np.argsort(place, kind="stable")
    place, term, need = place[order].tolist(), term[order].tolist(), [*wanted.values()]
    left, missing, starts, stops = 0, len(terms), [], []
    for at, t in zip(place, term, strict=True):
        missing -= need[t] > 0
        need[t] -= 1
        while need[term[left]] < 0:
            need[term[left]] += 1
            left += 1
        if not missing and at - place[left] < width and not (starts and starts[-1] == place[left]):
            starts.append(place[left])
            stops.append(at + 1)
    return np.array(starts, np.int64), np.array(stops, np.int64)


def windows_of(terms: list, window: int) -> list[list]:
    """Runs of `window` consecutive words; an item of fewer is one window."""
    n = min(window, len(terms))
    return [terms[i : i + n] for i in range(len(terms) - n + 1)]


def intersect(terms: list[bytes], lists: dict[bytes, np.ndarray], count: dict[bytes, int]) -> np.ndarray:
    """First places of a window's occurrences."""
    if any(t not in lists for t in terms):
        return np.empty(0, np.int64)
    order = sorted(range(len(terms)), key=lambda i: (count[terms[i]], i))
    found = lists[terms[order[0]]] - order[0]
    for i in order[1:]:
        if not len(found):
            break
        found = found[member(lists[terms[i]], found + i)]
    return found


def search(index: Index, terms: DataFrame, blocks: int, window: int = 10, slop: int | None = None) -> DataFrame:
    """Matches (shard, base, doc_id, item, kind, start, stop): document words [start, stop) inside occurrences of an item's
    windows, overlapping ones of an item merged (kind `exact`); with slop also kind `near`, each stretch a row."""
    if window + (slop or 0) > GAP:
        raise ValueError(f"window and slop must be at most {GAP} together")
    spark = terms.sparkSession
    used = terms.groupBy("block", "term").agg(F.collect_list(F.struct(F.col("item").cast("string").alias("item"), "copy", "place", "size")).alias("uses"))
    # one block has BLOCK_WORDS words at most: small enough to send; beyond that the lists are shuffled by term
    small = F.broadcast if blocks == 1 else lambda df: df
    counts = read_index(spark, index, "term").join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("count"))
    hits = read_index(spark, index, "term").select("shard", "term", "places").join(small(used.join(counts, "term")), "term")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(pdf):
            shard = int(pdf["shard"].iloc[0])
            places = {t: np.cumsum(np.frombuffer(p, np.int32), dtype=np.int64) for t, p in zip(pdf["term"], pdf["places"], strict=True)}
            count = dict(zip(pdf["term"], pdf["count"], strict=True))
            items: dict[tuple, list] = {}
            for t, uses in zip(pdf["term"], pdf["uses"], strict=True):
                for u in uses:
                    items.setdefault((u["item"], u["copy"]), [None] * u["size"])[u["place"]] = t
            done: dict[tuple, tuple] = {}
            for (item, _), words in items.items():
                for kind in ("exact", *(("near",) if slop is not None else ())):
                    spans = []
                    for w in windows_of(words, window):
                        if None in w:
                            continue
                        if (k := (kind, *w)) not in done:
                            if kind == "near":
                                done[k] = stretches(w, places, count, len(w) + slop)
                            else:
                                starts = intersect(w, places, count)
                                done[k] = starts, starts + len(w)
                        spans.append(done[k])
                    starts, stops = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.empty(0, np.int64),) * 2
                    if not len(starts):
                        continue
                    starts, stops = np.unique(np.stack([starts, stops]), axis=1)
                    if kind == "exact":  # documents lie GAP apart, so what overlaps is in one of them
                        new = np.concatenate([[True], starts[1:] > stops[:-1]])
                        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
                        starts, stops = starts[new], stops[last]
                    out += [(shard, item, kind, a, b) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["shard", "item", "kind", "start", "stop"])

    found = hits.groupBy("shard", "block").applyInPandas(find, "shard long, item string, kind string, start long, stop long")
    # a match looks for its document among the few that reach into the same stretch of the shard
    stretch = lambda c: F.shiftright(c, STRETCH)
    docs = read_index(spark, index, "doc").where("n > 0").select("shard", "base", "n", "doc_id", F.explode(F.sequence(stretch(F.col("base")), stretch(F.col("base") + F.col("n") - 1))).alias("stretch"))
    own = found.withColumn("stretch", stretch(F.col("start"))).join(docs, ["shard", "stretch"]).where((F.col("start") >= F.col("base")) & (F.col("start") < F.col("base") + F.col("n")))
    return own.select("shard", "base", "doc_id", "item", "kind", (F.col("start") - F.col("base")).alias("start"), (F.col("stop") - F.col("base")).alias("stop"))


def document_report(index: Index, matches: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row: its words, those inside any exact match, and its sorted item ids."""
    spans = matches.where("kind = 'exact'")
    before = Window.partitionBy("shard", "base").orderBy("start", "stop", "item").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.col("start"))), F.lit(0))
    hit = spans.withColumn("fresh", fresh).groupBy("shard", "base").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    docs = read_index(matches.sparkSession, index, "doc").select("shard", "base", "doc_id", F.col("n").alias("n_words"))
    return docs.join(hit, ["shard", "base"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id") -> tuple[Index, DataFrame]:
    """(index, matches) of a corpus against a benchmark."""
    index = build_index(docs, doc_id)
    return index, search(index, *item_terms(items), window)
