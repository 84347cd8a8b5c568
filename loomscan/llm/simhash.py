"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart share a value at most 2 bits from each. Every distinct fingerprint emits all
values of its 2-bit ball; fingerprints that meet at a value are linked. The shuffle key is a value's first bits, and a
row carries (fingerprint, flips left): it stands for all of the fingerprint's variants with that prefix, which the
receiving task spells out. So the ball crosses the shuffle in tens of rows instead of 2,081, and the prefix grows with
the number of fingerprints to keep tasks the same size; a prefix that many near copies crowd is cut by further bits
until none is crowded (a full value has 2,081 fingerprints at most). Inside a task the variants are sorted in bounded pieces;
fingerprints that meet are verified and united, and a task emits one link for each fingerprint that met a smaller one.
Components come from minimum labels with pointer jumping, over distinct fingerprints only; copies join at the end.

Results: a text without words (null, empty, blanks) has fingerprint zero and is linked like any other; ties have no
meaning; repeated rows are copies; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import add_columns, as_bytes, stored

BITS, SEED = 64, 42
#: Variants sorted at once in a task: bounds its memory.
PIECE = 1 << 19
#: Fingerprints for each prefix at most, on average.
PER_PREFIX = 1024
#: Rows of a prefix over which it is cut by DEEPER more bits: bounds what a task gets of near copies that crowd together.
CROWD, DEEPER = 1 << 17, 8
#: Parts that the copies of one fingerprint are dealt to when they get their class.
SALTS = 8


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    words = text.lower().split() if text else []  # of bytes: A-Z, and the blanks \x20\x09-\x0D
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash_(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [hash_(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """df with each text's fingerprint as a signed 64-bit number."""

    def make():
        def fn(column: pa.Array) -> list:
            return [pa.array(np.array([fingerprint(t, shingle) for t in as_bytes(column)], np.uint64).view(np.int64))]

        return fn

    return add_columns(df, text, [(name, "long")], make, keep=keep)


def flips(bits: range, most: int) -> np.ndarray:
    """Masks that flip up to `most` of the bit positions."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def prefixes(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """(prefix, fp, left): the prefixes of a fingerprint's ball, with the flips that are left for the other bits."""
    masks = [(int(m), radius - int(m).bit_count()) for m in flips(range(bits), radius)]
    flip = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(left).alias("left")) for m, left in masks])
    top = F.shiftrightunsigned("fp", BITS - bits)
    return fps.select("fp", F.explode(flip).alias("f")).select(top.bitwiseXOR(F.col("f.m")).alias("prefix"), "fp", F.col("f.left").alias("left"))


def deeper(rows: DataFrame, bits: int, more: int, radius: int) -> DataFrame:
    """Rows of prefixes of `bits` bits as rows of prefixes with `more` further bits."""
    flip = F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("used")) for m in flips(range(more), radius)])
    own = F.shiftrightunsigned("fp", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    cut = rows.select("prefix", "fp", "left", F.explode(flip).alias("f")).where("f.used <= left")
    return cut.select(F.shiftleft("prefix", more).bitwiseOR(own.bitwiseXOR(F.col("f.m"))).alias("prefix"), "fp", (F.col("left") - F.col("f.used")).alias("left"))


def dealt(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """(bits, prefix, fp, left): prefixes of `bits` bits, crowded ones cut deeper."""
    rows, out = prefixes(fps, bits, radius), None
    while True:
        crowded = stored(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("prefix"), "crowded")
        done = bits == BITS or crowded.isEmpty()
        calm = (rows if done else rows.join(crowded, "prefix", "left_anti")).select(F.lit(bits).alias("bits"), "prefix", "fp", "left")
        out = calm if out is None else out.union(calm)
        if done:
            return out
        more = min(DEEPER, BITS - bits)
        rows, bits = deeper(rows.join(crowded, "prefix", "left_semi"), bits, more, radius), bits + more


def meet(fp: np.ndarray, who: np.ndarray, left: np.ndarray, free: int, link: list, variants: dict) -> None:
    """Unite fingerprints that share a value: all have the same bits above the lowest `free`, up to the flips used.

    fp and who (a fingerprint's number in the task) go together. Too many variants for one piece are split by the next
    bit's value, which costs no variant. Each piece leaves at most one link for a fingerprint.
    """
    size = sum(int(n) * len(variants[free, k]) for k, n in enumerate(np.bincount(left, minlength=3)) if n)
    if len(fp) < 2:
        return
    if size > PIECE and free > 1:
        bit = (fp >> np.uint64(free - 1)) & np.uint64(1)
        for v in (0, 1):
            same = bit == v
            keep = same | (left > 0)
            meet(fp[keep], who[keep], np.where(same, left, left - 1)[keep], free - 1, link, variants)
        return
    low = np.uint64((1 << free) - 1)
    keys, own, n = np.empty(size, np.uint64), np.empty(size, np.int32), 0
    for k in range(3):
        if (at := np.flatnonzero(left == k)).size:
            masks = variants[free, k]
            m = n + len(at) * len(masks)
            np.bitwise_xor((fp[at] & low)[:, None], masks[None, :], out=keys[n:m].reshape(len(at), -1))
            own[n:m] = np.repeat(at.astype(np.int32), len(masks))
            n = m
    order = np.argsort(keys)
    keys, own = keys[order], own[order]
    del order
    same = np.flatnonzero(keys[1:] == keys[:-1])
    if same.size:
        a, b = own[same], own[same + 1]
        pair = np.unique(np.minimum(a, b).astype(np.int64) * len(fp) + np.maximum(a, b))
        a, b = pair // len(fp), pair % len(fp)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= 4  # verify
        link.append(roots(who[a[near]], who[b[near]]))


class Variants(dict):
    def __missing__(self, key):
        self[key] = out = flips(range(key[0]), key[1])
        return out


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, for links of one task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        m = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(m, root[x], low)
        np.minimum.at(m, root[y], low)
        m = m[m]
        if np.array_equal(m, root):
            return nodes, nodes[root]
        root = m


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints at most 2 * radius bits apart; a joins all of a task's component."""
    n = fps.count()
    bits = max(8, int(np.ceil(np.log2(max(n, 1) / PER_PREFIX))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out: list = []
        fp, left = table["fp"].to_numpy().view(np.uint64), table["left"].to_numpy().astype(np.int8)
        order = np.argsort(fp.view(np.int64))  # so that the smallest number is the smallest fingerprint
        fp, left = fp[order], left[order]
        meet(fp, np.arange(len(fp), dtype=np.int32), left, BITS - key[0].as_py(), out, Variants())
        if not out:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        nodes, root = roots(*(np.concatenate(x) for x in zip(*out, strict=True)))
        other, fp = nodes != root, fp.view(np.int64)
        return pa.table({"a": fp[root[other]], "b": fp[nodes[other]]})

    rows = dealt(fps, bits, radius).select("bits", "prefix", "fp", F.col("left").cast("byte").alias("left"))
    return rows.groupBy("bits", "prefix").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    Each round a node takes the least label among its own, its neighbours' and its label's label. Rounds are written
    to the shared folder; hot nodes only meet partial minima.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "links")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(near, label.node == near.a).select("node", F.least("root", "m").alias("step"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("to"), F.col("step").alias("far"))
        new = stored(new.join(jump, F.col("step") == F.col("to")).select("node", F.least("step", "far").alias("root"), "old"), "labels")
        moved = new.where("root <> old").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc id that links of 4 bits or fewer reach."""
    docs = stored(fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"]), "fingerprints")
    first = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    root = components(links(first.select("fp")))
    linked = first.join(root, first.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    # a class is a few bytes: it is sent to each of the parts that its fingerprint's copies are dealt to
    classes = linked.join(least, "root").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(classes, ["fp", "salt"]).select("doc_id", "fp", "component_id")
