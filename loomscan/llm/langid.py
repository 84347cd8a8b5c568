"""Language identification with interpolated Kneser-Ney character models, one per language.

Letters are lower-cased; every other run of characters is one boundary symbol. Counts of character 4-grams come from
all training documents; every distinct one is kept with its own count. Continuation counts, discounts and log
probabilities are Spark aggregations and joins; each language's model is a set of sorted hash arrays (n-gram hash, log
probability; context hash, back-off weight) for orders 1 to 4, written by the tasks as files of about PART entries in
the shared folder, which scoring tasks map into memory. A text gets the language of the lowest cross-entropy a symbol over
the whole text.

Rejection is calibrated on held-back texts: a second set of models leaves out every tenth training text (by a hash of
the text), and those tenths are scored with it. For each language and length class (powers of four symbols) the limit
lies at SLACK times the distance from the language's mean that one in a thousand of them exceeds, and not under that of
all languages together. A class of fewer than FEW texts takes in the next shorter ones; if there are too few in all
languages, longer ones at twice the distance a class (distances shrink with the root of the length, as chance does).
The distance counts as LEAST nats at least; without held-back texts nothing is rejected.

Bounds: models grow with the distinct 4-grams; the driver and the broadcast hold the list of their files and a histogram of
the held-back texts' cross-entropies in steps of STEP.

Results: null texts and texts without a letter, and all texts if nothing was learned, are `und` with score 0 and not
rejected as foreign; equal scores go to the language first in the alphabet; repeated rows are answered alike; extra
columns are passed through, one named as an output (`lang_pred`, `score`, `entropy`, `rejected`) is replaced.
"""

from __future__ import annotations

import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import add_columns, fresh_path, stored

#: Slots of a scorer's memo of looked-up 4-grams, and bytes of its log probabilities; with more languages it holds fewer.
SLOTS, MEMO = 1 << 21, 16 << 20
MASK = (1 << 64) - 1
#: Entries of a model file, on average at most.
PART = 1 << 20
#: One text of HELD is held back for the limits.
HELD = 10
SLACK, LEAST, FEW, STEP, CLASSES = 3.0, 0.1, 100, 0.005, 17
#: Log probabilities (symbols by languages) worked on at once.
PIECE = 1_600_000
FIELDS = [("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("rejected", "boolean")]

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(text: str | None) -> np.ndarray:
    """16-bit symbols: UTF-16 units of letters, and 0 for each run of others; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    own = letters()[code]
    if not own.any():
        return np.empty(0, np.uint64)
    keep = own.copy()
    keep[1:] |= own[:-1]
    picked = np.where(own, code, 0)[keep]
    wide = picked > 0xFFFF
    if wide.any():  # two units
        at = np.flatnonzero(wide) + np.arange(np.count_nonzero(wide))
        rest = picked[wide] - 0x10000
        picked = np.repeat(picked, 1 + wide)
        picked[at], picked[at + 1] = 0xD800 + (rest >> 10), 0xDC00 + (rest & 0x3FF)
    return picked.astype(np.uint64)


def grams(x: np.ndarray) -> np.ndarray:
    """4-grams ending at each symbol, packed; the text starts after boundaries."""
    y = np.concatenate([np.zeros(3, np.uint64), x])
    return (y[:-3] << np.uint64(48)) | (y[1:-2] << np.uint64(32)) | (y[2:-1] << np.uint64(16)) | y[3:]


def mix(keys: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of packed n-grams (the last `order` symbols)."""
    k = keys if order == 4 else keys & np.uint64((1 << 16 * order) - 1)
    k = (k ^ (k >> np.uint64(29)) ^ np.uint64(order * 0x632BE59B)) * np.uint64(0x9E3779B97F4A7C15)
    k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 4) >> np.uint64(64 - 21)).astype(np.int64)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, held, gram, n) of all distinct 4-grams over all texts with a language, held-back texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def squeeze(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = squeeze(parts)
                for i in range(0, len(keys), 100_000):
                    k, c = keys[i : i + 100_000], n[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name[0]] * len(k)), pa.array([name[1]] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "held", "gram", "n"])
            held.clear()

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                by: dict[tuple, list] = {}
                for name, back, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    by.setdefault((name, back), []).append(symbols(t))
                for name, xs in by.items():
                    keys = [grams(x) for x in xs if len(x)]
                    if keys:
                        k, c = np.unique(np.concatenate(keys), return_counts=True)
                        parts = held.setdefault(name, [])
                        parts.append((k, c))
                        size += len(k)
                        if len(parts) >= 24:
                            size -= sum(len(p[0]) for p in parts)
                            held[name] = [squeeze(parts)]
                            size += len(held[name][0][0])
                if size > 4_000_000:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), held_back(text).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, held boolean, gram long, n long").groupBy("lang", "held", "gram").agg(F.sum("n").alias("n"))


def held_back(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(HELD)) == 0


def discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> list[dict]:
    """By order 1..4: sorted hashes of the seen n-grams with log probabilities, and of contexts with log back-offs.

    In memory, for small sets; write_models() does the same for counts of any size.
    """
    count = {4: (keys, n.astype(np.float64))}
    for order in (3, 2, 1):  # an n-gram counts once for each symbol seen before it
        k, c = np.unique(count[order + 1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
        count[order] = k, c.astype(np.float64)
    out, lower = [], None
    for order in (1, 2, 3, 4):
        k, c = count[order]
        context = k >> np.uint64(16)
        ctx, at = np.unique(context, return_inverse=True)
        total, types, d = np.bincount(at, c), np.bincount(at).astype(np.float64), discount(c)
        back = d * types / total
        base = np.full(len(k), 1 / 65536) if lower is None else np.exp(lower(k))
        logp = np.log(np.maximum(c - d, 0) / total[at] + back[at] * base)
        h, hc = mix(k, order), mix(ctx, order)
        o, oc = np.argsort(h), np.argsort(hc)
        level = {"order": order, "hash": h[o], "logp": logp[o].astype(np.float32), "context": hc[oc], "back": np.log(back)[oc].astype(np.float32)}
        out.append(level)
        lower = lambda k, levels=tuple(out): log_prob(k, list(levels))
    return out


def write_models(counts: DataFrame) -> tuple[str, list[tuple]]:
    """Models of (l, gram, n), l a model's number: their folder, and (l, order, kind, bucket, file, entries, first hash) of each file."""
    spark = counts.sparkSession
    folder = fresh_path(spark, "models")
    count = {4: stored(counts.groupBy("l", F.col("gram").alias("k")).agg(F.sum("n").cast("double").alias("c")), "counts")}
    for order in (3, 2, 1):  # an n-gram counts once for each symbol seen before it
        suffix = F.col("k").bitwiseAND((1 << 16 * order) - 1)
        count[order] = stored(count[order + 1].groupBy("l", suffix.alias("k")).agg(F.count(F.lit(1)).cast("double").alias("c")), "counts")
    size = reduce(DataFrame.union, [d.groupBy("l").agg(F.lit(o).alias("o"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")) for o, d in count.items()])
    d = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / PART))).cast("int")
    facts = spark.createDataFrame(size.select("l", "o", d.alias("d"), bits.alias("bits")).collect(), "l int, o int, d double, bits int")  # four rows a language
    parts, lower = [], None
    for order in (1, 2, 3, 4):
        own = count[order].withColumn("x", F.shiftrightunsigned("k", 16)).join(F.broadcast(facts.where(F.col("o") == order)), "l")
        context = own.groupBy("l", "x").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"), F.first("d").alias("d"), F.first("bits").alias("bits"))
        context = stored(context.select("l", "x", "total", "bits", (F.col("d") * F.col("types") / F.col("total")).alias("back")), "contexts")
        own = own.join(context.select("l", "x", "total", "back"), ["l", "x"])
        base = F.lit(1 / 65536)
        if lower is not None:
            own = own.withColumn("s", F.col("k").bitwiseAND((1 << 16 * (order - 1)) - 1)).join(lower.select("l", F.col("k").alias("s"), "p"), ["l", "s"])
            base = F.col("p")
        lower = stored(own.select("l", "k", "bits", ((F.col("c") - F.col("d")) / F.col("total") + F.col("back") * base).alias("p")), "grams")
        parts.append(hashed(lower.select("l", F.col("k").alias("key"), "bits", F.log("p").alias("value")), order, 0))
        parts.append(hashed(context.select("l", F.col("x").alias("key"), "bits", F.log("back").alias("value")), order, 1))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["hash"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(h)
        store, path = store_of(folder)
        store.create_dir(path)
        name = uuid.uuid4().hex  # only files named in the rows of tasks that finished are ever read
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(h[o].tobytes())
            out.write(pdf["value"].to_numpy(np.float64)[o].astype(np.float32).tobytes())
        return pd.DataFrame([[*key, name, len(h), int(h[o].view(np.int64)[0])]], columns=["l", "o", "kind", "bucket", "file", "n", "first"])

    files = reduce(DataFrame.union, parts).groupBy("l", "o", "kind", "bucket").applyInPandas(write, "l int, o int, kind int, bucket long, file string, n long, first long")
    return folder, [tuple(r) for r in stored(files, "files").orderBy("l", "o", "kind", "bucket").collect()]


def hashed(df: DataFrame, order: int, kind: int) -> DataFrame:
    """(l, o, kind, bucket, hash, value): the bucket is the hash's first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            h = mix(np.asarray(b.column(1)).view(np.uint64), order)
            bits = np.asarray(b.column(2)).astype(np.uint64)
            bucket = np.where(bits > 0, h >> ((np.uint64(64) - bits) & np.uint64(63)), 0).astype(np.int64)
            cols = [b.column(0), pa.array(np.full(n, order, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(bucket), pa.array(h.view(np.int64)), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["l", "o", "kind", "bucket", "hash", "value"])

    return df.mapInArrow(run, "l int, o int, kind int, bucket long, hash long, value double")


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


class Held:
    """Parts of a model that are read from a shared store when a text asks for them, and let go by age beyond a bound."""

    def __init__(self, store: fs.FileSystem, room: int = 256 << 20):
        self.store, self.room, self.used = store, room, 0
        self.parts: OrderedDict[str, bytes] = OrderedDict()

    def read(self, path: str) -> bytes:
        if path in self.parts:
            self.parts.move_to_end(path)
            return self.parts[path]
        with self.store.open_input_file(path) as f:
            raw = f.read()
        self.parts[path] = raw
        self.used += len(raw)
        while self.used > self.room and len(self.parts) > 1:
            self.used -= len(self.parts.popitem(last=False)[1])
        return raw


class Part:
    """Sorted numbers of one file, or what is held for them; `first` tells which part a number is in without reading it."""

    def __init__(self, held: Held, path: str, kind: type, size: int, offset: int, first: int):
        self.held, self.path, self.kind, self.size, self.offset, self.first = held, path, kind, size, offset, first

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.frombuffer(self.held.read(self.path), self.kind, self.size, self.offset)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        return self.first if isinstance(at, int) and at == 0 else np.asarray(self)[at]


def open_models(folder: str, files: list[tuple], n: int) -> list[list[dict]]:
    """Levels of n languages, their arrays in parts in order of hashes: mapped into memory where the folder is a file system,
    else read from the store part by part as texts need them. None for a language without files."""
    store, path = store_of(folder)
    models: list[list[dict]] = [[] for _ in range(n)]
    held = Held(store)
    for l, order, kind, _, name, size, first in files:
        if len(models[l]) < order:
            models[l].append({"order": order, "hash": [], "logp": [], "context": [], "back": []})
        keys, values = ("context", "back") if kind else ("hash", "logp")
        if isinstance(store, fs.LocalFileSystem):
            with open(f"{path}/{name}", "rb") as f:
                raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            own, told = np.frombuffer(raw, np.uint64, size), np.frombuffer(raw, np.float32, size, 8 * size)
        else:
            own, told = (Part(held, f"{path}/{name}", t, size, at, np.uint64(first & MASK)) for t, at in ((np.uint64, 0), (np.float32, 8 * size)))
        models[l][-1][keys].append(own)
        models[l][-1][values].append(told)
    return models


def look(sorted_: np.ndarray | list, held: np.ndarray | list, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is held for each value, and whether there is any; sorted arrays may come in parts."""
    if not isinstance(sorted_, list):
        sorted_, held = [sorted_], [held]
    if len(sorted_) == 1:
        at, seen = find(np.asarray(sorted_[0]), values)
        return np.asarray(held[0])[at], seen
    out, seen = np.zeros(len(values), np.float32), np.zeros(len(values), bool)
    part = np.searchsorted(np.array([p[0] for p in sorted_]), values, side="right") - 1
    for i in np.unique(part[part >= 0]):
        own = np.flatnonzero(part == i)
        at, seen[own] = find(np.asarray(sorted_[i]), values[own])
        out[own] = np.asarray(held[i])[at]
    return out, seen


def find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == values


def log_prob(keys: np.ndarray, levels: list[dict]) -> np.ndarray:
    """log P(last symbol | those before it), from the highest order that has been seen, with back-off weights."""
    logp, seen = look(levels[0]["hash"], levels[0]["logp"], mix(keys, 1))
    back, _ = look(levels[0]["context"], levels[0]["back"], mix(np.zeros(1, np.uint64), 1))
    out = np.where(seen, logp, back[0] + np.log(1 / 65536))
    for level in levels[1:]:
        logp, seen = look(level["hash"], level["logp"], mix(keys, level["order"]))
        under = (keys & np.uint64((1 << 16 * level["order"]) - 1)) >> np.uint64(16)
        back, known = look(level["context"], level["back"], mix(under, level["order"]))
        out = np.where(seen, logp, out + np.where(known, back, 0))
    return out


class Scorer:
    """Log probabilities of whole texts under every language; remembers 4-grams it has looked up, up to a bound."""

    def __init__(self, langs: list[str], models: list[list[dict]]):
        self.langs, self.models = langs, models
        self.room = max(1 << 10, min(1 << 20, MEMO // (4 * len(langs))))
        self.piece = max(1 << 10, PIECE // len(langs))
        self.reset()

    def reset(self) -> None:
        self.row = np.full(SLOTS, -1, np.int32)
        self.keys = np.zeros(self.room, np.uint64)
        self.logp = np.zeros((self.room, len(self.langs)), np.float32)
        self.n = 0

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """log P (4-grams by languages)."""
        at = self.row[slot(keys)]
        miss = (at < 0) | (self.keys[at] != keys)
        out = self.logp[at]
        if miss.any():
            new, back = np.unique(keys[miss], return_inverse=True)
            logp = np.stack([log_prob(new, m) for m in self.models], axis=1).astype(np.float32)
            out[miss] = logp[back]
            if self.n + len(new) > len(self.keys):
                self.reset()
            if len(new) <= len(self.keys):
                a, self.n = self.n, self.n + len(new)
                self.keys[a : self.n], self.logp[a : self.n] = new, logp
                self.row[slot(new)] = np.arange(a, self.n)
        return out

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Log probability by text and language, and symbols by text."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                logp = self.rows(np.concatenate([k for _, k in held]))
                starts = np.cumsum([0, *(len(k) for _, k in held[:-1])])
                np.add.at(total, [i for i, _ in held], np.add.reduceat(logp, starts, axis=0, dtype=np.float64))
                held.clear()

        room = self.piece
        for i, t in enumerate(texts):
            keys = grams(x) if len(x := symbols(t)) else x
            size[i] = len(keys)
            for j in range(0, len(keys), self.piece):
                held.append((i, keys[j : j + self.piece]))
                room -= len(held[-1][1])
                if room <= 0:
                    flush()
                    room = self.piece
        flush()
        return total, size


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) // 2, CLASSES - 1)


def limits(seen: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean cross-entropy by language, and the greatest accepted distance from it by language and length class.

    seen (best, class, bin, n): held-back texts by language, length class and cross-entropy in steps of STEP.
    """
    seen = seen.assign(ce=(seen["bin"] + 0.5) * STEP)
    total = seen["n"].sum()
    whole = float((seen["ce"] * seen["n"]).sum() / total) if total else 0.0
    mean = np.full(n, whole)
    for l, own in seen.groupby("best"):
        mean[int(l)] = np.average(own["ce"], weights=own["n"])
    seen = seen.assign(far=np.maximum(seen["ce"] - mean[seen["best"].astype(int)], 0.0)).sort_values("far")
    out = np.full((n, CLASSES), np.inf)

    def quantile(rows: pd.DataFrame, far: np.ndarray) -> float:
        order = np.argsort(far, kind="stable")
        upto = np.cumsum(rows["n"].to_numpy()[order])
        return float(far[order][np.searchsorted(upto, 0.999 * upto[-1])])

    def enough(rows: pd.DataFrame, c: int) -> pd.DataFrame | None:
        """Rows of class c, and of shorter ones until there are enough."""
        for low in range(c, -1, -1):
            part = rows[(rows["class"] <= c) & (rows["class"] >= low)]
            if part["n"].sum() >= FEW:
                return part
        return None

    for l in range(n if total else 0):
        own = seen[seen["best"] == l]
        for c in range(CLASSES):
            parts = [p for rows in (own, seen) if (p := enough(rows, c)) is not None]
            if not parts:
                longer = (seen[seen["class"] <= high] for high in range(c + 1, CLASSES))
                parts = [next((p for p in longer if p["n"].sum() >= FEW), seen)]
            out[l, c] = SLACK * max(LEAST, *(quantile(p, p["far"].to_numpy() * 2.0 ** np.maximum(p["class"].to_numpy() - c, 0)) for p in parts))
    return mean, out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Models of the languages in `docs` (its rows are the training set), and their rejection limits."""
    spark = docs.sparkSession
    counts = stored(count_grams(docs, text, lang), "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    model = {"langs": langs, "folder": "", "files": [], "mean": np.zeros(0), "limit": np.zeros((0, CLASSES))}
    if not langs:
        return model
    n = len(langs)
    at = counts.join(F.broadcast(spark.createDataFrame(list(enumerate(langs)), "l int, lang string")), "lang")
    folder, files = write_models(at.select("l", "gram", "n").union(at.where("not held").select(F.col("l") + n, "gram", "n")))
    part = [(l - n, *rest) for l, *rest in files if l >= n]
    model |= {"folder": folder, "files": [f for f in files if f[0] < n]}

    def make():
        scorer = Scorer(langs, open_models(folder, part, n))

        def fn(column: pa.Array) -> list:
            total, size = scorer.sums(column.to_pylist())
            best = total.argmax(axis=1)
            ce = -total[np.arange(len(best)), best] / np.maximum(size, 1)
            return [best.tolist(), length_class(size).tolist(), np.floor(ce / STEP).astype(np.int64).tolist(), size.tolist()]

        return fn

    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & held_back(text)).select(F.col(text).alias("text"))
    seen = add_columns(seen, "text", [("best", "long"), ("class", "long"), ("bin", "long"), ("size", "long")], make, keep=[])
    if part:
        seen = seen.where("size > 0").groupBy("best", "class", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    else:
        seen = pd.DataFrame({"best": [], "class": [], "bin": [], "n": []})
    model["mean"], model["limit"] = limits(seen, n)
    return model


def predict(df: DataFrame, model: dict, text: str = "text", prefix: str = "") -> DataFrame:
    """df with (names after `prefix`) lang_pred, score (posterior of that language, 0 to 1), entropy (nats a symbol) and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    langs = model["langs"]

    def make():
        m = shared.value
        scorer = Scorer(m["langs"], open_models(m["folder"], m["files"], len(m["langs"]))) if langs else None

        def fn(column: pa.Array) -> list:
            texts = column.to_pylist()
            if scorer is None:
                return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)]
            total, n = scorer.sums(texts)
            some, size = n > 0, np.maximum(n, 1)
            ce = -total / size[:, None]
            best = ce.argmin(axis=1)
            low = ce[np.arange(len(best)), best]
            odds = np.exp(-(ce - low[:, None]) * size[:, None]).sum(axis=1)
            far = some & (low - m["mean"][best] > m["limit"][best, length_class(size)])
            return [[langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, 1 / odds, 0.0).tolist(), [float(v) if s else None for v, s in zip(low, some, strict=True)], far.tolist()]

        return fn

    return add_columns(df, text, [(prefix + n, t) for n, t in FIELDS], make)
