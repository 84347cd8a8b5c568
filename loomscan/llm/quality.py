"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is cut into words and runs of punctuation. Its features are hashed n-grams (1 and 2) of these tokens, and n-grams
(1 to 3) of their shapes: capitalised, upper, lower, mixed, digits, punctuation by its first two characters, and "same
as the one or two before", so that what marks a text is learnt without the words it happens to use. A feature's value is
the root of its share of the text's n-grams of its kind, so long texts weigh no more than short ones. A score is the
sparse dot product of values and weights, through the logistic function.

Training follows the regularised leader (per-coordinate rates, L1 and L2) over a bounded sample of labelled texts: at most
MAX_TEXTS of each class, those of smallest id hash, weighted so that the classes keep their true proportion. Features are
computed by tasks; an epoch is one job that streams the sample's stored features in hash order through the updates and
hands on its state of SLOTS numbers, so memory does not hang on the texts' lengths.

Results: null and empty texts have no n-grams and get the base score; null labels are ignored; with no usable labels every
score is 0.5, with one class only 1 or 0. Whole texts are scored. Extra columns pass through; a column named `score` is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import ROWS, Bounded, add_columns, labelled, stored

#: The documented bound of the sample, for each class.
MAX_TEXTS = 4000
SLOTS = 1 << 18
EPOCHS = 4
#: Rates of the updates: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.3, 0.05
TOKEN = re.compile(r"\w+|[^\w\s]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def token_codes(token: str) -> tuple[int, int]:
    """Hashes of a token's text and of its shape."""
    import xxhash

    head = token[0]
    if not (head.isalnum() or head == "_"):
        shape = "." + token[:2]
    elif token.isdigit():
        shape = "9"
    elif token.isupper():
        shape = "A" if len(token) > 1 else "I"
    elif token.islower():
        shape = "a"
    else:
        shape = "Aa" if token[1:].islower() else "aA"
    return xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape)


#: Code of the shape "same as a word before".
SAME = np.uint64(token_codes("x")[0] ^ 0x5A5A)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * PRIME
    return h ^ (h >> np.uint64(29))


class Featurizer:
    """Sparse rows of a batch of texts: (row, slot, value) arrays, sorted by row and slot."""

    def __init__(self):
        self.memo = Bounded(token_codes, 300_000)

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, sizes = [], []
        for t in texts:
            found = TOKEN.findall(t) if t else []
            tokens += found
            sizes.append(len(found))
        if not tokens:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        codes = np.array([self.memo[t] for t in tokens], np.uint64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        word, shape = codes[:, 0], codes[:, 1].copy()
        wordy = np.array([t[0].isalnum() for t in tokens])
        for step in (1, 2):
            again = np.zeros(len(word), bool)
            again[step:] = (word[step:] == word[:-step]) & (doc[step:] == doc[:-step])
            shape[again & wordy] = SAME
        keys, values = [], []
        for kind, codes_, longest in ((0, word, 2), (1, shape, 3)):
            own, grams = [], codes_
            for n in range(1, longest + 1):
                if n > 1:
                    grams = mixed(grams[:-1] + np.uint64(n)) ^ codes_[n - 1 :]
                whole = doc[: len(grams)] == doc[n - 1 :]
                slot = (mixed(grams + np.uint64(100 * kind + n)) % np.uint64(SLOTS)).astype(np.int64)
                own.append((doc[: len(grams)] * SLOTS + slot)[whole])
            key, count = np.unique(np.concatenate(own), return_counts=True)
            total = np.bincount(key // SLOTS, count, len(texts))
            keys.append(key)
            values.append(np.sqrt(count / total[key // SLOTS]))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(at, np.concatenate(values), len(key))
        return key // SLOTS, key % SLOTS, value


class Leader:
    """Follow-the-regularised-leader state; the last slot is the bias, without penalty."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(SLOTS + 1) if z is None else z
        self.n = np.zeros(SLOTS + 1) if n is None else n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.arange(SLOTS + 1)[at] == SLOTS
        over = np.sign(z) * np.maximum(np.abs(z) - np.where(free, 0, L1), 0)
        return -over / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0, L2))

    def update(self, slots: np.ndarray, values: np.ndarray, y: int, weight: float) -> None:
        at, x = np.append(slots, SLOTS), np.append(values, 1.0)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(turn, label, slots, values) of the sample's texts, stored; `turn` is their order in an epoch."""
    sample = labelled(docs, labels, "quality", {0: MAX_TEXTS, 1: MAX_TEXTS})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                row, slot, value = featurizer.rows(part.column(2).to_pylist())
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                cut = lambda a, ends=ends: pa.array([a[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())  # noqa: B905, E731
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cut(slot.astype(np.int32)), cut(value)], names=["turn", "label", "slots", "values"])

    return stored(sample.select(F.xxhash64("doc_id").alias("turn"), "label", "text").mapInArrow(run, "turn long, label int, slots binary, values binary"), "quality-sample")


def epoch(rows: DataFrame, leader: Leader, weight: dict[int, float]) -> Leader:
    """The state after one pass over the sample; the sample is bounded, so one task takes it in order."""
    shared = rows.sparkSession.sparkContext.broadcast((leader.z, leader.n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Leader(*(a.copy() for a in shared.value))
        for b in batches:
            for r in b.to_pylist():
                state.update(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"]), r["label"], weight[r["label"]])
        yield pa.RecordBatch.from_arrays([pa.array([state.z.tobytes()]), pa.array([state.n.tobytes()])], names=["z", "n"])

    z, n = rows.coalesce(1).sortWithinPartitions("turn").mapInArrow(run, "z binary, n binary").collect()[0]
    shared.destroy()
    return Leader(np.frombuffer(bytes(z)).copy(), np.frombuffer(bytes(n)).copy())


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot, the bias last, from documents (doc_id, text) and labels (doc_id, quality 0 or 1)."""
    rows = sample_rows(docs, labels)
    have = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    out = np.zeros(SLOTS + 1)
    if len(have) < 2:
        out[-1] = {0: -np.inf, 1: np.inf}.get(next(iter(have), None), 0.0)
        return out
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    true = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = {y: true[y] / have[y] for y in have}
    mean = sum(true[y] for y in have) / sum(have.values())
    leader = Leader()
    for _ in range(epochs):
        leader = epoch(rows, leader, {y: s / mean for y, s in share.items()})
    return leader.weights()


def score(df: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """df with column `name`, 0 to 1: how likely each whole text is of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        featurizer, w = Featurizer(), shared.value

        def fn(column: pa.Array) -> list:
            row, slot, value = featurizer.rows(column.to_pylist())
            z = np.bincount(row, value * w[slot], len(column)) + w[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))]

        return fn

    return add_columns(df, text, [(name, "double")], make, rows=min(ROWS, 64))
