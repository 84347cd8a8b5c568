"""Toxicity: a counterfactual-regularised classifier over words and word beginnings.

A text's features are the hashed words and word beginnings (3 to 6 characters) that occur in it at all, so a long text
is not diluted. Features whose training counts tell toxic from clean texts beyond chance (log-likelihood ratio over
2 ln of the number of features tested: about one false one expected) enter a logistic model. For every training text
that names an identity group, each term is also swapped for other groups of its kind and language and for a neutral
word, and each change of the text's score is penalised; so a group's mere mention carries no weight.

Bounds: the model is fitted on at most MAX_TOXIC and MAX_CLEAN labelled texts (those of smallest id hash). All their
features that pass the test are kept, as sparse rows. A swap changes a score only by the features of two words, so
tasks send distinct changes with counts: their number hangs on the list of terms, not on how often texts name them.
Scoring covers whole texts.

Results: null and empty texts have no features and get the base score; a doc id labelled twice counts as toxic if any
label says so, and of texts that repeat an id one is learnt from (that of the smallest hash); null labels are ignored; with no usable labels, or none of a class, every score is 0. Extra columns are
passed through; a column named `score` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import Bounded, add_columns, as_bytes, ascii_words, labelled, stored

MAX_TOXIC, MAX_CLEAN = 4000, 8000
STARTS = (3, 4, 5, 6)
#: By language its neutral word, then words that name groups of people, a line for each kind. Words that
#: are common ones of another language (`arm`) are left out.
IDENTITY = """
person: women woman men man girl boy
person: gay lesbian straight transgender bisexual queer
person: black white asian african american european latino hispanic arab
person: jewish muslim christian hindu buddhist atheist
person: german french spanish english mexican chinese indian turkish polish russian
person: immigrant refugee foreigner
person: disabled deaf blind
person: old young elderly
mensch: frauen frau männer mann mädchen junge
mensch: schwul lesbisch
mensch: schwarze weiße
mensch: jüdisch muslimisch christlich
mensch: ausländer flüchtling
mensch: alt jung
personne: femmes femme hommes homme fille garçon
personne: lesbienne homosexuel
personne: noir blanc
personne: juif musulman chrétien
personne: immigré réfugié étranger
personne: vieux jeune
persona: mujeres mujer hombres hombre chica chico
persona: lesbiana homosexual
persona: negro blanco
persona: judío musulmán cristiano
persona: inmigrante refugiado extranjero
persona: viejo joven
"""
#: Other words of its kind that a term is swapped for, beside the neutral one.
SWAPS = 3


def kinds(text: str = IDENTITY) -> list[list[str]]:
    """[neutral word, term, term, ...] of each line."""
    return [[neutral, *terms.split()] for neutral, _, terms in (line.partition(":") for line in text.split("\n") if line.strip())]


def features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace").lower()
    return tuple(dict.fromkeys([xxhash.xxh32_intdigest("=" + text), *(xxhash.xxh32_intdigest(f"{n}{text[:n]}") for n in STARTS if len(text) >= n)]))


def choose(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """Hashes of the features that mark toxic texts, and the number of toxic and clean texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Bounded(features, 200_000)
        held: list[tuple[np.ndarray, int]] = []
        n = [0, 0]

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                toxic = np.repeat([y for _, y in held], [len(k) for k, _ in held])
                yes, all_ = np.bincount(at, toxic, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(yes), pa.array(all_ - yes)], names=["feature", "yes", "no"])
                held.clear()

        size = 0
        for b in batches:
            for t, y in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = {f for w in set(ascii_words(t)) for f in memo[w]}
                held.append((np.fromiter(own, np.int64, len(own)), y))
                n[y] += 1
                size += len(own)
                if size > 2_000_000:
                    yield from out()
                    size = 0
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64())], names=["feature", "yes", "no"])

    counts = sample.mapInArrow(run, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).persist()
    try:
        found = counts.where("feature = -1").collect()
        yes, no = (found[0]["yes"], found[0]["no"]) if found else (0, 0)
        if not yes or not no:
            return np.empty(0, np.int64), yes, no
        tested = counts.count()
        a, b, p = F.col("yes"), F.col("no"), yes / (yes + no)
        term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        na, nb = F.lit(yes) - a, F.lit(no) - b
        m = a + b
        llr = 2 * (term(a, m * p) + term(b, m * (1 - p)) + term(na, (yes + no - m) * p) + term(nb, (yes + no - m) * (1 - p)))
        good = counts.where("feature >= 0").withColumn("llr", llr).where((F.col("llr") > 2 * float(np.log(max(tested, 2)))) & (a > m * p) & (a >= 2))
        return np.sort(good.select("feature").toPandas()["feature"].to_numpy(np.int64)), yes, no
    finally:
        counts.unpersist()


class Reader:
    """Chosen features of texts, and what swaps of identity terms change in them."""

    def __init__(self, chosen: np.ndarray, groups: list[list[str]]):
        place = {int(f): i for i, f in enumerate(chosen)}
        self.memo = Bounded(lambda w: frozenset(place[f] for f in features(w) if f in place), 300_000)
        self.others: dict[bytes, list[bytes]] = {}
        for neutral, *terms in groups:
            for i, t in enumerate(terms):
                near = [terms[(i + step) % len(terms)] for step in range(1, SWAPS + 1)]
                self.others[t.encode()] = [o.encode() for o in dict.fromkeys([neutral, *near]) if o != t]

    def of(self, words: set) -> list[int]:
        out: set = set()
        for found in filter(None, map(self.memo.__getitem__, words)):
            out |= found
        return sorted(out)

    def swapped(self, words: set) -> list[tuple[tuple, tuple]]:
        """(features gained, features lost) of the text with each of its terms replaced by each of that term's others."""
        out = []
        for w in words & self.others.keys():
            rest = set(self.of(words - {w}))
            for o in self.others[w]:
                gained, lost = self.memo[o] - rest, self.memo[w] - rest
                if gained != lost:
                    out.append((tuple(sorted(gained - lost)), tuple(sorted(lost - gained))))
        return out


class Sparse:
    """Rows of (place, value) pairs with products from both sides."""

    def __init__(self, rows: list, values: list | None, width: int):
        self.n, self.width = len(rows), width
        sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if self.n else np.empty(0, np.int64)
        self.value = np.ones(len(self.at)) if values is None else np.concatenate([np.asarray(v, np.float64) for v in values]) if self.n else np.empty(0)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], self.width)


def largest(product, width: int) -> float:
    """Largest eigenvalue of a symmetric product, by power iteration: the steepest curvature that a step must respect."""
    v = np.ones(width)
    for _ in range(40):
        n = np.linalg.norm(v)
        if not n:
            return 0.0
        v = product(v / n)
    return float(np.linalg.norm(v))


def train(x: Sparse, y: np.ndarray, count: np.ndarray, change: Sparse, times: np.ndarray, penalty: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by accelerated proximal descent; `penalty` times the mean squared score change of swaps.

    A row of x stands for `count` texts with the same features and label, one of change for `times` swaps.
    """
    n, mean = count.sum(), float(np.average(y, weights=count))
    w, b = np.zeros(x.width), float(np.log(mean / (1 - mean)))
    share = (np.where(y == 1, 0.25 / mean, 0.25 / (1 - mean)) + 0.5) * count / n
    pull = 2 * penalty * times / max(times.sum(), 1)

    def curve(v: np.ndarray) -> np.ndarray:  # of the loss; the last component is the bias
        r = share * (x.times(v[:-1]) + v[-1])
        return np.append(0.25 * x.back(r) + l2 * v[:-1] + change.back(pull * change.times(v[:-1])), 0.25 * r.sum())

    rate = 1 / (1.2 * largest(curve, x.width + 1) + 1e-6)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = (1 / (1 + np.exp(-np.clip(x.times(v) + c, -30, 30))) - y) * share
        new = v - rate * (x.back(err) + l2 * v + change.back(pull * change.times(v)))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        bias, t2 = c - rate * float(err.sum()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, groups: list[list[str]] | None = None, penalty: float = 1.0) -> dict:
    """Model from documents (doc_id, text) and labels (doc_id, toxic); groups as kinds() gives them."""
    groups = kinds() if groups is None else groups
    sample = stored(labelled(docs, labels, "toxic", {1: MAX_TOXIC, 0: MAX_CLEAN}).select("text", "label"), "labelled")
    chosen, yes, no = choose(sample)
    if not yes or not no:
        return {"chosen": np.empty(0, np.int64), "weights": np.empty(0), "bias": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chosen, groups)
        seen: Counter = Counter()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for t, y in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    words = set(ascii_words(t))
                    seen[y, tuple(reader.of(words)), ()] += 1
                    for gained, lost in reader.swapped(words):
                        seen[None, gained, lost] += 1
                if len(seen) > 20_000:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        y, own, lost = zip(*seen, strict=True) if seen else ((), (), ())
        lists = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(own, lists), pa.array(lost, lists), pa.array(list(seen.values()), pa.int64())], names=["y", "own", "lost", "n"])

    rows = sample.mapInArrow(run, "y int, own array<int>, lost array<int>, n long").groupBy("y", "own", "lost").agg(F.sum("n").cast("double").alias("n")).orderBy("y", "own", "lost").toPandas()
    texts, swaps = rows[rows["y"].notna()], rows[rows["y"].isna()]
    x = Sparse(texts["own"].tolist(), None, len(chosen))
    both = [(np.concatenate([g, l]), np.repeat([1.0, -1.0], [len(g), len(l)])) for g, l in zip(swaps["own"], swaps["lost"], strict=True)]
    change = Sparse([b[0] for b in both], [b[1] for b in both], len(chosen))
    w, b = train(x, texts["y"].to_numpy(np.float64), texts["n"].to_numpy(), change, swaps["n"].to_numpy(), penalty)
    return {"chosen": chosen, "weights": w, "bias": b}


def score(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """df with column `name`, 0 to 1, the score of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        reader, w, b = Reader(m["chosen"], []), m["weights"], m["bias"]

        def fn(column: pa.Array) -> list:
            if b is None:
                return [[0.0] * len(column)]
            z = np.array([b + w[reader.of(set(ascii_words(t)))].sum() for t in as_bytes(column)])
            return [(1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()]

        return fn

    return add_columns(df, text, [(name, "double")], make)
