"""Whitening against a dense eigensolver, quality on held-out and planted texts, ranked search against plain scoring."""

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest

from loomscan.llm import quality, queries, ranked, whiten

VECTORS = "vec_id long, embedding array<float>, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own") for i, v in rows], VECTORS)


# --- 11


def dense(rows, k):
    """(n, deviations, whitened up to signs, explained) by the definition."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in np.float32(v).astype(float)] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.standard_normal(24) * np.linspace(2, 0.5, 24) + 1]) for i in range(300)]
    good += [(500 + i, good[7][1]) for i in range(150)]  # one vector holds a third of all rows
    odd = [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf"), *[0.0] * 23]), (905, [1.0] * 3)]
    n, deviation, white, explained = dense(good, 16)
    got = whiten.whiten(vectors(spark, [*good, *odd]).repartition(5)).toPandas()
    assert n == 300 and set(got["vec_id"]) == {i for i, _ in good} and set(got["n"]) == {300} and len(got) == 16 * len(good)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in good]].to_numpy()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-8
    first = got[got["component"] == 1].set_index("vec_id").loc[[i for i, _ in good]]
    assert first["deviation"].tolist() == deviation.tolist()
    shares = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.abs(shares / explained - 1).max() < 1e-9 and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_whitening_of_few_flat_and_extreme_vectors(spark):
    assert whiten.whiten(vectors(spark, [])).count() == 0
    assert whiten.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # two distinct vectors: one component; a null id and a repeated id keep their rows
    line = whiten.whiten(vectors(spark, [(1, [0.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])])).toPandas()
    assert sorted(map(str, line["vec_id"])) == ["1.0", "1.0", "nan"] and set(line["component"]) == {1}
    assert np.allclose(line["whitened"].abs(), 1) and np.allclose(line["explained"], 1) and set(line["deviation"]) == {2 * 64 * 64}
    far = whiten.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 1.0])])).toPandas()
    assert far["deviation"].isna().all() and np.isfinite(far["whitened"]).all()


def test_passes_end_with_certified_components_and_never_hold_the_matrix():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((2000, 300)) * np.linspace(3, 1, 300)
    v, widths = a.T @ a / 2000, []

    def product(q):
        widths.append(q.shape[1])
        return v @ q

    e, u, residuals = whiten.subspace(product, 300, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(e - want).max() < 1e-11 and (residuals <= whiten.CERTIFIED * e[0]).all() and max(widths) == 32 and len(widths) > 3
    assert np.abs(u.T @ u - np.eye(16)).max() < 1e-12
    # a repeated eigenvalue across the edge of the wanted ones
    e, _, _ = whiten.subspace(lambda q: np.diag([5.0] * 20 + [1.0] * 180) @ q, 200, 16)
    assert np.allclose(e, 5)


def test_exact_offsets_beyond_64_bits():
    x = np.array([[1 << 60, 3], [-(1 << 60), 4]], np.int64)
    sums = [0, 7]
    assert whiten.offsets(x, 1000, sums).tolist() == [[(1 << 60) * 1000, 2993], [-(1 << 60) * 1000, 3993]]


# --- 12

DOCS = "doc_id long, text string, score string"


def test_quality_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert len(got) == got["doc_id"].nunique() == 1000 and got["score"].between(0, 1).all()
    assert (held["predicted"] == held["quality"]).mean() >= 0.97 and set(got["predicted"]) == {0, 1}


def planted(n=120):
    """Texts of one good and four bad kinds over invented words."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abdegilmnorstu"), rng.integers(2, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(60)]
        plain = ". ".join(" ".join(w[j : j + 8]).capitalize() for j in range(0, 60, 8)) + "."
        bad = [" ".join(x + "###" for x in w), " ".join(w).upper().replace(" ", "!! "), " | ".join(w), " ".join([w[0]] * 30 + [w[1]] * 30)][i % 4]
        out += [(plain, 1), (bad, 0)]
    return out


def test_quality_learns_marks_not_words(spark):
    texts = planted()
    frame = spark.createDataFrame([(i, t, "old") for i, (t, _) in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts) if i < 160] + [(0, None), (None, 1)], "doc_id long, quality int")
    weights = quality.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(frame, weights).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(texts))
    assert np.array_equal(weights, quality.fit(frame.repartition(7), labels.repartition(3)))  # no order of rows changes a weight


def test_quality_of_odd_rows_and_labels(spark):
    texts = [None, "", " \n", "!!! ???", "x" * 200_000, "one " * 50_000, "é😀 b"]
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(0, "twice", "old"), (None, "no id", "old")], DOCS)
    labels = spark.createDataFrame([(0, 0), (0, 1), (3, 0), (5, 0), (6, 1)], "doc_id long, quality int")
    scored = quality.score(frame, quality.fit(frame, labels)).collect()
    assert len(scored) == 9 and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if not (r["text"] or "").strip()}) == 1
    base = lambda rows: {r["score"] for r in quality.score(frame, quality.fit(frame, spark.createDataFrame(rows, "doc_id long, quality int"))).collect()}
    assert base([]) == {0.5} and max(base([(1, 0)])) < 1e-9 and min(base([(1, 1)])) > 1 - 1e-9
    assert quality.score(frame.limit(0), quality.fit(frame.limit(0), labels)).count() == 0


def test_leader_updates_equal_the_published_recurrence():
    rng = np.random.default_rng(2)
    state = quality.Leader()
    z, n = Counter(), Counter()

    def weight(j):
        l1, l2 = (0, 0) if j == quality.SLOTS else (quality.L1, quality.L2)
        return 0.0 if abs(z[j]) <= l1 else -(z[j] - math.copysign(l1, z[j])) / ((quality.BETA + math.sqrt(n[j])) / quality.ALPHA + l2)

    for _ in range(200):
        slots, y = np.sort(rng.choice(40, 5, replace=False)).astype(np.int32), int(rng.integers(2))
        values = rng.random(5)
        state.update(slots, values, y, 1.5)
        row = [*zip(slots.tolist(), values.tolist(), strict=True), (quality.SLOTS, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(j) * x for j, x in row)))
        for j, x in row:
            g = 1.5 * (p - y) * x
            w, root = weight(j), math.sqrt(n[j])
            n[j] += g * g
            z[j] += g - (math.sqrt(n[j]) - root) / quality.ALPHA * w
    assert all(abs(state.weights()[j] - weight(j)) < 1e-12 for j in [*range(40), quality.SLOTS])


# --- 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_ranks(texts, items, k=20):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in texts]
    live = [d for d in docs if d[2]]
    n, total = len(live), sum(d[2] for d in live)
    df = Counter(t for _, c, _ in live for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in live:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def ranks(spark, texts, items, k=20):
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, item string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.rank(docs, bench, k).select("item", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_ranks_equal_plain_scores(spark, monkeypatch, shard):
    import loomscan.llm.ranked as module

    monkeypatch.setattr(module, "SHARD_WORDS", shard)  # closures take it along to the tasks
    rng = np.random.default_rng(4)
    vocabulary = ["the", "of", "Ää", "x1", *(f"w{i}" for i in range(60))]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=share / share.sum()))) for i in range(300)]
    texts += [(400 + i, texts[5][1]) for i in range(100)] + [(900, None), (901, ""), (902, "THE, the!"), (903, "the " * 5000), (None, texts[5][1]), (904, "é😀　x")]
    items = [(1, "the of"), (2, "w1 w1 W1 w50"), (3, None), (4, ", ,"), (5, "nowhere"), (6, texts[5][1]), (7, "Ää x1 the w9 w9 w30"), (8, "é😀　x")]
    assert ranks(spark, texts, items) == sorted(plain_ranks(texts, items), key=str)


def test_ranks_of_empty_tables_and_repeated_items(spark):
    items = [(1, "a b"), (1, "a b"), (1, "b c")]
    assert ranks(spark, [], items) == [] and ranks(spark, [(1, "a")], []) == [] and ranks(spark, [(1, None)], items) == []
    texts = [(1, "a b"), (2, "b c"), (2, "c c d"), (3, "x y z")]
    assert ranks(spark, texts, items) == sorted(plain_ranks(texts, [(1, "a b"), (1, "b c")]), key=str)


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(6)
    rows = [rng.integers(1, 50, n).astype(float) for n in (1, 5, 12, 12, 9)]
    width = max(map(len, rows))
    marks = ranked.cuts(np.array([np.pad(r, (0, width - len(r))) for r in rows]), np.array([len(r) for r in rows]))
    for r, m in zip(rows, marks, strict=True):
        cost = 1 + ranked.COST * r.std()
        of = lambda ends: sum((j - i) * r[i:j].max() + cost for i, j in pairwise([0, *ends]))  # noqa: B023, E731
        every = [[i + 1 for i in range(len(r) - 1) if bits >> i & 1] + [len(r)] for bits in range(1 << (len(r) - 1))]
        assert abs(of((np.flatnonzero(m) + 1).tolist()) - min(map(of, every))) < 1e-9 and not m[len(r) :].any()


def test_search_passes_over_blocks_that_cannot_win():
    rng = np.random.default_rng(8)
    n = 20_000
    docs, impacts = np.arange(n, dtype=np.int32), rng.integers(1, 1000, n).astype(np.int64)
    impacts[5000:5100] += 100_000
    ends = np.array([n])
    marks = np.flatnonzero(ranked.block_ends(impacts, ends)) + 1
    starts = np.concatenate([[0], marks[:-1]])
    tops = np.maximum.reduceat(impacts, starts)
    one = ranked.Lists(3, docs, impacts.astype(np.int32), docs[starts], docs[marks - 1], tops)
    found, scores, touched = ranked.best([one], 20)
    order = np.lexsort((docs, -impacts))[:20]
    assert found.tolist() == docs[order].tolist() and scores.tolist() == (3 * impacts[order]).tolist() and touched < n / 10
