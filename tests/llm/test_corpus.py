"""Corpus operators against brute force, round trips and held-out accuracy, and on nulls, ties and empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomscan.llm import bpe, chat, decontam, extract, langid, licenses, mtree, queries, simhash, toxicity, warc
from loomscan.llm.common import Bounded

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "é😀　x", "Word " * 3000, "a" * 20000, "MIT License", "MIT License", "The quick brown fox jumps over the lazy dog today again"]


@pytest.fixture(scope="module")
def tokenizers():
    t = pytest.importorskip("tokenizers")
    return t.Tokenizer.from_file(queries.tokenizer_path())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- 1


def test_bpe_matches_tokenizers(spark, tokenizers, tmp_path):
    texts = [*ODD, "<|endoftext|>", "a<|endoftext|> b", "don't we'll", " \n\n x", "ab" * 9000, "'" * 50 + "re"]
    sf = write(spark, tmp_path / "d", documents=docs(spark, texts))
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, sf).collect()}
    for i, t in enumerate(texts):
        ids = tokenizers.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_transducer_streams_long_words_in_constant_memory(tokenizers):
    merges = bpe.Merges(queries.tokenizer_path())
    assert 0 < merges.lookahead < 1000
    rng = random.Random(1)
    word = "".join(rng.choice("aeinorst") for _ in range(20000))
    tr, out, most = bpe.Transducer(merges, window=64), [], 0
    for i in range(0, len(word), 37):
        out += tr.feed(word[i : i + 37].encode())
        most = max(most, len(tr.buffer))
    assert out + tr.finish() == tokenizers.encode(word, add_special_tokens=False).ids
    assert most < 2 * (merges.lookahead + 64)


def test_text_state_holds_split_characters_and_replaces_bad_ones():
    state = bpe.TextState([b"\xf0\x9f", b"\x98\x80", b"x", b"\xff"])
    assert [state.feed([0]), state.feed([1, 2]), state.feed([3, 0]), state.finish()] == ["", "😀x", "�", "�"]


def test_encode_decode_keep_and_replace_columns(spark):
    df = spark.createDataFrame([(1, "hi", "old")], "k int, text string, ids string")
    path = queries.tokenizer_path()
    row = bpe.decode(bpe.encode(df, path), path).collect()[0]
    assert row["k"] == 1 and row["decoded"] == "hi" and isinstance(row["ids"], list)
    assert bpe.encode(df.limit(0), path).count() == 0


# --- 2

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocab = ["the", "of", "Ää", "x1", "foo", "bar"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 9, 40, 200]))) for _ in range(60)] + ODD
    items = ["", None, "foo", "the of, foo", *(" ".join(w[5:25]) for t in texts[:30] if len(w := words(t)) > 20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sf = write(spark, tmp_path / "d", documents=docs(spark, texts), benchmark=bench)
    got = {r["doc_id"]: r for r in queries.op2_decontamination(spark, sf).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, x in enumerate(items):
            if v := words(x):
                n = min(10, len(v))
                runs = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in runs:
                        hit |= set(range(j, j + n))
                        found.add(k)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_near_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["alpha x beta y gamma", "alpha", "beta gamma alpha", *(" ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.randrange(30))) for _ in range(40))]
    d = docs(spark, texts)
    items = {1: "alpha beta gamma", 2: "alpha", 3: "alpha beta alpha"}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    index = decontam.build_index(d)
    found = decontam.search(index, *decontam.item_terms(bench), slop=2).where("kind = 'near'").select("doc_id", "item", "start", "stop").collect()
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        for k, x in items.items():
            need = Counter(words(x))
            holds = lambda a, b: not need - Counter(w[a:b])  # noqa: B023, E731
            size = sum(need.values())
            want |= {(i, str(k), a, b) for a in range(len(w)) for b in range(a + size, min(a + size + 2, len(w)) + 1) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    whole = sorted(map(tuple, decontam.search(index, *decontam.item_terms(bench)).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 2)
    terms, blocks = decontam.item_terms(bench)
    assert blocks > 1 and sorted(map(tuple, decontam.search(index, terms, blocks).collect())) == whole
    for a, b in ((d.limit(0), bench), (d, bench.limit(0))):
        assert decontam.decontaminate(a, b)[1].count() == 0


def test_decontamination_of_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_DOCS", 2)
    text = "one two three four five six seven eight nine ten eleven"
    rows = [("a", text), ("a", text), (None, text + " more"), (None, ""), ("b", None), ("c", "")]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("shard", F.lit("clash")).coalesce(1)
    index, matches = decontam.decontaminate(d, spark.createDataFrame([("i", text)], "item_id string, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.document_report(index, matches).collect()]
    assert sorted(got, key=str) == sorted([("a", 11, 11, ["i"])] * 2 + [(None, 12, 11, ["i"]), (None, 0, 0, []), ("b", 0, 0, []), ("c", 0, 0, [])], key=str)


# --- 3


def test_preferences(spark):
    rows = [(1, True, 0, "user", "q"), (1, False, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, False, 1, "assistant", "bad"), (2, True, 0, None, None), (3, True, 0, "user", "a"), (3, False, 0, "user", "a"), (1, True, 2, "user", "ok")]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn int, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r["pair_id"]: r for r in chat.preference_pairs(df).collect()}
    assert got[1]["prompt"] == "<|user|>\nq\n<|end|>\n" and got[1]["prompt_turns"] == 1
    assert got[1]["chosen"].startswith("<|assistant|>\ngood") and got[1]["rejected"].startswith("<|assistant|>\nbad")
    assert got[1]["chosen_mask"] == f"1:{len('<|assistant|>\ngood\n<|end|>\n')},0:{len('<|user|>\nok\n<|end|>\n')}"
    assert (got[2]["prompt"], got[2]["rejected"]) == ("", "") and got[2]["chosen"] == "<||>\n\n<|end|>\n"
    assert (got[3]["chosen"], got[3]["rejected"], got[3]["prompt_turns"]) == ("", "", 1)
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_preferences_of_repeated_turns_long_texts_and_null_pairs(spark):
    long = "word " * 200_000
    rows = [(1, True, 0, "user", "b"), (1, True, 0, "user", "a"), (1, False, 0, "user", "a"), (1, False, 0, "user", "c"), (None, True, 0, "user", "q"), (None, False, 0, "user", "q"), (2, True, 0, "user", long), (2, False, 0, "user", long), (2, True, 1, "assistant", long), (2, False, None, "assistant", None)]
    got = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn int, role string, text string")).collect()}
    show = lambda *texts: "".join(f"<|user|>\n{t}\n<|end|>\n" for t in texts)
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == (show("a"), show("b"), show("c"))
    assert set(got) == {1, 2}  # rows without a pair id are no pair, and so no hot group
    assert got[2]["prompt_turns"] == 0 and got[2]["chosen"] == show(long) + f"<|assistant|>\n{long}\n<|end|>\n" and got[2]["rejected"].startswith("<|assistant|>\n\n<|end|>")  # a null turn comes first


# --- 4


def toxic_set(rng, n=400):
    plain = ["tree", "river", "cloud", "stone", "walk", "green", "light", "paper", "women", "muslim", "music"]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(3, 30))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorkling", "zorkest"]))
            if rng.random() < 0.8:
                w.append("gay")  # a group that toxic texts name more often
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_held_out_and_counterfactual(spark):
    rows = toxic_set(random.Random(3))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    train = labels.where(queries.remainder(3) != 1)
    model = toxicity.fit(d, train)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in held)
    probe = spark.createDataFrame([(1, "the gay river"), (2, None), (3, ""), (4, "the river")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    free = {r["doc_id"]: r["score"] for r in toxicity.score(probe, toxicity.fit(d, train, penalty=0.0)).collect()}
    assert score[1] < 0.3 and score[1] - score[4] < 0.5 * (free[1] - free[4])
    assert score[2] == score[3]
    for empty in (toxicity.fit(d, labels.limit(0)), toxicity.fit(d.limit(0), labels), toxicity.fit(d, labels.where("toxic = 0"))):
        assert toxicity.score(probe, empty).agg(F.max("score")).collect()[0][0] == 0.0


def plain_fit(rows, penalty=1.0):
    """The classifier from its definition: counts, likelihood ratios, and gradient descent over dense rows."""
    of = {}
    feats = lambda w: of.setdefault(w, set(toxicity.features(w.encode())))
    sets = [(set().union(*map(feats, set(words(t)))) if words(t) else set(), y) for _, t, y in rows]
    yes, no = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    a, m = Counter(f for s, y in sets if y for f in s), Counter(f for s, _ in sets for f in s)
    p, n = yes / (yes + no), yes + no
    term = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    llr = lambda f: 2 * (term(a[f], m[f] * p) + term(m[f] - a[f], m[f] * (1 - p)) + term(yes - a[f], (n - m[f]) * p) + term(no - m[f] + a[f], (n - m[f]) * (1 - p)))
    chosen = sorted(f for f in m if llr(f) > 2 * math.log(max(len(m) + 1, 2)) and a[f] > m[f] * p and a[f] >= 2)
    vector = lambda s: np.array([f in s for f in chosen], float)
    x, y = np.array([vector(s) for s, _ in sets]), np.array([y for _, y in sets])
    change = []
    for _, t, _ in rows:
        own = set(words(t))
        for neutral, *terms in toxicity.kinds():
            for i, w in enumerate(terms):
                if w in own:
                    others = dict.fromkeys([neutral, *(terms[(i + k) % len(terms)] for k in (1, 2, 3))])
                    after = [set().union(*map(feats, (own - {w}) | {o})) for o in others if o != w]
                    change += [d for s in after if (d := vector(s) - vector(set().union(*map(feats, own)))).any()]
    change = np.array(change).reshape(-1, len(chosen))
    share = (np.where(y == 1, 0.25 / p, 0.25 / (1 - p)) + 0.5) / n

    def loss(w, b):
        z = x @ w + b
        fit = (share * (np.logaddexp(0, z) - y * z)).sum()
        return fit + 0.5e-4 * w @ w + 2e-4 * np.abs(w).sum() + (penalty * ((change @ w) ** 2).mean() if len(change) else 0)

    return chosen, loss


def test_toxicity_fit_by_definition(spark):
    rows = toxic_set(random.Random(8), 240)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    chosen, loss = plain_fit(rows)
    assert model["chosen"].tolist() == chosen and len(chosen) > 3
    best = loss(model["weights"], model["bias"])
    rng = np.random.default_rng(1)
    for size in (1e-3, 1e-2, 0.1, 1.0):  # no weights near or far have a lower loss
        for _ in range(50):
            assert loss(model["weights"] + size * rng.normal(size=len(chosen)), model["bias"] + size * rng.normal()) > best - 1e-6
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    for i, t, _ in rows[:50]:
        own = set().union(*(toxicity.features(w.encode()) for w in set(words(t))))
        z = model["bias"] + sum(w for f, w in zip(chosen, model["weights"]) if f in own)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_swaps_stay_in_kind_and_do_not_grow_with_mentions(spark):
    reader = toxicity.Reader(np.array(sorted({f for w in (b"gay", b"straight", b"person", b"women") for f in toxicity.features(w)})), toxicity.kinds())
    assert {o for o in reader.others[b"gay"]} == {b"person", b"lesbian", b"straight", b"transgender"} and b"arm" not in reader.others
    every = " ".join(t for _, *terms in toxicity.kinds() for t in terms)
    rows = [(i, every + (" idiot" if i % 2 else " tree"), i % 2) for i in range(60)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert score[1] > 0.7 > 0.3 > score[0]


# --- 5


def test_warc_round_trip_and_lookup(spark, tmp_path):
    pages = [(1, "http://www.b.example.com/x?q=1", "<p>é</p>"), (2, "http://a.example.com/", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://b.example.com/x?q=1", "z" * 50000), (6, "http://[bad", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    sf = write(spark, tmp_path / "d", pages=df)
    got = {r["page_id"]: r for r in queries.op5_warc(spark, sf).collect()}
    assert len(got) == 6
    for i, _, h in pages:
        body = (h or "").encode()
        first = min(k for k, _, x in pages if (x or "").encode() == body)
        assert got[i]["payload_bytes"] == len(body) and got[i]["payload_digest"] == warc.digest(body)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert queries.op5_warc(spark, write(spark, tmp_path / "e", pages=df.limit(0))).count() == 0


def test_warc_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(i, f"http://h{i % 7}.example.org/p{i % 5}", f"body {i}") for i in range(60)] + [(i // 2 or None, None, f"own {i}") for i in range(40)] + [(77, "u", f"x {i}") for i in range(20)]
    captures = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several sorting tasks
    try:
        top, folder = warc.index(captures)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    archives = captures.first()["folder"]
    assert sum(r[4] for r in top) >= 40 and len(top) > 1
    wanted = spark.createDataFrame([(warc.url_key("http://h3.example.org/p2"), None), ("org,nowhere)/", None), ("", None)], "key string, page_id long")
    found = warc.lookup(wanted, top, folder, archives).collect()
    assert sorted(r["page_id"] for r in found) == [i for i in range(60) if i % 7 == 3 and i % 5 == 2] and all(r["intact"] for r in found)
    finder = warc.Finder(top, folder, archives)
    read = lambda places: sorted(warc.parse(finder.read(f"{finder.archives}/{n}", o, k))["payload"].decode() for _, n, o, k in places)
    for page in {p for p, _, _ in pages}:  # every pair of key and page id, by one search and in turns
        for url in {u for p, u, _ in pages if p == page}:
            want = sorted(h for p, u, h in pages if (p, u) == (page, url))
            assert read(finder.captures(warc.url_key(url), page, False)) == want
            assert read(x for turn in range(4) for x in finder.captures(warc.url_key(url), page, False, turn, 4)) == want
    assert len(list(finder.captures(warc.url_key(None), None, True))) == 40
    assert warc.url_key("https://WWW.A.b.org:443/Q?x#f") == "org,b,a)/Q?x" and warc.url_key("http://a.org:8080/") == "org,a:8080)/" != warc.url_key("http://a.org/")


def test_warc_records_are_well_formed(spark):
    df = spark.createDataFrame([(1, "http://a.org/x\ny", "<p>é</p>"), (2, "http://a.org/", "<p>é</p>")], "page_id long, url string, html string")
    captures = warc.write(df.coalesce(1))
    store, path = warc.opened(captures.first()["folder"])
    with store.open_input_file(f"{path}/{captures.first()['file']}") as f:
        raw, members = f.read(), []
    while raw:
        d = zlib.decompressobj(31)
        members.append(d.decompress(raw))
        raw = d.unused_data
    assert [re.search(rb"WARC-Type: (\w+)", m)[1] for m in members].count(b"warcinfo") == 1 and members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    by = {re.search(rb"X-Page-ID: (\d)", m)[1]: m for m in members[1:]}
    assert b"Content-Type: application/http" in by[b"1"] and by[b"1"].endswith(b"\r\n\r\n<p>\xc3\xa9</p>\r\n\r\n") and b"http://a.org/x%0Ay" in by[b"1"]
    assert re.search(rb"WARC-Refers-To: (\S+)", by[b"2"])[1] == re.search(rb"WARC-Record-ID: (\S+)", by[b"1"])[1]
    assert len({re.search(rb"WARC-Record-ID: (\S+)", m)[1] for m in members}) == 3
    found = warc.lookup(spark.createDataFrame([(warc.url_key("http://a.org/x\ny"), 1)], "key string, page_id long"), *warc.index(captures), captures.first()["folder"]).collect()
    assert [(r["url"], r["intact"]) for r in found] == [("http://a.org/x\ny", True)]


def test_warc_line_separators_and_null_page_ids(spark, tmp_path):
    marks = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", " ", "\t", "\x00"]
    urls = [f"http://{host}/a{m}b?c{m}d" for m in marks for host in ("a.example.com", f"a{m}b.example.com", "[bad")]
    pages = [(i, u, f"body {i}") for i, u in enumerate(urls)] + [(None, "http://n.example.com/", "null id"), (None, "http://n.example.com/", "other"), (500, "http://n.example.com/", "own"), (None, None, "body 3"), (None, None, "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sf = write(spark, tmp_path / "d", pages=df)
    got = [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op5_warc(spark, sf).collect()]
    want = [(i, warc.digest(h.encode()), *(("revisit", 3 if h == "body 3" else 500) if i is None and h in ("body 3", "own") else ("response", None))) for i, _, h in pages]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(c.isspace() or ord(c) < 32 for u in urls for c in warc.url_key(u))


# --- 6


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    d = docs(spark, [*ODD, "a b c", "A  b\tc", "one two three four five"])
    for r in simhash.fingerprints(d).collect():
        assert r["fp"] % (1 << 64) == slow_fingerprint(r["text"])


@pytest.mark.parametrize("piece", [1 << 19, 1 << 12])
def test_links_and_components_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:20]:  # chains of near values
        for _ in range(6):
            for _ in range(rng.choice([1, 3, 4, 5])):
                b ^= 1 << rng.randrange(64)
            fps.add(b)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(signed[i]), find(signed[j])))
                root[y] = x
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(docs(spark, [None, "", "a b c d e f", "A b c d e f"])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_crowded_prefixes_are_cut_deeper(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centre = int(rng.integers(0, 1 << 62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)) for _ in range(150)}
    fps = sorted(near | {int(v) for v in rng.integers(0, 1 << 62, 100)})
    df = simhash.stored(spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in fps], "fp long"), "fps")

    def roots() -> dict:
        return {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(df)).collect()}

    label = {v: v for v in fps}  # brute force
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    plain = roots()
    monkeypatch.setattr(simhash, "CROWD", 110)
    assert simhash.dealt(df, 8, 2).select("bits").distinct().count() > 1
    cut = roots()
    assert cut == plain and len(cut) > 50
    same = lambda labels: {frozenset(k for k, v in labels.items() if v == x) for x in set(labels.values())}
    assert same(cut) == {g for g in same(label) if len(g) > 1}


# --- 7


def test_licences(spark, tmp_path):
    clause = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    texts = [
        *ODD, "x GNU General Public License, and gnu general-public license MIT", "CC BY-NC 4.0 or CC\nby", clause.replace("obtaining", "receiving"), "apache license " * 3,
        clause.replace("to any", "hereby and freely to any"), clause.replace("hereby granted", "granted hereby"), clause[:60], "by nc cc by nc cc by",
        *(t for t in [" ".join(random.Random(i).sample(clause.split(), 20)) for i in range(5)]), "lead " + " ".join(w for w in clause.split() if w != "person") + " tail",
    ]
    df = docs(spark, texts).withColumn("labels", F.lit("clash")).withColumn("hits", F.lit(1))
    sf = write(spark, tmp_path / "d", documents=df)
    got = {r["doc_id"]: r for r in queries.op7_licenses(spark, sf).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        base = [(j, label) for p, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        labels, best = {x for _, x in base}, 1.0 if base else 0.0
        for x in licenses.templates():
            v, at, n = x["words"], x["at"], x["key"]
            for j in range(len(w)):
                if w[j : j + n] == v[at : at + n]:
                    share = sum(any(0 <= j - at + k + d < len(w) and w[j - at + k + d] == v[k] for d in range(-3, 4)) for k in range(len(v))) / len(v)
                    if share >= 0.7:
                        labels.add(x["label"])
                        best = max(best, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["score"]) == (len(w), len(base), best)
        assert (r["first_word"], r["last_word"]) == (min((j for j, _ in base), default=None), max((j for j, _ in base), default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted({x for _, x in base})), ",".join(sorted(labels)))
    n = len(ODD)
    assert got[n + 1]["labels"] == "cc-by,cc-by-nc" and got[n + 2]["labels"] == got[n + 4]["labels"] == "mit" and 0.7 <= got[n + 2]["score"] < 1 and got[n + 5]["labels"] == ""
    assert licenses.scan(df.limit(0)).count() == 0


# --- 8


def test_language_models(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["schw", "ung", "kei"], "cc": ["ción", "lla", "ñe"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(20)), x) for i in range(300) for x in [rng.choice([*syllables])]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d.where(queries.remainder(5) != 0))
    got = {r["doc_id"]: r for r in langid.predict(d.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["lang_pred"] == x and 0 <= got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, x in rows)
    odd = spark.createDataFrame([(0, None), (1, "12 !"), (2, "Совсем другое письмо, не отсюда"), (3, "schwung keiung " * 40000)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in langid.predict(odd, model).collect()}
    assert r[0]["lang_pred"] == r[1]["lang_pred"] == "und" and r[0]["score"] == 0 and r[2]["rejected"] and r[3]["lang_pred"] == "bb"
    assert langid.predict(odd, langid.fit(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_sums_to_one():
    keys, n = np.unique(np.concatenate([langid.grams(langid.symbols(t)) for t in ("abracadabra", "cadabra bar", "rab")]), return_counts=True)
    levels = langid.kneser_ney(keys, n)
    context = (int(ord("a")) << 48) | (int(ord("b")) << 32) | (int(ord("r")) << 16)
    every = np.arange(65536, dtype=np.uint64) | np.uint64(context)
    assert abs(np.exp(langid.log_prob(every, levels)).sum() - 1) < 1e-3


def test_models_hold_every_gram_in_files(spark, monkeypatch):
    monkeypatch.setattr(langid, "PART", 500)
    base = 0x4E00  # two grams of one slot: both are kept, with their own counts
    seen: dict = {}
    for i in range(20000):
        text = "".join(chr(base + x) for x in (i % 97, i // 97 % 89, i % 83, i % 71))
        key = langid.grams(langid.symbols(text))[-1]
        other = seen.setdefault(int(langid.slot(np.array([key]))[0]), text)
        if other != text:
            break
    rng = random.Random(8)
    texts = [other] * 3 + [text] * 9 + ["".join(chr(base + rng.randrange(60)) for _ in range(200)) for _ in range(20)]
    rows = [(i, t, "zz") for i, t in enumerate(texts)] + [(99, "abracadabra cadabra bar rab", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys, n = np.unique(np.concatenate([langid.grams(langid.symbols(t)) for t in texts]), return_counts=True)
    counts = langid.stored(langid.count_grams(d, "text", "lang"), "counts")
    whole = counts.where("lang = 'zz'").groupBy("gram").agg(F.sum("n").alias("n"))
    assert {r["gram"] % (1 << 64): r["n"] for r in whole.collect()} == dict(zip(keys.tolist(), n.tolist()))
    folder, files = langid.write_models(counts.select(F.when(F.col("lang") == "zz", 1).otherwise(0).alias("l"), "gram", "n"))
    levels = langid.open_models(folder, files, 2)[1]
    assert [x["order"] for x in levels] == [1, 2, 3, 4] and len(levels[3]["hash"]) > 4 and sum(map(len, levels[3]["hash"])) == len(keys)
    probes = np.concatenate([keys, keys ^ np.uint64(3), keys ^ np.uint64(5 << 48), np.arange(50, dtype=np.uint64)])
    assert np.allclose(langid.log_prob(probes, levels), langid.log_prob(probes, langid.kneser_ney(keys, n)), atol=1e-4)


def naive_kneser_ney(texts):
    """log P(symbol | three before), from the definition with dictionaries."""
    grams = Counter()
    for t in texts:
        x = [0, 0, 0, *langid.symbols(t).tolist()]
        grams.update(tuple(x[i : i + 4]) for i in range(len(x) - 3))
    count = {4: grams}
    for order in (3, 2, 1):
        count[order] = Counter(g[1:] for g in count[order + 1])

    def p(g):
        if not g:
            return 1 / 65536
        c = count[len(g)]
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(c[g] - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

    return lambda g: math.log(p(g))


def test_kneser_ney_by_definition_and_rejection(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schw", "ung", "kei", "𐐨𐐩"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(rng.choice([2, 20, 60]))), x) for i in range(500) for x in [rng.choice([*syllables])]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    levels = langid.open_models(model["folder"], model["files"], 2)
    for l, name in enumerate(model["langs"]):
        slow = naive_kneser_ney([t for _, t, x in rows if x == name])
        for t in ("kato mire", "schwung", "qx 𐐨𐐩ka", "ungto"):
            x = [0, 0, 0, *langid.symbols(t).tolist()]
            assert np.allclose(langid.log_prob(langid.grams(langid.symbols(t)), levels[l]), [slow(tuple(x[i : i + 4])) for i in range(len(x) - 3)], atol=1e-4)
    probe = [t for _, t, _ in rows] + ["qwxz zzkq vvbn plkj wqsd hgfd mnbv cxzl " * 3, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura", "Совсем другое письмо, не отсюда и не оттуда, а из других мест"]
    found = langid.predict(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["rejected"] for r in found] == [False] * len(rows) + [True] * 3
    assert [r["lang_pred"] for r in found[: len(rows)]] == [x for *_, x in rows]
    assert langid.symbols("a𐐨b").tolist() == [97, 0xD801, 0xDC28, 98]


# --- 9


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><a href=/>Home page link</a></nav><article><h1>Head</h1><p>One   <b>two</b>\n three &eacute;<p>Four five six seven eight</article><footer>foot words</footer>", "Head\nOne two three é\nFour five six seven eight"),
    ("<body><div class='sidebar'>side words here</div><div id=main><p>Main text that is long enough to win.</p><p>And more of it.</p></div><div class=comments><p>Reader comment that is quite long as well, longer than text.</p></div><form><p>form text</p></form><script>var x='</p>'</script></body>", "Main text that is long enough to win.\nAnd more of it."),
    ("<p>unclosed <b>bold<br><p>next < 3", "unclosed bold\nnext < 3"),
])
def test_main_text(page, text):
    assert extract.main_text(page) == text


BODY = "<h1>Title of it</h1><p>First words of the text, long enough.</p><p>Second words of the text, also long.</p>"


@pytest.mark.parametrize("page", [
    f'<body><div class="layout has-sidebar"><div id="text">{BODY}</div><div class="leftSidebar"><p>Other things to see here</p></div></div>',
    f'<body><form id="aspnetForm"><div class="siteHeader">Name</div><div>{BODY}</div><div id="pageFooter">Rights</div></form>',
    f'<body><article><div class="entry-header"><h1>Title of it</h1></div>{BODY[len("<h1>Title of it</h1>"):]}</article><form><p>Your name</p></form>',
    f'<body><div class="widget-area"><main>{BODY}</main><p>Left out</p></div><div class="commentList"><p>I like it very much, thank you all.</p></div>',
    f'<body><div class="no-sidebar">{BODY}<div class="comments-area"><p>So do I</p></div></div>',
])
def test_names_of_wrappers(page):
    assert extract.main_text(page).split("\n") == ["Title of it", "First words of the text, long enough.", "Second words of the text, also long."]


PARTS = "".join(f"<section><h2>Heading {i}</h2>{'<p>' + 'words ' * 60 + '</p>'}{'<p>' + 'again ' * 60 + '</p>'}</section>" for i in range(3))
ALL = [x for i in range(3) for x in (f"Heading {i}", ("words " * 60).strip(), ("again " * 60).strip())]
LINKS = "<div>" + "<a href='/x'>Some page</a> " * 8 + "</div>"


@pytest.mark.parametrize("page, text", [
    (f"<body>{LINKS}<article><h1>Title of it</h1>{PARTS}</article>{LINKS}</body>", ["Title of it", *ALL]),
    (f"<body>{LINKS}<main><h1>Title of it</h1><div>{PARTS}</div><p>End.</p></main>", ["Title of it", *ALL, "End."]),
    (f"<body>{LINKS}{PARTS.replace('section', 'div')}{LINKS}</body>", ALL),
    (f"<body>{LINKS}<h1>Title of it</h1>{PARTS.replace('<section>', '<div><div>').replace('</section>', '</div></div>' + LINKS)}</body>", ["Title of it", *ALL]),
    (f"<body><main><article><h1>One</h1>{PARTS}</article>{LINKS}<article><h1>Two</h1>{PARTS}</article></main>", ["One", *ALL, "Two", *ALL]),
])
def test_every_part_of_the_main_text(page, text):
    assert extract.main_text(page).split("\n") == text


LONG = "words of the text " * 12


def test_topics_of_an_article_are_no_furniture():
    kept = f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section><h2 id="related-work">Related work</h2><p class="alert">{LONG}</p><div class="section" id="comments-on-sharing"><h2 id="sharing-data">Sharing data</h2><p>{LONG}</p></div>'
    gone = f'<section id="related"><h2>Related</h2>{LINKS}</section><section class="comments"><p>{LONG}</p></section><div id="comments"><p>{LONG}</p></div><p class="ad">{LONG}</p>'
    text = ["Title of it", "Discussion", LONG.strip(), "Related work", LONG.strip(), "Sharing data", LONG.strip()]
    for frame in ("article", "main"):
        assert extract.main_text(f"<body><{frame}><h1>Title of it</h1>{kept}{gone}</{frame}>").split("\n") == text
    assert extract.main_text(f'<body><div><p>{LONG}</p><p>{LONG}</p></div><section id="discussion"><p>{LONG}</p></section>') == "\n".join([LONG.strip()] * 2)


def test_deep_and_unclosed_pages_in_one_pass():
    assert extract.main_text("<div>" * 20000 + "<form>" * 20000 + "x") == "" and extract.main_text("<form><h1>" * 20000 + "word").endswith("word")


class Plain(HTMLParser):
    """A tree of (name, children) of a well-formed page; children are nodes and texts."""

    def __init__(self, page):
        super().__init__()
        self.root = ("#", [])
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append(node := (tag, []))
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def plain_density(node, body, link=False):
    """Composite text density from its definition, counting by recursion each time; link: the node is in a link."""
    def count(x, link=False):
        if isinstance(x, str):
            k = len("".join(x.split()))
            return np.array([k, k if link else 0, 0, 0])
        inner = sum((count(c, link or x[0] == "a") for c in x[1]), np.zeros(4, int))
        return inner + [0, 0, 1, x[0] == "a"]

    c, lc, t, lt = count(node, link)
    lt -= node[0] == "a"
    if not c:
        return 0.0
    bc, blc, *_ = count(body)
    base = math.log(c / max(c - lc, 1) * lc + blc / bc * c + math.e)
    return max(0.0, c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1e-9)) / math.log(base)) if base > 1 else c / t


def test_densities_by_definition():
    rng = random.Random(13)

    def part(depth):
        if depth > 9 or rng.random() < 0.3:
            return rng.choice(["some words here ", "more of them, longer than before ", "x"])
        tag = rng.choice(["div", "section", "p", "span", "b", "a", "em", "article"] if depth < 4 else ["span", "b", "i", "em"])
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(1, 4)))
        inner = re.sub("</?(?:p|a|div|section|article)[^>]*>", "", inner) if tag in "pa" else inner
        return f"<{tag} href='/x'>{inner}</{tag}>" if tag == "a" else f"<{tag}>{inner}</{tag}>"

    for _ in range(150):
        page = "<body>" + "".join(part(1) for _ in range(4)) + "</body>"
        nodes, _pieces = extract.parse(page)
        extract.densities(nodes)
        tree = Plain(page).root
        body, order, dense = tree[1][0], [], {}

        def walk(x, link):
            order.append(x)  # noqa: B023
            dense[id(x)] = plain_density(x, body, link)  # noqa: B023
            for c in x[1]:
                if not isinstance(c, str):
                    walk(c, link or x[0] == "a")

        walk(tree, False)
        assert [n.name for n in nodes] == [x[0] for x in order]
        assert np.allclose([n.density for n in nodes[1:]], [dense[id(x)] for x in order[1:]])

        def blocks(x):  # child blocks, through elements inside a line
            return [b for c in x[1] if not isinstance(c, str) for b in ([c] if c[0] in extract.BLOCK else blocks(c))]

        sums = [sum(dense[id(b)] for b in blocks(x)) for x in order[1:]]
        assert np.allclose([n.sum for n, x in zip(nodes[1:], order[1:]) if x[0] in extract.BLOCK], [s for s, x in zip(sums, order[1:]) if x[0] in extract.BLOCK])


def test_text_deep_in_a_link_is_link_text():
    assert extract.main_text("<body><p>Start <a href=/>home page</a> and <b/>more words</p>") == "Start home page and more words"
    page = "<body><div><a href='/x'><b><i><u><s><em>deep words</em></s></u></i></b></a> own</div></body>"
    nodes, _ = extract.parse(page)
    assert sum(n.links for n in nodes) == 9 and sum(n.chars for n in nodes) == 12


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "<p>" + "word " * 50000), (2, None)], "page_id long, html string").withColumn("main_text", F.lit(1))
    got = {r["page_id"]: r["main_text"] for r in extract.extract(df).collect()}
    assert len(got[1]) == 249999 and got[2] == "" and extract.extract(df.limit(0)).count() == 0


# --- memo


def test_memo_is_bounded_in_rows_and_key_length():
    memo = Bounded(len, 3)
    assert memo["x" * 300] == 300 and not memo and [memo[w] for w in ("a", "b", "c", "d", "d")] == [1] * 5 and list(memo) == ["d"]


# --- 10


def test_top_k_brute_force(spark, monkeypatch):
    for name, value in (("SHARD", 100), ("CELL", 150), ("BLOCK", 3), ("PAGE", 16)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 8)), rng.normal(size=(200, 8)) * 0.01 + 1, np.tile(rng.normal(size=(1, 8)), (200, 1)), np.zeros((20, 8))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(920, None), (921, [float("nan")] * 8), (922, [None] * 8), (1000, [float("inf")] * 8), (1100, [0.5] * 3), (1101, [1.0] * 3), (1200, []), (300, [0.1] * 8), (300, [0.1] * 8)]
    rows += [(1300, [5e5] * 8), (1301, [-8e5] * 8)]  # products over 2^53
    v = mtree.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("dim", F.lit("x")), "vec_id", "embedding", 1024)
    got = [tuple(r) for r in mtree.top_k(v, F.col("vec_id") % 100 == 0).collect()]
    usable = [(i, np.floor(1024 * np.array(r)).astype(object)) for i, r in rows if r is not None and all(c is not None and math.isfinite(c) for c in r)]
    want = []
    for n, (i, q) in enumerate(usable):
        if i % 100 == 0:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, y, strict=True))), j) for m, (j, y) in enumerate(usable) if m != n and len(y) == len(q))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want) and len([r for r in got if r[0] == 300]) == 30
    assert mtree.top_k(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- pipeline


def test_pipeline_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    vocab = ["tree", "river", "cloud", "stone", "walk", "green", "light", "paper", "music", "sand", "wind", "glass"]
    clean = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(120)]
    item = " ".join(rng.choice(vocab) + "x" for _ in range(14))
    texts = clean + [t + " idiot" for t in clean[:40]] + [clean[3], clean[5]] + [clean[7][:100] + " " + item + " tail"] + ["123 456 !!"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int("idiot" in t)) for i, t in enumerate(texts)]
    sf = write(spark, tmp_path / "d", documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, "doc_id long, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = corpus_pipeline.run(spark, sf).collect()
    left = [(i, t) for i, t in enumerate(texts) if "idiot" not in t and any(c.isalpha() for c in t)]
    firsts: list = []
    fp = {i: slow_fingerprint(t) for i, t in left}
    root = {i: i for i, _ in left}
    for i, _ in left:
        for j, _ in left:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    firsts = [i for i, _ in left if root[i] == i]
    assert sorted(r["doc_id"] for r in got) == [i for i in firsts if "x " not in texts[i]] and all(r["exact"] for r in got)
    extra = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own")).withColumn("fp", F.lit(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp"]
        assert [tuple(r) for r in out.select("score", "fp").distinct().collect()] == [("own", 7)]
        assert stage(spark, extra.limit(0), sf).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    vocab = ["tree", "river", "cloud", "stone", "walk", "green", "light", "paper", "music", "sand", "wind", "glass"]
    clean = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(150)]
    item = " ".join(rng.choice(vocab) + "x" for _ in range(14))
    odd = [(None, clean[0] + " own", "en"), (None, None, None), (500, None, None), (501, "", "en"), (502, "12 34", None), (3, clean[3], "en"), (3, "a wholly " + clean[20][::-1], "en"), (7, clean[140] + " " + item, "en"), (503, "long " + " ".join(clean * 20), "en")]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(i, t, x, None, None) for i, t, x in odd]
    d = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("own")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
    sf = write(spark, tmp_path / "d", documents=d, labels=spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int"), benchmark=spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))
    kept = {name: stage(spark, d, sf).collect() for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(r.asDict()["fp"] == "own" and (r["row"], r["key"]) == (1, 2) for out in kept.values() for r in out)
    pairs = lambda name: Counter((r["doc_id"], r["text"]) for r in kept[name])
    whole = Counter((i, t) for i, t, *_ in rows)
    assert pairs("toxicity") == whole
    assert whole - pairs("language ID") >= Counter({(None, None): 1, (500, None): 1, (501, ""): 1, (502, "12 34"): 1}) and pairs("language ID")[(None, odd[0][1])] == 1
    near = pairs("SimHash near-dedup")
    fp = {t: slow_fingerprint(t) for _, t in whole}
    assert near[(3, clean[3])] == 1 and near[(3, odd[6][1])] == 1 and sum(n for (_, t), n in near.items() if fp[t] == 0) == 1 and near[(500, None)] + near[(501, "")] == 1
    assert pairs("benchmark decontamination") == whole - Counter({(7, odd[7][1]): 1})
    done = corpus_pipeline.run(spark, sf).collect()
    assert all(r["exact"] for r in done) and Counter(r["doc_id"] for r in done)[3] == 2


def test_stored_folders_can_be_dropped(spark):
    from loomscan.llm import common

    path = common.fresh_path(spark, "probe")
    spark.range(3).write.parquet(path)
    common.drop_stored(spark)
    assert not common._made and not os.path.exists(path.removeprefix("file:"))
