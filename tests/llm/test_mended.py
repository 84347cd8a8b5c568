"""Cases that once lost text, rows or memory: dirty markup, repeated ids, long texts in one batch, many languages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscan.llm import decontam, extract, langid, mtree, simhash, toxicity
from loomscan.llm.common import labelled

LONG = "Plain words that go on for a while so that the paragraph is dense enough to be text. " * 3


def article(*parts):
    return f"<html><body><nav><a href='/'>menu</a></nav><article><h1>Title</h1><p>{LONG}</p>{''.join(parts)}<p>Last one.</p></article></body></html>"


@pytest.mark.parametrize(("part", "kept"), [
    ("İ" * 40 + "<script>var x = 1;</script><p>After the script.</p>", "After the script."),
    ("<p title=it's>First.</p><p>Second's text.</p>", "First.\nSecond's text."),
    ("<p data-x=\"a > b\" title='c > d'>Quoted.</p>", "Quoted."),
    ("<p>An x <math><mi>n</mi></math> y.</p>", "An x n y."),
    ("<p>Drawn <svg><text>label</text></svg> here.</p>", "Drawn label here."),
    ("<p>Seen <object>instead</object>.</p>", "Seen instead."),
    (f'<div class="related-work"><p>{LONG}Work of others.</p></div>', "Work of others."),
    (f'<div id="sharing-data"><p>{LONG}Data is shared.</p></div>', "Data is shared."),
    ("<aside><p>A remark in the margin of the text.</p></aside>", "A remark in the margin of the text."),
    ("<SCRIPT>no()</SCRIPT ><p>Upper case.</p>", "Upper case."),
    ("<p title=\"never closed>Open.</p><p>Next.</p>", ""),
])
def test_article_text_is_kept(part, kept):
    text = extract.main_text(article(part))
    assert kept in text and text.startswith("Title\nPlain words") and text.endswith("Last one.") and "menu" not in text


@pytest.mark.parametrize("part", [
    '<div class="related-posts"><a href="/1">one more</a></div>', '<div class="comments"><p>gone gone</p></div>', '<aside><a href="/x">gone elsewhere</a></aside>',
    '<div class="ad-slot">gone</div>', "<iframe>gone</iframe>", "<textarea>gone</textarea>", "<template><p>gone</p></template>", '<div class="share-buttons">gone</div>', '<ul class="social-links"><li>gone</ul>',
])
def test_furniture_in_an_article_goes(part):
    text = extract.main_text(article(part))
    assert "gone" not in text and "one more" not in text and text.endswith("Last one.")


def test_very_long_page_of_dirty_markup():
    page = "<article><p>" + LONG + "</p>" + "<p a='" * 20_000 + "<b c=\"" * 20_000 + "<p>x</p>" * 20_000 + "</article>"
    assert extract.main_text(page).startswith("Plain words")
    assert extract.main_text("<" * 200_000) == "<" * 200_000 and extract.main_text("<script>" * 50_000) == ""


def test_a_sample_has_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c"), (None, "n")] + [(9, f"copy {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 0), (4, 1), (None, 1), (3, None)], "doc_id long, y int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled(docs, labels, "y", {0: 5, 1: 5}).collect()}
    again = {r["doc_id"]: (r["text"], r["label"]) for r in labelled(docs.repartition(7), labels, "y", {0: 5, 1: 5}).collect()}
    assert set(got) == {1, 2, 9} and got[1][1] == 1 and got[1][0] in "ab" and got[2] == (None, 0) and got == again
    assert labelled(docs, labels, "y", {0: 1, 1: 1}).count() == 2


def test_toxicity_learns_from_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words {i}") for i in range(40)] + [(1, f"kind copy {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r["text"]: r["score"] for r in toxicity.score(spark.createDataFrame([(0, "vile thing"), (1, "kind thing")], "doc_id long, text string"), model).collect()}
    assert scores["vile thing"] > 0.7 > 0.3 > scores["kind thing"]


def test_shards_close_at_a_row_not_at_a_batch(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 50)
    docs = spark.createDataFrame([(i, f"alpha beta gamma w{i} " * 20) for i in range(30)], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(docs)
    shards = decontam.read_index(spark, index, "doc").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(shards) == 30 and max(r["n"] for r in shards) == 80
    items = spark.createDataFrame([(1, "gamma w7 alpha"), (2, "w3 w3")], "item_id long, text string")
    got = decontam.search(index, *decontam.item_terms(items), window=3).select("doc_id", "item", "start", "stop").collect()
    assert sorted(map(tuple, got)) == [(7, "1", 4 * i + 2, 4 * i + 5) for i in range(19)]


def test_memo_of_log_probabilities_is_bounded_with_many_languages():
    keys = langid.grams(langid.symbols("some words of a language"))
    k, n = np.unique(keys, return_counts=True)
    model = langid.kneser_ney(k, n)
    many = langid.Scorer([str(i) for i in range(400)], [model] * 400)
    assert many.logp.nbytes <= langid.MEMO and many.piece * 400 * 4 <= 4 * langid.PIECE
    few = langid.Scorer(["a"], [model])
    texts = ["some words", "of a language " * 3000, None, "zzz"]
    a, size = many.sums(texts)
    b, _ = few.sums(texts)
    assert np.allclose(a[:, 7], b[:, 0]) and size[2] == 0


def test_copies_of_one_fingerprint_get_their_class_from_every_part(spark):
    docs = spark.createDataFrame([(i, "the same four words again") for i in range(200)] + [(500, "other text with five words"), (None, "the same four words again")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 202 and {r["component_id"] for r in got if r["doc_id"] != 500} == {0}


def test_models_are_read_part_by_part_from_a_store(tmp_path, monkeypatch):
    """A store that is no local file system: only the parts that texts ask for are held, oldest go first."""
    keys = langid.grams(langid.symbols("words of a language with a few letters " * 20))
    k, n = np.unique(keys, return_counts=True)
    (levels,) = [langid.kneser_ney(k, n)]
    files = []
    for level in levels:
        for kind, (a, b) in enumerate((("hash", "logp"), ("context", "back"))):
            half = max(1, len(level[a]) // 2)
            for bucket, cut in enumerate((slice(0, half), slice(half, None))):
                h, v = level[a][cut], level[b][cut]
                if len(h):
                    name = f"{level['order']}-{kind}-{bucket}"
                    (tmp_path / name).write_bytes(h.tobytes() + v.astype(np.float32).tobytes())
                    files.append((0, level["order"], kind, bucket, name, len(h), int(h.view(np.int64)[0])))
    local = langid.open_models(str(tmp_path), files, 1)
    remote = langid.fs.SubTreeFileSystem("/", langid.fs.LocalFileSystem())
    monkeypatch.setattr(langid, "store_of", lambda _: (remote, str(tmp_path)))
    far = langid.open_models("x://store", files, 1)
    assert isinstance(far[0][0]["hash"][0], langid.Part)
    texts = ["words of a language", "other letters", "zzz"]
    a, b = (langid.Scorer(["a"], m).sums(texts)[0] for m in (local, far))
    assert np.array_equal(a, b)
    held = far[0][0]["hash"][0].held
    held.room, held.used = 1, 0
    held.parts.clear()
    for f in files:
        held.read(str(tmp_path / f[4]))
    assert list(held.parts) == [str(tmp_path / files[-1][4])]


# --- 9: which nodes are marked, by the definition and without shortcuts


def test_marked_nodes_by_the_definition():
    import random

    rng = random.Random(9)
    tags = ["div", "section", "p", "ul", "li", "b", "a", "h2", "article", "main", "blockquote"]

    def markup(depth):
        name = rng.choice(tags if depth else ["p", "b", "h2"])
        inner = "".join(markup(depth - 1) if depth and rng.random() < 0.6 else "word " * rng.randrange(0, 30) for _ in range(rng.randrange(1, 4)))
        return f"<{name}{' href=x' if name == 'a' else ''}>{inner}</{name}>"

    def under(node, live):
        """The node and all live nodes in it, in page order."""
        out = []
        for x in live:
            up = x
            while up is not None and up is not node:
                up = up.parent
            if up is node:
                out.append(x)
        return out

    checked = 0
    for _ in range(300):
        nodes, pieces = extract.parse(f"<body>{''.join(markup(4) for _ in range(rng.randrange(1, 4)))}</body>")
        extract.densities(nodes)
        live = [x for x in nodes if x.chars and not x.furniture]
        if not live:
            continue
        best = max(live, key=lambda x: x.sum)
        if not best.sum:
            continue
        path, up = [best.density], best
        while up.parent and up.name != "body":
            up = up.parent
            path.append(up.density)
        threshold = min(path)
        chosen, inside = [], set()
        for x in live:  # page order: what is marked further up stands for all in it
            if x in inside or x.density < threshold or x.name not in extract.BLOCK and x.parent:
                continue
            most = max(under(x, live), key=lambda y: y.sum)  # the first of equals
            most = most.frame or most
            chosen.append(most)
            if most is x or x in under(most, live):
                inside.update(under(x, live))
        marked = set(chosen)
        holding = {y for x in marked for y in climb(x)}
        for x in reversed([x for x in live if x.name in extract.HEADINGS]):  # a heading before a marked block is marked
            after = [y for y in live if y.parent is x.parent and y.name in extract.BLOCK and live.index(y) > live.index(x)]
            if after and after[0] in holding:
                marked.add(x)
                holding |= set(climb(x))
        want = {x for x in marked if not any(y in marked for y in climb(x.parent))}
        got = extract.marked(live, best)
        assert set(got) == want and [nodes.index(x) for x in got] == sorted(nodes.index(x) for x in got)
        checked += 1
    assert checked > 250


def climb(node):
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def test_vectors_without_an_id_are_candidates_and_come_last(spark):
    rows = [(100, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [float("nan"), 0.0])]
    vectors = mtree.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 4)
    got = mtree.top_k(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, None, 32), (100, 2, 3, 16), (100, 3, None, 16)]


def test_contaminated_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"term{i}" for i in range(12))
    rows = [(None, f"a {item} b"), (None, f"a {item} b"), (None, "clean words"), (None, "clean words"), (1, f"{item}"), (2, "clean words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in left)) == [(0, ""), (0, "clean words"), (0, "clean words"), (2, "clean words")]


def test_captures_without_a_page_id_are_all_responses_among_themselves(spark):
    from loomscan.llm import warc

    pages = spark.createDataFrame([(None, "http://a/1", "same"), (None, "http://a/2", "same"), (None, "http://b/", None), (4, "http://c/", "other"), (5, "http://d/", "other"), (None, "http://e/", "other")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()), key=str)
    assert got == sorted([(0, "response", None)] * 3 + [(4, "response", None), (5, "revisit", 4), (0, "revisit", 4)], key=str)


def test_every_clause_is_found_and_tells_its_licence(spark):
    from loomscan.llm import licenses

    clauses = [t for t in licenses.templates() if not t["base"]]
    texts = ["some words before " + " ".join(t["words"]) + " and some after" for t in clauses] + ["plain words about rights and copies of the works that people write"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(clauses) > 50 and all(t["label"] in got[i]["labels"] for i, t in enumerate(clauses))
    assert all(got[i]["labels"] == [] for i in range(len(clauses), len(texts)))


def test_neither_queries_nor_trees_pass_through_the_driver(spark, monkeypatch):
    plans, own = [], mtree.stored
    monkeypatch.setattr(mtree, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    monkeypatch.setattr(mtree, "CELL", 20)
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (300, 4))
    found = mtree.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>"), F.col("vec_id") % 10 == 0, 3)
    searches = [p for name, p in plans if name == "searched"]
    assert len(searches) == 2 and all("SortMergeJoin" in p for p in searches)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 10):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:3]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
