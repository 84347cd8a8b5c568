"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import bpe, chat, decontam, extract, langid, licenses, mtree, quality, ranked, simhash, toxicity, warc, whiten
from loomscan.llm.common import spread, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def remainder(n: int, column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path()).drop("text")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, matches = decontam.decontaminate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    report = decontam.document_report(index, matches)
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are taken as chosen and rejected of pair n."""
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text")
    return chat.preference_pairs(turns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = toxicity.score(spread(docs), model).drop("text")
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.where(remainder(5) != 0))
    found = langid.predict(docs.drop("lang"), model).drop("text")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).drop("html")
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return mtree.top_k(vectors, F.col("vec_id") % 100 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = quality.score(spread(docs), weights).drop("text")
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked.rank(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of_text = (op1_bpe, op2_decontamination, op3_preferences, op4_toxicity, op5_warc, op6_simhash, op7_licenses, op8_langid, op9_extract)
    return {f.__name__: f for f in (*of_text, op10_topk, op11_whitening, op12_quality, op13_ranked)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_rows() -> str:
    """The templates as SQL rows: texts only, the matching is the query's own."""
    return ", ".join(f"({i}, '{t['label']}', {t['base']}, [{', '.join(repr(w) for w in t['words'])}], {t['at']}, {t['key']})" for i, t in enumerate(licenses.templates()))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, s.n, w, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, sizes s WHERE len(w) >= s.n),
hit AS (SELECT p.r, p.i, p.n, win.item_id FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM place) p JOIN win USING (n, k)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hit) GROUP BY 1),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS t FROM hit GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
        "op3_preferences": """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS x FROM t),
p AS (SELECT pair_id, i, max(CASE WHEN side = 0 THEN x END) AS c, max(CASE WHEN side = 1 THEN x END) AS j FROM r GROUP BY 1, 2),
n AS (SELECT pair_id, coalesce(min(CASE WHEN c IS DISTINCT FROM j THEN i END) - 1, max(i)) AS n FROM p GROUP BY 1)
SELECT pair_id::bigint AS pair_id, any_value(n)::bigint AS prompt_turns,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i <= n AND side = 0), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > n AND side = 0), '') AS chosen,
  coalesce(string_agg((CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END) || length(x), ',' ORDER BY i) FILTER (WHERE i > n AND side = 0), '') AS chosen_mask,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > n AND side = 1), '') AS rejected,
  coalesce(string_agg((CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END) || length(x), ',' ORDER BY i) FILTER (WHERE i > n AND side = 1), '') AS rejected_mask
FROM r JOIN n USING (pair_id) GROUP BY pair_id""",
        "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::bigint AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', substr(s, (5 * i) // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef0', substr(s || '0', (5 * i) // 4 + 2, 1)) - 1) // [8, 4, 2, 1][1 + (5 * i) % 4] % 32)::int, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to FROM d""",
        "op7_licenses": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({WORDS}, []) AS w FROM documents),
t(id, label, base, words, key_at, key_n) AS (VALUES {license_rows()}),
place AS (SELECT r, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (SELECT p.r, p.w, t.*, p.i - 1 - key_at AS s FROM place p JOIN t ON p.word = t.words[key_at + 1] WHERE p.w[p.i : p.i + key_n - 1] = t.words[key_at + 1 : key_at + key_n]),
hit AS (SELECT r, label, base, s, len(list_filter(range(1, len(words) + 1), lambda j: s + j + 3 >= 1 AND list_contains(w[greatest(s + j - 3, 1) : s + j + 3], words[j])))::double / len(words) AS share FROM found),
kept AS (SELECT * FROM hit WHERE share >= 0.7),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN a USING (r)""",
        "op10_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::int AS rank FROM s) WHERE rank <= 10""",
        "op13_ranked": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark),
q AS (SELECT item_id, hash(w) AS c, t, count(*) AS times FROM (SELECT item_id, w, unnest(w) AS t FROM b) GROUP BY 1, 2, 3),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
total AS (SELECT count(*)::bigint AS docs, sum(len(w))::bigint AS words FROM d WHERE len(w) > 0),
df AS (SELECT t, floor(1000 * ln((2.0 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint AS weight FROM p, total GROUP BY t),
s AS (SELECT item_id, c, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * docs) // words))))::bigint AS score
  FROM q JOIN p USING (t) JOIN df USING (t) JOIN d USING (r), total GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, c ORDER BY score DESC, doc_id)::int AS rank
  FROM s JOIN d USING (r) WHERE score > 0) WHERE rank <= 20""",
    }
