"""Corpus cleaning as five stages; each reads what the one before it kept and returns documents with their columns.

Extra columns of documents pass through all stages but the last; the stages' own columns have names of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import bpe, decontam, langid, simhash, toxicity
from loomscan.llm.common import fresh_path, table
from loomscan.llm.queries import remainder, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return toxicity.score(docs, model, name="__toxicity").where("__toxicity < 0.7").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay but for those that no model explains, and those without a letter."""
    model = langid.fit(docs.where(remainder(5) != 0))
    return langid.predict(docs, model, prefix="__").where("not __rejected and __lang_pred <> 'und'").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that of the smallest id (rows without one come last), then of the smallest hash of
    all columns; of rows that are equal in all columns, one."""
    key = F.xxhash64(*docs.columns)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key"))
    found = simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = found.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.key").alias("__key")).distinct()
    own = docs.withColumn("__own", key)
    kept = own.join(firsts, (F.col("__own") == F.col("__key")) & own["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have any benchmark window go; rows are told apart by id and text, not by id alone."""
    own = docs.withColumn("__own", F.xxhash64("doc_id", "text"))
    _, matches = decontam.decontaminate(own, table(spark, sf_dir, "benchmark"), doc_id="__own")
    return own.join(matches.where("kind = 'exact'").select(F.col("doc_id").alias("__own")).distinct(), "__own", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether decoding them gives its text again."""
    both = bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("language ID", keep_known_languages), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("BPE encoding and decoding", tokenize)]
#: The classifier, the fingerprints and the encoder are no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
