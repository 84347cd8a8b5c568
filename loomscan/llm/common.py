"""Helpers shared by the text-corpus operators: shared scratch tables and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to Python code at once: bounds a worker's memory whatever Spark's Arrow batch size is.
ROWS = 256


#: Folders under the shared one that this session made.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where it is unset, as in tests, a local one; a
    cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomscan-"))
            path = sc.getCheckpointDir()
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_stored(spark: SparkSession) -> None:
    """Remove the intermediate tables, indexes and archives of this session; results that are still lazy need them."""
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores is dealt over all of them; others are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def labelled(docs: DataFrame, labels: DataFrame, column: str, caps: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of a bounded sample: of each label the `caps[label]` ids of smallest hash, one row an id.

    An id labelled twice has its largest label; of rows that repeat an id that of the smallest text hash counts. Only the
    sample's ids are broadcast.
    """
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in caps.items()]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


def field(name: str, ddl: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(ddl), True)


def add_columns(df: DataFrame, source: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], list]], rows: int = ROWS, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or `keep`) and new ones computed from column `source` in bounded Arrow batches.

    make() runs once a task and returns fn(array) -> one list or Arrow array per new field. A column of df
    that has the name of a new field is replaced.
    """
    new = {n.lower() for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [field(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                made = fn(part.column(n))
                cols = [part.column(j).cast(arrow.field(j).type) for j in range(n)]
                cols += [m if isinstance(m, pa.Array) else pa.array(m, arrow.field(n + j).type) for j, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("__source")).mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


#: A-Z to a-z, and all that the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ excludes to a space; the pattern keeps
#: digits, lower-case ASCII letters and every byte of a non-ASCII character.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


class Bounded(dict):
    """A memo of keys up to a length that forgets everything when it is full: constant memory."""

    def __init__(self, make: Callable, limit: int = 500_000, longest: int = 256):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
