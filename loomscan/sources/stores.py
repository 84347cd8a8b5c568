"""State kept as JSON files: read with a fallback, replaced as a whole, or appended to; folders for intermediate tables;
rows checked before they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Scratch folders that this session made.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or where it is unset, as in tests,
    a local one; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = sc.getCheckpointDir()
        if not root:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomscan-"))
            root = sc.getCheckpointDir()
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session; results that are still lazy need them."""
    while _made:
        store, p = hadoop(spark, _made.pop())
        store.delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The file that names the version which holds, and the one that the next rename puts in its place.
POINTER = "current.txt"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that a store's pointer names; None where nothing was ever written whole."""
    store, p = hadoop(spark, f"{path}/{POINTER}")
    if not store.exists(p):
        return None
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()['value']}"


def read_state(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """Rows of a state table; a missing one gives the fallback (or no rows), lines that are no JSON are left out. A folder
    without a pointer, as an audit log is, is read as a whole."""
    store, p = hadoop(spark, path)
    held = current_version(spark, path)
    if held is None and not store.exists(p):
        return spark.createDataFrame([], schema) if fallback is None else fallback
    lines = spark.read.text(held or path, recursiveFileLookup=True)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*")


def write_state(df: DataFrame, path: str) -> None:
    """Replace a state table: a version is written in a folder of its own, and then the pointer is renamed over the old
    one. A crash at any step leaves the old version or the new, never neither; a version that lost is removed later."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(f"{path}/{version}")
    point_to(spark, path, version)
    store, p = hadoop(spark, path)
    for status in store.listStatus(p):  # one folder a version
        name = status.getPath().getName()
        if name.startswith("v-") and name != version:
            store.delete(status.getPath(), True)


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the one that is read, by one rename that overwrites."""
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf) if fresh.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    store = fresh.getFileSystem(conf)
    out = store.create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), overwrite)


def checked(rows: DataFrame, constraints: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with `reasons`): a row is good if no constraint (reason, condition) fails; a condition that is null
    fails. One pass: both sides filter the same computed column."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in constraints]))
    told = rows.withColumn("reasons", reasons)
    return told.where(F.size("reasons") == 0).drop("reasons"), told.where(F.size("reasons") > 0)


def append_audit(df: DataFrame, path: str) -> None:
    """Add rows to an audit log; what is there is never changed."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)
