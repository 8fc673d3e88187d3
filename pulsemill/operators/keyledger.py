"""Uniqueness of keys over batches that land one after the other.

The ledger holds the keys of every landed batch, dealt by their hash into buckets (folders
``batch=<name>/bucket=<n>``). A new batch is compared with the buckets that its own keys fall
into and with nothing else: not with the registry, nor with the ledger's other buckets. A batch that
is landed again under its name replaces its keys and is not held against itself, so a repeated
job finds what the first one found. ``compact`` joins the batches into one when they are many.

A null key is a violation of its own and is not written. Keys are compared as texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.operators.constraints import require_valid
from pulsemill.session import materialize

#: buckets of a ledger: a batch of few keys touches few of them
BUCKETS = 256
#: the name of the joined batches
ALL = "all"


def _keyed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    text = F.col(key).cast("string")
    return rows.select(text.alias("key"), F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int").alias("bucket"))


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    """(key, origin, bucket, batch) of the ledger, or None before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return spark.read.schema("key string, origin string, batch string, bucket int").parquet(ledger)


def violations(rows: DataFrame, ledger: str, batch: str, key: str = "record_id", buckets: int = BUCKETS) -> DataFrame:
    """(record_id, problem, origin) of the rows' keys: null, repeated in the batch, or landed with another one (``origin``)."""
    spark = rows.sparkSession
    counted = _keyed(rows, key, buckets).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted)
    none = F.lit(None).cast("string")
    found = counted.where(F.col("key").isNull() | (F.col("n") > 1)).select(
        F.col("key").alias("record_id"), F.when(F.col("key").isNull(), "no key").otherwise("repeated in the batch").alias("problem"), none.alias("origin")
    )
    landed = _read(spark, ledger)
    if landed is None:
        return found
    touched = [r[0] for r in counted.where("key IS NOT NULL").select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    old = landed.where(F.col("bucket").isin(touched) & (F.col("origin") != batch))
    again = counted.where("key IS NOT NULL").join(old.select("key", "bucket", "origin"), ["bucket", "key"]).select(
        F.col("key").alias("record_id"), F.lit("landed before").alias("problem"), "origin"
    )
    return found.unionByName(again)


def land(rows: DataFrame, ledger: str, batch: str, key: str = "record_id", buckets: int = BUCKETS) -> None:
    """Take the rows' keys into the ledger as ``batch``; fails on a violation and leaves the ledger as it was."""
    require_valid(violations(rows, ledger, batch, key, buckets).select("record_id", "problem"), f"batch {batch}")
    record(rows, ledger, batch, key, buckets)


def record(rows: DataFrame, ledger: str, batch: str, key: str = "record_id", buckets: int = BUCKETS) -> None:
    """Write the rows' keys as ``batch`` without looking at others."""
    if not batch or batch == ALL:
        raise ValueError("a batch needs a name of its own")
    keys = _keyed(rows, key, buckets).where("key IS NOT NULL").distinct()
    _write(keys.withColumn("origin", F.lit(batch)), f"{ledger.rstrip('/')}/batch={quote(batch, safe='')}")


def _write(keys: DataFrame, path: str) -> None:
    keys.select("key", "origin", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def compact(spark: SparkSession, ledger: str, batches: Sequence[str]) -> None:
    """Join ``batches`` (and what was joined before) into one folder; their own folders go last,
    and a key that stands in both for a while counts once."""
    landed = _read(spark, ledger)
    if landed is None or not batches:
        return
    names = [ALL, *(quote(b, safe="") for b in batches)]
    joined = materialize(landed.where(F.col("origin").isin(list(batches)) | (F.col("batch") == ALL)).select("key", "origin", "bucket").distinct())
    _write(joined, f"{ledger.rstrip('/')}/batch={ALL}")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in names[1:]:
        path = fs_path(f"{ledger.rstrip('/')}/batch={name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
