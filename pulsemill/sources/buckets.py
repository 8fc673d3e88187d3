"""Tables in buckets of one key, so that joins and sums on it move no rows.

``save`` deals rows by the key's hash into a fixed number of buckets and sorts them there, once;
two tables with the same key and number of buckets are then joined bucket by bucket. A key
that holds a large share of the rows makes one large bucket, which no later plan can split:
``save`` counts the rows per key first, writes those of keys with over ``HOT`` of all rows to a
table of their own, which is read with the rest, and joins meet them by ``join``: the few rows
that the other table has for them are broadcast, the rest goes bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.session import shared_folder

#: buckets of a table; all tables that are to be joined need the same number
BUCKETS = 64
#: share of all rows above which a key's rows are kept apart
HOT = 0.05


def save(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, folder: str | None = None) -> None:
    """Write ``df`` as the tables ``name`` (in buckets) and ``name_hot`` (keys with over ``HOT`` of all rows, and null keys)."""
    spark = df.sparkSession
    root = folder or f"{shared_folder(spark).rstrip('/')}/tables"
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    hot = [r["_key"] for r in counts.where((F.col("_n") > HOT * total) & F.col("_key").isNotNull()).collect()]  # 1 / HOT keys at most
    is_hot = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    cold = df.where(~is_hot).repartition(buckets, key)
    cold.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}").saveAsTable(name)
    df.where(is_hot).write.mode("overwrite").option("path", f"{root}/{name}_hot").saveAsTable(f"{name}_hot")


def read(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a saved table."""
    return spark.table(name).unionByName(spark.table(f"{name}_hot"))


def join(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """Join two saved tables on their key, of which ``right`` has one row per key; ``how``: inner or left.

    Rows in buckets are joined where they lie. Those of hot keys (null ones find nothing) meet
    the at most ``2 / HOT`` rows of ``right`` that have these keys by a broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join in buckets: {how}")
    hot_left, hot_right = spark.table(f"{left}_hot"), spark.table(f"{right}_hot").where(F.col(key).isNotNull())
    keys = [r[0] for t in (hot_left, hot_right) for r in t.where(F.col(key).isNotNull()).select(key).distinct().collect()]
    cold = spark.table(left)
    cold_left, apart = (cold, hot_left) if not keys else (cold.where(~F.col(key).isin(keys)), hot_left.unionByName(cold.where(F.col(key).isin(keys))))
    out = cold_left.join(spark.table(right), key, how)
    found = spark.table(right).where(F.col(key).isin(keys)).unionByName(hot_right) if keys else hot_right
    return out.unionByName(apart.join(F.broadcast(found), key, how))
