"""Building blocks that stay bounded when one key holds much of the data.

* :func:`join_dimension` - broadcast behind a size check, else a hot/cold split.
* :func:`sorted_runs` / :func:`dense_index` - global order per key by range shuffle,
  so a single key spreads over many tasks.
* :func:`hash_rank` - rank by a uniform hash, counted per hash prefix.
* :func:`exact_median` - exact median from running counts over sorted runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsemill.session import materialize

BROADCAST_ROWS = 1_000_000
HOT_SHARE = 0.001
EARLIER = (W.unboundedPreceding, -1)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``max_rows`` + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows: at most 1 / share of them."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows") * F.lit(share)).scalar()
    return counts.where(F.col("n_rows") > total).select(key)


def hot_split_join(
    facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE
) -> DataFrame:
    """Join on a key that is unique in ``dim`` but may be skewed in ``facts``.

    Rows of hot keys meet their (at most 1 / share) dimension rows by broadcast
    and never shuffle; the remaining keys are each too small to skew a shuffle.
    """
    hot = F.broadcast(hot_keys(facts, key, share))
    hot_dim = F.broadcast(dim.join(hot, key, "left_semi"))
    hot_part = facts.join(hot, key, "left_semi").join(hot_dim, key, how)
    cold_part = facts.join(hot, key, "left_anti").join(dim, key, how)
    return hot_part.unionByName(cold_part)


def join_dimension(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``facts`` with a narrow dimension that is unique on ``key``."""
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), key, how)
    return hot_split_join(facts, dim, key, how)


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort by (keys, order) into consecutive runs; adds ``run`` and ``pos``.

    ``order`` must end in a tie-breaker. A run is one range partition: a hot key
    covers many runs, and both columns grow along the global order.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(
        ordered.withColumns(
            {"run": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}
        )
    )


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "idx",
    span_of: str | None = None,
) -> DataFrame:
    """Zero-based position of each row within its key, in order.

    ``span_of`` names a column whose least and greatest value per key are added
    as ``span_min`` and ``span_max``; they come from the same per-run table.
    """
    runs = sorted_runs(df, keys, order)
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("run").rowsBetween(*EARLIER)
    bounds = [F.min, F.max] if span_of else []
    names = ["span_min", "span_max"]
    shifts = (
        runs.groupBy(*keys, "run")
        .agg(
            F.min("pos").alias("first"),
            F.count(F.lit(1)).alias("n_rows"),
            *[f(span_of).alias(n) for f, n in zip(bounds, names)],
        )
        .select(
            *keys,
            "run",
            (F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            *[f(n).over(whole).alias(n) for f, n in zip(bounds, names)],
        )
    )
    return (
        runs.join(shifts, [*keys, "run"])
        .withColumn(name, F.col("pos") + F.col("shift"))
        .drop("run", "pos", "shift")
    )


def seeded_hash(seed: Column | int, key: Column) -> Column:
    """The same text hash in every engine, so that orders can be reproduced."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), key))


def hash_rank(
    df: DataFrame, by: Sequence[str], seed: Column | int, key: str, name: str = "rank"
) -> DataFrame:
    """Rank (from 1) of each row's seeded hash within ``by``; ``key`` is unique there.

    Hashes are uniform, so three hex digits cut any group into 4096 even buckets:
    the rank is the count of earlier buckets plus the rank inside the own bucket.
    """
    hashed = df.withColumn("hash", seeded_hash(seed, F.col(key))).withColumn(
        "bucket", F.substring("hash", 1, 3)
    )
    group = [*by, "bucket"]
    earlier = W.partitionBy(*by).orderBy("bucket").rowsBetween(*EARLIER)
    offsets = (
        hashed.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(*group, F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy(*group).orderBy("hash", key)
    return (
        hashed.withColumn("inside", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn(name, F.col("offset") + F.col("inside"))
        .drop("hash", "bucket", "inside", "offset")
    )


def exact_median(df: DataFrame, value: str, by: str, name: str = "median") -> DataFrame:
    """Exact median per ``by``, with no unbounded group gathered in one task.

    Equal values are counted first and range-sorted into runs. Running counts over
    (group, run) find the run that holds each middle rank, and only the values of
    that run are looked at, whatever the distribution of the values.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(by, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    runs = sorted_runs(counted, [by], ["v"])
    whole = W.partitionBy(by)
    earlier = whole.orderBy("run").rowsBetween(*EARLIER)
    rank = F.explode(
        F.array(F.floor((F.col("n_all") + 1) / 2), F.floor((F.col("n_all") + 2) / 2))
    ).alias("rank")
    wanted = (
        runs.groupBy(by, "run").agg(F.sum("n").alias("n_run"))
        .select(
            by, "run", "n_run",
            F.coalesce(F.sum("n_run").over(earlier), F.lit(0)).alias("before"),
            F.sum("n_run").over(whole).alias("n_all"),
        )
        .select(by, "run", "n_run", "before", rank)
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n_run")))
        .groupBy(by, "run", (F.col("rank") - F.col("before")).alias("rank"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    inside = W.partitionBy(by, "run", "rank").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return (
        runs.select(by, "run", "v", "n").join(wanted, [by, "run"])
        .withColumn("upto", F.sum("n").over(inside))
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .groupBy(by)
        .agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias(name))
    )
