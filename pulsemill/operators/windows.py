"""Cutting sample series into windows, and joining windows with each other and with events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.operators.scale import EARLIER, sorted_runs


def tumbling_windows(
    samples: DataFrame,
    size: int,
    keys: Sequence[str] = ("subject_id",),
    value: str = "value",
    idx: str = "idx",
) -> DataFrame:
    """Complete windows of ``size`` consecutive samples: (keys, window_idx, x).

    The position ``idx`` decides the window, so a group never exceeds ``size``
    rows however long its series is.
    """
    return (
        samples.groupBy(*keys, F.floor(F.col(idx) / size).alias("window_idx"))
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.sort_array(F.collect_list(F.struct(idx, value))).alias("pairs"),
        )
        .where(F.col("n_samples") == size)
        .select(*keys, "window_idx", F.transform("pairs", lambda p: p[value]).alias("x"))
    )


def window_keys(
    samples: DataFrame, size: int, keys: Sequence[str] = ("subject_id",), idx: str = "idx"
) -> DataFrame:
    """(keys, window_idx) of the complete windows, without touching the sample values."""
    return (
        samples.groupBy(*keys, F.floor(F.col(idx) / size).alias("window_idx"))
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .where(F.col("n_samples") == size)
        .drop("n_samples")
    )


def time_windows(
    samples: DataFrame,
    seconds: float,
    fs: float,
    keys: Sequence[str] = ("subject_id",),
    value: str = "value",
    t: str = "t",
) -> DataFrame:
    """Windows cut by time instead of position; kept where exactly all samples arrived.

    Many samples can share one time bucket (a stuck clock), so buckets are counted
    first and only samples of complete windows are gathered.
    """
    size = int(seconds * fs)
    group = [*keys, "window_idx"]
    placed = samples.withColumn("window_idx", F.floor(F.col(t) / seconds))
    complete = (
        placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n_samples"))
        .where(F.col("n_samples") == size)
    )
    return (
        placed.join(complete, group, "left_semi")
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(t, value))).alias("pairs"))
        .select(*group, F.transform("pairs", lambda p: p[value]).alias("x"))
    )


def window_start(window_idx: Column, seconds: float) -> Column:
    return (window_idx * F.lit(float(seconds))).cast("double")


def window_id(subject: Column, window_idx: Column) -> Column:
    return F.format_string("%s_%04d", subject, window_idx)


def pair_windows(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes=("_a", "_b")) -> DataFrame:
    """Windows both signals have; complete windows are a prefix, so this is min(n_a, n_b)."""
    left = a.select(*keys, "window_idx", F.col("x").alias(f"x{suffixes[0]}"))
    right = b.select(*keys, "window_idx", F.col("x").alias(f"x{suffixes[1]}"))
    return left.join(right, [*keys, "window_idx"])


def usable(windows: DataFrame, size: int, column: str = "x") -> DataFrame:
    """Drop windows that are short or hold a null or NaN sample."""
    return windows.where(arrays.complete(F.col(column), size))


def label_as_of(
    windows: DataFrame,
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    log_time: str,
    label: str,
    default: str = "unknown",
) -> DataFrame:
    """Add the ``label`` of the last log entry with ``log_time`` <= ``at``, per key.

    Both tables are sorted together into range runs. Inside a run the last label
    is carried along; what a run starts with comes from the last label of the
    key's earlier runs, a table with one row per (key, run). A key that holds
    much of the data is thus spread over many runs, also if it all happens at one
    instant: a hash of the row comes last in the order. Entries at equal times rank
    before the window, the greatest label last. Entries without a time label nothing.
    """
    windows = windows.drop(label)
    both = log.where(F.col(log_time).cast("double").isNotNull()).select(
        *keys,
        F.col(log_time).cast("double").alias("at_time"),
        F.lit(0).alias("is_window"),
        F.col(label).alias("seen"),
        F.lit(None).cast(windows.select(F.struct("*").alias("row")).schema["row"].dataType).alias(
            "row"
        ),
    ).unionByName(
        windows.select(
            *keys,
            F.col(at).cast("double").alias("at_time"),
            F.lit(1).alias("is_window"),
            F.lit(None).cast("string").alias("seen"),
            F.struct("*").alias("row"),
        )
    )
    # rows that tie here are of one kind, and their order does not matter
    both = both.withColumn("tie", F.xxhash64(F.to_json("row"), F.monotonically_increasing_id()))
    runs = sorted_runs(both, keys, ["at_time", "is_window", "seen", "tie"])
    inside = W.partitionBy(*keys, "run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("run").rowsBetween(*EARLIER)
    carried = (
        runs.groupBy(*keys, "run")
        .agg(F.max_by("seen", F.when(F.col("seen").isNotNull(), F.col("pos"))).alias("seen"))
        .select(*keys, "run", F.last("seen", ignorenulls=True).over(earlier).alias("carried"))
    )
    return (
        runs.withColumn("inside", F.last("seen", ignorenulls=True).over(inside))
        .where("is_window = 1")
        .join(carried, [*keys, "run"])
        .select(
            "row.*", F.coalesce("inside", "carried", F.lit(default)).alias(label)
        )
    )
