"""Raw signals and annotations to a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from pulsemill.functions import arrays, spectral
from pulsemill.operators import heartbeat, records, windows
from pulsemill.sources import watch
from pulsemill.sources.signals import ecg_on_ppg_grid, extract_ppg


def process(
    annotations: DataFrame,
    info: DataFrame,
    raw_ppg: DataFrame,
    acc: DataFrame | None = None,
    ecg: DataFrame | None = None,
    dataset: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(registry, rejects). A record without a usable PPG window goes to the rejects only."""
    windows_ = extract_ppg(raw_ppg)
    rejects = windows_.where("reject_reason IS NOT NULL").select("record_id", "reject_reason")
    good = windows_.where("reject_reason IS NULL")
    acc = acc.where("reject_reason IS NULL").select("record_id", F.col("x").alias("acc")) if acc else None
    ecg = ecg_on_ppg_grid(ecg.where("reject_reason IS NULL")) if ecg else None
    registry = records.with_signals(records.annotated(annotations, info), good, acc, ecg)
    return (
        registry.withColumn("dataset", F.lit(dataset)).withColumn("activity", F.lit("")),
        rejects,
    )


def watch_windows(
    ppg: DataFrame,
    ecg: DataFrame,
    events: DataFrame,
    seconds: float = 10.0,
    ppg_fs: float = watch.PPG_FS,
    ecg_fs: float = watch.ECG_FS,
    target_fs: float = 30.0,
    invert: bool = True,
    hr: Column | None = None,
    dataset: str = "",
) -> DataFrame:
    """Registry rows from watch series: paired windows with an ECG heart rate and an activity.

    The ECG only gives the label: its windows become a rate (``hr``, an expression
    over the window ``x``) before they meet the PPG windows, so their samples
    travel once. Windows with a bad sample or no trustworthy rate are dropped.
    Activities are looked up for the window keys alone. Both are joined on
    (subject, window), the partitioning the PPG windows already have.
    """
    n_ppg, n_ecg = int(seconds * ppg_fs), int(seconds * ecg_fs)
    keys = ["subject_id", "window_idx"]
    beats = windows.tumbling_windows(ecg, n_ecg)
    if hr is None:
        beats = beats.withColumn("beats", heartbeat.r_peaks(F.col("x"), ecg_fs))
        hr = heartbeat.rate(F.col("beats"), ecg_fs)
    rates = beats.select(*keys, hr.alias("hr_ref")).where("hr_ref IS NOT NULL")
    starts = windows.window_keys(ppg, n_ppg).withColumn(
        "t0", windows.window_start(F.col("window_idx"), seconds)
    )
    activity = windows.label_as_of(starts, events, ["subject_id"], "t0", "t", "activity").drop("t0")
    whole = windows.usable(windows.tumbling_windows(ppg, n_ppg), n_ppg)
    x = F.col("x").cast("array<double>")
    x = spectral.resample(arrays.invert(x) if invert else x, ppg_fs, target_fs)
    rated = whole.join(rates, keys).join(activity, keys).select(
        windows.window_id(F.col("subject_id"), F.col("window_idx")).alias("record_id"),
        "subject_id",
        "hr_ref",
        x.cast("array<float>").alias("ppg"),
        "activity",
    )
    none = F.lit(None)
    return rated.select(
        "record_id",
        "subject_id",
        F.lit(dataset).alias("dataset"),
        F.lit(1).alias("quality_label"),
        "hr_ref",
        F.lit(False).alias("has_acc"),
        "ppg",
        none.cast("array<array<float>>").alias("acc"),
        F.lit("wrist").alias("measurement_site"),
        F.lit("").alias("sex"),
        none.cast("double").alias("age"),
        none.cast("double").alias("height"),
        none.cast("double").alias("weight"),
        "activity",
    )


def watch_registry(spark: SparkSession, raw: str, dataset: str = "", invert: bool = True) -> DataFrame:
    """Registry of a folder of watch recordings."""
    found = watch.discover(spark, raw)
    return watch_windows(
        watch.read_signal(spark, raw, found, "ppg", watch.PPG_FS),
        watch.read_signal(spark, raw, found, "ecg", watch.ECG_FS),
        watch.read_events(spark, raw, found),
        invert=invert,
        dataset=dataset,
    )
