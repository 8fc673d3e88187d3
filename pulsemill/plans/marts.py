"""Model-ready tables: normalised tensors and prompt records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemill.functions import answers, arrays, spectral
from pulsemill.operators.records import ecg_rows, target, task_rows
from pulsemill.operators.scale import dense_index
from pulsemill.schemas import FOLDS, HR_RANGE

SOURCE_FS = 30.0

# fixed values: the prompt texts
QUALITY_POST_PROMPT = (
    "Decide whether this 10-second PPG window is usable for further analysis.\n"
    "Answer ONLY with 'good' or 'bad'.\n"
    "You MUST end your response with 'Answer: <good|bad>'"
)
HR_POST_PROMPT = (
    "Estimate the heart rate in beats per minute for this 10-second PPG window.\n"
    f"Answer with a single integer between {HR_RANGE[0]:.0f} and {HR_RANGE[1]:.0f}.\n"
    "You MUST end your response with 'Answer: <hr_bpm>'"
)
PRE_PROMPT = (
    "You are given a photoplethysmography (PPG) signal recorded at a fingertip, "
    "sampled at 30 Hz for 10 seconds (300 points)."
)
SERIES_TEXT = "This is the %s, it has mean %%.4f and std %%.4f."
SIGNAL_TEXT = "%s signal"
MAGNITUDE_TEXT = "accelerometer magnitude (L2 norm of the 3 axes)"
AXIS_TEXT = "accelerometer data on the %s-axis"
ACC_MODES = ("none", "magnitude", "axes")


def tensor_mart(
    registry: DataFrame,
    task: str,
    target_fs: float = 50.0,
    normalize: str = "zscore",
    good_quality_only: bool = True,
) -> DataFrame:
    """One resampled, normalised window per row with its label, ready to partition.

    ``registry`` carries ``split``. The task's filter runs before the transform.
    """
    rows = task_rows(registry, task) if good_quality_only else registry
    x = spectral.resample(F.col("ppg"), SOURCE_FS, target_fs)
    rows = rows.withColumn("_x", x)
    scaled = (
        arrays.zscore(F.col("_x"))["x"] if normalize == "zscore" else arrays.minmax_pm1(F.col("_x"))
    )
    return rows.select(
        F.lit(task).alias("task"),
        "split",
        "subject_id",
        "record_id",
        scaled.cast("array<float>").alias("x"),
        target(task).cast("bigint" if task == "quality" else "float").alias("y"),
    )


def _entry(x: Column, what: str) -> Column:
    """STRUCT<text, series>: the z-scored series and a sentence with its mean and std."""
    return arrays.let(
        arrays.zscore(x),
        lambda z: F.struct(
            F.format_string(SERIES_TEXT % what, z["mean"], z["std"]).alias("text"),
            z["x"].alias("series"),
        ),
    )


def time_series(acc_mode: str = "none", signal: str = "ppg") -> Column:
    """The entries of a prompt record; their number varies with ACC availability."""
    if acc_mode not in ACC_MODES:
        raise ValueError(f"unknown acc_mode {acc_mode!r}, expected one of {ACC_MODES}")
    main = F.array(_entry(F.col(signal), SIGNAL_TEXT % signal.upper()))
    if signal != "ppg" or acc_mode == "none":
        return main
    acc = F.col("acc")
    if acc_mode == "magnitude":
        extra = F.array(_entry(arrays.magnitude(acc), MAGNITUDE_TEXT))
    else:
        extra = F.array(
            *[
                _entry(acc[i], AXIS_TEXT % axis)
                for i, axis in enumerate("xyz")
            ]
        )
    has = F.coalesce(F.col("has_acc"), F.lit(False)) & acc.isNotNull()
    return F.when(has, F.concat(main, extra)).otherwise(main)


def prompt_mart(
    registry: DataFrame,
    task: str,
    acc_mode: str = "magnitude",
    signal: str = "ppg",
    good_quality_only: bool = True,
) -> DataFrame:
    """Prompt, series and answer per window, with the exact labels beside the text answer."""
    rows = task_rows(registry, task) if good_quality_only else registry
    if signal == "ecg":
        rows = ecg_rows(rows)
    return rows.select(
        F.lit(task).alias("task"),
        "split",
        "record_id",
        "subject_id",
        F.lit(PRE_PROMPT).alias("pre_prompt"),
        time_series(acc_mode, signal).alias("time_series"),
        F.lit(QUALITY_POST_PROMPT if task == "quality" else HR_POST_PROMPT).alias("post_prompt"),
        answers.text_answer(task, F.col("quality_label"), F.col("hr_ref")).alias("answer"),
        "quality_label",
        F.when(~F.isnan("hr_ref"), F.col("hr_ref")).alias("hr_ref"),
    )


def answered(mart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): a record whose label is missing has no answer to learn."""
    return mart.where("answer IS NOT NULL"), mart.where("answer IS NULL")


def manifest(mart: DataFrame, **parameters) -> DataFrame:
    """Counts per task and fold with the build parameters; an empty fold has zero counts."""
    per_subject = mart.groupBy("task", "split", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_subject.groupBy("task", "split").agg(
        F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("windows")
    )
    folds = counts.select("task").distinct().select("task", F.explode(F.array(*map(F.lit, FOLDS))).alias("split"))
    return (
        folds.join(counts, ["task", "split"], "full")
        .fillna(0, ["subjects", "windows"])
        .withColumns({name: F.lit(value) for name, value in parameters.items()})
    )


def subject_tensors(mart: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Windows packed per subject as (part, record_ids, x (N, 1, L), y), in record order.

    Part 0 holds the subject's first ``rows_per_part`` records, part 1 the next, and so on,
    so no row holds more windows than that.
    """
    keys = ["task", "split", "subject_id"]
    placed = dense_index(mart, keys, ["record_id"], "_position")
    return (
        placed.withColumn("part", F.floor(F.col("_position") / rows_per_part))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_position", "record_id", "x", "y"))).alias("rows"))
        .select(
            *keys,
            "part",
            F.transform("rows", lambda r: r["record_id"]).alias("record_ids"),
            F.transform("rows", lambda r: F.array(r["x"])).alias("x"),
            F.transform("rows", lambda r: r["y"]).alias("y"),
        )
    )
