"""Registry-level filters, projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsemill.functions import answers, labels
from pulsemill.operators.scale import join_dimension
from pulsemill.schemas import HR_RANGE, PREDICTIONS


def task_rows(registry: DataFrame, task: str, acc_subset: bool = False) -> DataFrame:
    """The rows a task works on: HR uses good windows only, in every fold."""
    if task == "hr":
        registry = registry.where("quality_label = 1")
    return registry.where("has_acc") if acc_subset else registry


def ecg_rows(registry: DataFrame) -> DataFrame:
    if "has_ecg" not in registry.columns:
        raise ValueError("the registry has no has_ecg column")
    return registry.where("has_ecg")


def fold_rows(registry: DataFrame, fold: str | None) -> DataFrame:
    """One fold; None or ``all`` keeps every row."""
    return registry if fold in (None, "all") else registry.where(F.col("split") == fold)


def first_records(registry: DataFrame, n: int) -> DataFrame:
    return registry.orderBy("record_id").limit(n)


def not_landed(available: DataFrame, landed: DataFrame) -> DataFrame:
    """Records that are not in the landing table yet."""
    return available.join(landed.select("record_id"), "record_id", "left_anti")


def plausible_hr(value: Column) -> Column:
    return value.between(*HR_RANGE)


def target(task: str) -> Column:
    return (F.col("quality_label") if task == "quality" else F.col("hr_ref")).cast("double")


def prediction_frame(
    rows: DataFrame,
    task: str,
    y_pred: Column,
    prob_good: Column | None = None,
    raw_response: Column | None = None,
    parse_status: Column | None = None,
) -> DataFrame:
    """The eight canonical columns; whatever a model does not provide is null."""
    missing = F.lit(None)
    values = {
        "record_id": F.col("record_id"),
        "subject_id": F.col("subject_id"),
        "task": F.lit(task),
        "y_true": target(task),
        "y_pred": y_pred,
        "prob_good": missing if prob_good is None else prob_good,
        "raw_response": missing if raw_response is None else raw_response,
        "parse_status": missing if parse_status is None else parse_status,
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PREDICTIONS])


def answers_to_predictions(records: DataFrame, responses: DataFrame, task: str) -> DataFrame:
    """Parse each record's ``raw_response``; unreadable answers keep their row.

    Records and responses must pair up one to one: anything left over on either
    side, and an id that stands twice on one, fails the job instead of vanishing or
    multiplying in the join.
    """
    if task not in ("quality", "hr"):
        raise ValueError(f"unknown task {task!r}")
    both = _once(records, "record").withColumn("is_record", F.lit(True)).join(
        _once(responses.select("record_id", "raw_response"), "response").withColumn("is_response", F.lit(True)),
        "record_id",
        "full_outer",
    )
    paired = both.where(
        F.when(F.col("is_record") & F.col("is_response"), True).otherwise(
            F.raise_error(F.concat(F.lit("unpaired record or response: "), F.col("record_id")))
        )
    )
    parse = answers.parse_quality if task == "quality" else answers.parse_hr
    parsed = paired.withColumn("parsed", parse(F.col("raw_response")))
    return prediction_frame(
        parsed,
        task,
        F.col("parsed.y_pred"),
        raw_response=F.col("raw_response"),
        parse_status=F.col("parsed.parse_status"),
    )


def _once(df: DataFrame, what: str, key: str = "record_id") -> DataFrame:
    """``df``, failing the job when a row's key stands twice. Rows of a key meet in the order of
    the join that follows, so this costs no shuffle of its own."""
    again = F.row_number().over(Window.partitionBy(key).orderBy(key))
    error = F.raise_error(F.concat(F.lit(f"{what} twice: "), F.col(key)))
    return df.withColumn("_again", again).where(F.when(F.col("_again") == 1, True).otherwise(error)).drop("_again")


def recover_labels(mart: DataFrame, task: str) -> DataFrame:
    """Take the label from the text answer where the mart carries no exact label at all."""
    column = "quality_label" if task == "quality" else "hr_ref"
    from_answer = answers.label_from_answer(task, F.col("answer"))
    if column not in mart.columns:
        return mart.withColumn(column, from_answer)
    exact = F.col(column).cast("double")
    any_exact = mart.agg(F.count(column)).scalar() > 0
    return mart.withColumn(column, F.when(any_exact, exact).otherwise(from_answer))


def with_split(registry: DataFrame, split: DataFrame) -> DataFrame:
    """Add each subject's fold as ``split``; a subject without a fold fails the job.

    ``split`` has one row per subject. The check rides along the join, so the
    registry is read once.
    """
    folds = split.select("subject_id", F.col("fold").alias("split"))
    joined = join_dimension(registry, folds, "subject_id", "left")
    return joined.withColumn(
        "split",
        F.when(F.col("split").isNotNull(), F.col("split")).otherwise(
            F.raise_error(F.concat(F.lit("subject without a fold: "), F.col("subject_id")))
        ),
    )


def uncovered_subjects(registry: DataFrame, split: DataFrame) -> DataFrame:
    """Registry subjects the split does not mention."""
    return registry.select("subject_id").distinct().join(
        split.select("subject_id"), "subject_id", "left_anti"
    )


def annotated(annotations: DataFrame, info: DataFrame) -> DataFrame:
    """Annotations with subject info by record id, registry column names."""
    # of several rows of an id, the smallest: the same one in every run
    info = info.groupBy("ID").agg(F.min(F.struct(*[c for c in info.columns if c != "ID"])).alias("i")).select("ID", "i.*")
    info = info.select(
        F.col("ID").alias("record_id"),
        F.col("Gender").alias("sex"),
        F.col("Age [years]").alias("age"),
        F.col("Height [cm]").alias("height"),
        F.col("Weight [kg]").alias("weight"),
        F.col("Ear/finger").alias("site_flag"),
    )
    base = annotations.select(
        F.col("ID").alias("record_id"),
        labels.subject_of(F.col("ID")).alias("subject_id"),
        F.col("Quality").cast("int").alias("quality_label"),
        F.col("HR").cast("double").alias("hr_ref"),
    )
    return (
        base.join(info, "record_id", "left")
        .withColumn("measurement_site", labels.site(F.col("site_flag")))
        .withColumn("sex", F.coalesce("sex", F.lit("")))
        .drop("site_flag")
    )


def with_signals(
    records: DataFrame, ppg: DataFrame, acc: DataFrame | None = None, ecg: DataFrame | None = None
) -> DataFrame:
    """Attach signals: PPG is required, ACC and ECG leave a flag and a null array."""
    out = records.join(ppg.select("record_id", "ppg"), "record_id")
    for name, table, kind in (("acc", acc, "array<array<float>>"), ("ecg", ecg, "array<float>")):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast(kind))
        else:
            out = out.join(table.select("record_id", name), "record_id", "left")
        out = out.withColumn(f"has_{name}", F.col(name).isNotNull())
    return out


def summary(registry: DataFrame) -> DataFrame:
    """Windows, subjects, activities and ACC windows of a registry.

    Distinct values are first reduced per (subject, activity), so the last step
    sees that small table only.
    """
    groups = registry.groupBy("subject_id", "activity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_acc").alias("n_acc")
    )
    return groups.agg(
        F.sum("n").alias("windows"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("activity").alias("activities"),
        F.sum("n_acc").alias("with_acc"),
    )
