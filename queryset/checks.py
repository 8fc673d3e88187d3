"""Constraint queries over tables with injected faults."""

from pyspark.sql import functions as F

from pulsemill.operators import constraints
from pulsemill.sources.tables import unknown_run_values
from queryset.base import query, sql, table
from queryset.inputs import (
    QUALITY_PRED,
    REGISTRY,
    SIGNALS,
    quality_predictions,
    registry,
    signal_registry,
)
from queryset.ledger import LEDGER, ledger

# line items as windows: several lines of an order share its id, tax 0.08 is no label
REG_FAULTS = """
faulty AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(round(l_tax * 25) AS BIGINT) AS quality_label,
                  l_returnflag AS dataset FROM lineitem),
reg_bad AS (
  SELECT record_id, 'duplicate' AS problem FROM faulty GROUP BY record_id HAVING count(*) > 1
  UNION ALL SELECT record_id, 'quality_label' AS problem FROM faulty WHERE quality_label NOT IN (0, 1)
  UNION ALL SELECT record_id, 'dataset' AS problem FROM faulty WHERE dataset NOT IN ('A', 'N'))"""


def _faulty_registry(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.round(F.col("l_tax") * 25).cast("int").alias("quality_label"),
        F.col("l_returnflag").alias("dataset"),
    )


@query("registry_violations", sql([REG_FAULTS], "SELECT record_id, problem FROM reg_bad"))
def registry_violations(spark, sf):
    return constraints.registry_violations(_faulty_registry(spark, sf), ("A", "N"))


@query(
    "first_offenders",
    sql([REG_FAULTS], "SELECT record_id, problem FROM reg_bad ORDER BY record_id, problem LIMIT 5"),
)
def first_offenders(spark, sf):
    """The five offenders an error text names."""
    return constraints.first_offenders(
        constraints.registry_violations(_faulty_registry(spark, sf), ("A", "N"))
    )


PRED_FAULTS = """
faulty AS (SELECT CAST(user_id AS VARCHAR) || event_type AS record_id,
                  CASE event_type WHEN 'view' THEN 'quality' WHEN 'click' THEN 'hr' ELSE event_type END AS task,
                  CASE WHEN value > 100 THEN 'ok' WHEN value > 20 THEN 'maybe' END AS parse_status FROM events)"""


@query(
    "prediction_violations",
    sql(
        [PRED_FAULTS],
        """SELECT record_id, 'duplicate' AS problem FROM faulty GROUP BY record_id HAVING count(*) > 1
        UNION ALL SELECT record_id, 'task' AS problem FROM faulty WHERE task NOT IN ('quality', 'hr')
        UNION ALL SELECT record_id, 'parse_status' AS problem FROM faulty WHERE parse_status = 'maybe'""",
    ),
)
def prediction_violations(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), kind).alias("record_id"),
        F.when(kind == "view", "quality").when(kind == "click", "hr").otherwise(kind).alias("task"),
        F.when(F.col("value") > 100, "ok").when(F.col("value") > 20, "maybe").alias("parse_status"),
    )
    return constraints.prediction_violations(rows)


@query(
    "mixed_task_runs",
    sql(
        [],
        """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(DISTINCT l_linestatus) AS n_tasks
        FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) <> 1""",
    ),
)
def mixed_task_runs(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linestatus").alias("task")
    )
    return constraints.mixed_task_runs(rows)


@query(
    "unscorable_runs",
    sql(
        [],
        """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS n_records FROM lineitem
        GROUP BY l_orderkey HAVING count(*) FILTER (l_discount > 0.05) = 0""",
    ),
)
def unscorable_runs(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("y_pred"),
    )
    return constraints.unscorable_runs(rows)


@query(
    "small_splits",
    sql(
        [REGISTRY],
        "SELECT count(DISTINCT measurement_site) AS n_subjects FROM registry HAVING count(DISTINCT measurement_site) < 9",
    ),
)
def small_splits(spark, sf):
    """Sites as subjects: fewer than the nine that are asked for here."""
    sites = registry(spark, sf).select(F.col("measurement_site").alias("subject_id"))
    return constraints.small_splits(sites, least=9)


@query(
    "mart_gaps",
    sql(
        [SIGNALS],
        """SELECT f.split, count(s.vec_id) AS n,
        count(*) FILTER (s.vec_id IS NOT NULL AND NOT s.has_acc) AS n_incomplete
        FROM (VALUES ('train'), ('val'), ('test')) f(split)
        LEFT JOIN signals s ON s.split = f.split AND f.split <> 'val' GROUP BY f.split
        HAVING count(s.vec_id) = 0 OR count(*) FILTER (s.vec_id IS NOT NULL AND NOT s.has_acc) > 0""",
    ),
)
def mart_gaps(spark, sf):
    """A mart without its validation fold, where windows without ACC lost their answer."""
    mart = signal_registry(spark, sf).where("split <> 'val'").select(
        "split", "record_id", "subject_id", F.when(F.col("has_acc"), "good").alias("answer")
    )
    return constraints.mart_gaps(mart)


@query(
    "unknown_run_values",
    sql(
        [LEDGER],
        """SELECT run_id AS record_id, 'model, task or status' AS problem FROM ledger
        WHERE model = 'cnn1d' OR task = 'hr'""",
    ),
)
def unknown_run_values_(spark, sf):
    """Runs whose model or task was renamed to something unknown."""
    renamed = ledger(spark, sf).select(
        "run_id",
        F.when(F.col("model") == "cnn1d", "cnn2d").otherwise(F.col("model")).alias("model"),
        F.when(F.col("task") == "hr", F.lit(None).cast("string")).otherwise(F.col("task")).alias("task"),
        "status",
    )
    return unknown_run_values(renamed)


@query(
    "wrong_report_input",
    sql(
        [QUALITY_PRED],
        """SELECT record_id, 'not a hr row' AS problem FROM quality_pred
        WHERE NOT coalesce(CASE WHEN y_true = 1 THEN 'hr' WHEN y_pred = 1 THEN 'quality' END = 'hr', false)""",
    ),
)
def wrong_report_input(spark, sf):
    """Rows that the HR reports refuse: some of another task, some without one."""
    task = F.when(F.col("y_true") == 1, "hr").when(F.col("y_pred") == 1, "quality")
    return constraints.wrong_task_rows(quality_predictions(spark, sf).withColumn("task", task), "hr")
