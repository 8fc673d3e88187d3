"""Run ledgers and comparison tables, with orders as runs."""

from pyspark.sql import functions as F

from pulsemill.functions import labels
from pulsemill.operators import metrics
from pulsemill.plans import comparison
from pulsemill.sources.tables import run_predictions
from queryset.base import query, r6, sql, table
from queryset.inputs import PRICE_PRED, price_predictions


def ledger(spark, sf):
    """Each order as a run: model by priority, task by status, config as VARIANT."""
    key, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    model = F.element_at(
        F.array(*map(F.lit, ("trivial", "cnn1d", "baseline_features", "sigma_ppg", "opentslm"))),
        F.substring(prio, 1, 1).cast("int"),
    )
    task = F.when(F.col("o_orderstatus") == "O", "hr").otherwise("quality")
    cust = F.col("o_custkey")
    llm = F.element_at(
        F.array(*map(F.lit, ("org/Model-1B", "org/Gemma-3-270M", "x/gemma-big", "x/other"))),
        (cust % 4 + 1).cast("int"),
    )
    variant = F.element_at(F.array(*map(F.lit, ("ppg", "ppg_acc", "ppg_acc_cov"))), (cust % 3 + 1).cast("int"))
    config = F.when(
        F.col("model") == "opentslm",
        F.to_json(F.struct(llm.alias("llm_id"),
                           F.when(cust % 5 == 0, "start.pt").alias("ecg_init"))),
    ).when(
        F.col("model") == "trivial",
        F.to_json(F.struct(F.when(cust % 2 == 0, "dominant_frequency").otherwise("median").alias("method"))),
    ).otherwise(F.to_json(F.struct(variant.alias("input_variant"))))
    score = F.col("o_totalprice") / 499979.0
    quality = F.col("task") == "quality"
    return (
        table(spark, sf, "orders")
        .withColumns({"model": model, "task": task})
        .select(
            key.cast("string").alias("run_id"),
            "model",
            "task",
            F.when(F.col("o_totalprice") > 20000, "finished").otherwise("failed").alias("status"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
            F.parse_json(config).alias("config"),
            F.struct(
                F.when(quality, score).alias("macro_f1"),
                F.when(quality, score * 0.9).alias("accuracy"),
                F.when(quality & (score < 0.9), score * 0.8).alias("roc_auc"),
                F.when(~quality, score * 20.0).alias("mae"),
                F.when(~quality, score * 30.0).alias("rmse"),
            ).alias("metrics"),
        )
    )


LEDGER = """
base_runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey AS cust,
         ['trivial', 'cnn1d', 'baseline_features', 'sigma_ppg', 'opentslm'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS model,
         CASE WHEN o_orderstatus = 'O' THEN 'hr' ELSE 'quality' END AS task,
         CASE WHEN o_totalprice > 20000 THEN 'finished' ELSE 'failed' END AS status,
         strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_totalprice / 499979e0 AS score
  FROM orders),
ledger AS (
  SELECT *, CASE WHEN model IN ('trivial', 'opentslm') THEN 'ppg'
                 ELSE ['ppg', 'ppg_acc', 'ppg_acc_cov'][cust % 3 + 1] END AS variant,
         CASE WHEN model = 'trivial' AND task = 'quality' THEN 'Majority class'
              WHEN model = 'trivial' AND cust % 2 = 0 THEN 'Dominant-frequency HR'
              WHEN model = 'trivial' THEN 'Median HR'
              WHEN model = 'baseline_features' THEN 'Features + LogReg/XGBoost'
              WHEN model = 'cnn1d' THEN '1D-CNN / ResNet1D'
              WHEN model = 'sigma_ppg' THEN 'SIGMA-PPG'
              ELSE 'OpenTSLM-' || ['1B', '270M', 'Gemma', 'other'][cust % 4 + 1]
                   || CASE WHEN cust % 5 = 0 THEN ' (ECG)' ELSE '' END END AS label,
         CASE WHEN task = 'quality' THEN score END AS macro_f1,
         CASE WHEN task = 'quality' THEN score * 0.9e0 END AS accuracy,
         CASE WHEN task = 'quality' AND score < 0.9e0 THEN score * 0.8e0 END AS roc_auc,
         CASE WHEN task = 'hr' THEN score * 20e0 END AS mae,
         CASE WHEN task = 'hr' THEN score * 30e0 END AS rmse
  FROM base_runs),
family_runs AS (
  SELECT *, CASE WHEN label LIKE 'OpenTSLM-%(ECG)' THEN 'OpenTSLM (ECG)'
                 WHEN label LIKE 'OpenTSLM-%' THEN 'OpenTSLM' ELSE label END AS family FROM ledger)"""


@query(
    "run_labels",
    sql([LEDGER], "SELECT run_id, label, family, variant FROM family_runs"),
)
def run_labels(spark, sf):
    return comparison.labelled(ledger(spark, sf)).select("run_id", "label", "family", "variant")


@query(
    "latest_finished_runs",
    sql(
        [LEDGER],
        """SELECT model, task, run_id, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY created_at DESC, run_id DESC) AS rn
          FROM ledger WHERE status = 'finished') WHERE rn = 1""",
    ),
)
def latest_finished_runs(spark, sf):
    best = comparison.latest_finished(ledger(spark, sf).drop("config"), ["model", "task"])
    return best.select("model", "task", "run_id", "created_at")


@query(
    "run_list",
    sql(
        [LEDGER],
        """SELECT run_id, model, task, status, created_at,
        CASE WHEN task = 'quality' THEN 'macro_f1=' || printf('%.4f', macro_f1)
             ELSE 'MAE=' || printf('%.3f', mae) END AS "primary" FROM ledger""",
    ),
)
def run_list(spark, sf):
    return comparison.run_list(ledger(spark, sf))


@query(
    "main_comparison",
    sql(
        [LEDGER,
         """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, task
            ORDER BY created_at DESC, run_id DESC) AS rn FROM family_runs
            WHERE status = 'finished' AND variant = 'ppg') WHERE rn = 1)""",
         "names AS (SELECT * FROM (VALUES "
         + ", ".join(f"({i}, '{n}')" for i, n in enumerate(labels.MAIN_ORDER))
         + ") v(row, family))"],
        f"""SELECT CAST(n.row AS BIGINT) AS row, coalesce(q.label, h.label, n.family) AS model,
        {r6('q.macro_f1')} AS quality_macro_f1, {r6('q.roc_auc')} AS quality_roc_auc,
        {r6('q.accuracy')} AS quality_accuracy, {r6('h.mae')} AS hr_mae, {r6('h.rmse')} AS hr_rmse
        FROM names n LEFT JOIN best q ON q.family = n.family AND q.task = 'quality'
        LEFT JOIN best h ON h.family = n.family AND h.task = 'hr'""",
    ),
)
def main_comparison(spark, sf):
    return comparison.main_table(ledger(spark, sf))


@query(
    "extended_comparison",
    sql(
        [LEDGER,
         """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, variant
            ORDER BY created_at DESC, run_id DESC) AS rn FROM ledger
            WHERE status = 'finished' AND task = 'quality') WHERE rn = 1)""",
         "names AS (SELECT * FROM (VALUES "
         + ", ".join(f"({i}, '{n}')" for i, n in enumerate(labels.EXTENDED_ROWS))
         + ") v(row, label))"],
        f"""SELECT CAST(n.row AS BIGINT) AS row, n.label AS model,
        {r6("max(CASE WHEN variant = 'ppg' THEN macro_f1 END)")} AS ppg,
        {r6("max(CASE WHEN variant = 'ppg_acc' THEN macro_f1 END)")} AS ppg_acc,
        {r6("max(CASE WHEN variant = 'ppg_acc_cov' THEN macro_f1 END)")} AS ppg_acc_cov
        FROM names n LEFT JOIN best b ON b.label = n.label GROUP BY n.row, n.label""",
    ),
)
def extended_comparison(spark, sf):
    return comparison.extended_table(ledger(spark, sf))


@query(
    "display_values",
    sql(
        [LEDGER],
        """SELECT run_id, coalesce(printf('%.4f', roc_auc), '—') AS roc_auc,
        coalesce(printf('%.3f', mae), '—') AS mae FROM ledger""",
    ),
)
def display_values(spark, sf):
    return ledger(spark, sf).select(
        "run_id",
        labels.display(F.col("metrics.roc_auc")).alias("roc_auc"),
        labels.display(F.col("metrics.mae"), 3).alias("mae"),
    )


SPREAD = f"""{r6("avg(CASE WHEN task = 'quality' THEN macro_f1 ELSE mae END)")} AS mean,
{r6("stddev_pop(CASE WHEN task = 'quality' THEN macro_f1 ELSE mae END)")} AS std,
{r6('avg(roc_auc)')} AS roc_auc, {r6('avg(accuracy)')} AS accuracy, {r6('avg(rmse)')} AS rmse,
CASE WHEN task = 'quality' THEN 'macro_f1' ELSE 'mae' END AS metric"""


@query(
    "low_data_report",
    sql(
        [LEDGER,
         """known AS (SELECT *, (cust % 7) / 7e0 AS fraction, CAST(cust % 7 AS BIGINT) AS n_train_subjects
            FROM ledger WHERE status = 'finished' AND model <> 'trivial' AND model <> 'opentslm'
            AND cust % 7 IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 0))"""],
        f"""SELECT label AS model, task, {r6('fraction')} AS fraction, n_train_subjects, count(*) AS n_seeds, {SPREAD}
        FROM known GROUP BY label, task, fraction, n_train_subjects""",
    ),
)
def low_data_report(spark, sf):
    """Mean and spread over the runs of each low-data split; runs of a missing split drop out.

    Nations stand for splits: a run names split ``custkey % 7``.
    """
    cust = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), (F.col("o_custkey") % 7).alias("k")
    )
    path = F.when(
        ~F.col("model").isin("trivial", "opentslm"),
        F.to_json(F.struct(F.format_string("splits/%d.json", F.col("k")).alias("split"))),
    ).otherwise(F.lit("{}"))
    runs = ledger(spark, sf).join(cust, "run_id").withColumn("config", F.parse_json(path))
    splits = table(spark, sf, "nation").where("n_nationkey > 0").select(
        F.col("n_nationkey").cast("string").alias("split_id"),
        (F.col("n_nationkey") / 7.0).alias("fraction"),
        F.col("n_nationkey").alias("n_train_subjects"),
    )
    return comparison.seed_spread(comparison.low_data_runs(runs, splits))


@query(
    "seed_spread",
    sql(
        [LEDGER],
        f"""SELECT label AS model, task, CASE WHEN cust % 2 = 0 THEN 0.5e0 ELSE 1e0 END AS fraction,
        CAST(30 AS BIGINT) AS n_train_subjects, count(*) AS n_seeds, {SPREAD}
        FROM ledger GROUP BY label, task, cust % 2""",
    ),
)
def seed_spread(spark, sf):
    runs = comparison.labelled(ledger(spark, sf)).join(
        table(spark, sf, "orders").select(
            F.col("o_orderkey").cast("string").alias("run_id"),
            F.when(F.col("o_custkey") % 2 == 0, 0.5).otherwise(1.0).alias("fraction"),
        ),
        "run_id",
    )
    return comparison.seed_spread(
        runs.withColumn("model", F.col("label")).withColumn("n_train_subjects", F.lit(30))
    )


@query(
    "predictions_with_run",
    sql(
        [PRICE_PRED,
         """runs AS (SELECT l_returnflag AS run_id, max(l_linestatus) AS model, min(l_shipdate) AS d
            FROM lineitem GROUP BY l_returnflag)"""],
        f"""SELECT p.run_id, r.model, count(*) AS n, {r6('avg(abs(p.y_true - p.y_pred))')} AS mae
        FROM price_pred p JOIN runs r ON p.run_id = r.run_id GROUP BY p.run_id, r.model""",
    ),
)
def predictions_with_run(spark, sf):
    """Prediction files scored next to their run's record."""
    lines = table(spark, sf, "lineitem")
    runs = lines.groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.max("l_linestatus").alias("model"),
        F.lit("finished").alias("status"),
        F.min("l_shipdate").cast("string").alias("created_at"),
    )
    joined = run_predictions(runs, price_predictions(spark, sf))
    error = F.abs(F.col("y_true") - F.col("y_pred"))
    return joined.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"))


@query(
    "best_epoch",
    sql(
        [],
        f"""SELECT CAST(l_suppkey AS VARCHAR) AS run_id, task, CAST(arg_min(epoch, (-score, epoch)) AS BIGINT) AS epoch,
        {r6('max(score)')} AS score FROM (
          SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'quality' ELSE 'hr' END AS task,
                 l_linenumber AS epoch, avg(CASE WHEN l_linestatus = 'F' THEN l_discount ELSE -l_discount END) AS score
          FROM lineitem GROUP BY ALL) GROUP BY l_suppkey, task""",
    ),
)
def best_epoch(spark, sf):
    """Suppliers as runs, line numbers as epochs, mean discount as the validation score.

    Epochs of equal means differ by the rounding of their sums, so the values are added in the
    order of the table's rows, however Spark cuts its files.
    """
    key = ("run_id", "task", "epoch")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("run_id"),
        F.when(F.col("l_linestatus") == "F", "quality").otherwise("hr").alias("task"),
        F.col("l_linenumber").alias("epoch"),
        "l_discount", "_metadata.file_path", "_metadata.row_index",
    )
    log = (
        rows.repartition(*key).sortWithinPartitions(*key, "file_path", "row_index")
        .groupBy(*key).agg(F.avg("l_discount").alias("value"))
        .withColumn("macro_f1", F.when(F.col("task") == "quality", F.col("value")))
        .withColumn("mae", F.when(F.col("task") == "hr", F.col("value")))
    )
    return metrics.best_epoch(log)
