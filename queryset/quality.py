"""Quality predictions: metrics, thresholds, gates."""

from pyspark.sql import functions as F

from pulsemill.functions.labels import decide
from pulsemill.operators import gates, metrics
from pulsemill.operators.records import prediction_frame
from pulsemill.operators.scale import join_dimension, seeded_hash
from queryset.base import query, r6, sql
from queryset.inputs import HR_PRED, QUALITY_PRED, hr_predictions, quality_predictions

CELLS = """
cells AS (
  SELECT run_id, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
         count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
         count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp
  FROM quality_pred WHERE y_pred IS NOT NULL GROUP BY run_id)"""

F1 = """
f1 AS (
  SELECT run_id, tn, fp, fn, tp,
         CASE WHEN 2 * tn + fp + fn = 0 THEN 0e0 ELSE 2e0 * tn / (2 * tn + fp + fn) END AS bad_f1,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS good_f1,
         CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END AS k
  FROM cells)"""

# every (good, bad) pair of a run, counted by running totals over its sorted scores
AUC = """
by_score AS (
  SELECT run_id, prob_good, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
  FROM quality_pred WHERE y_pred IS NOT NULL AND prob_good IS NOT NULL GROUP BY run_id, prob_good),
ranked AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id ORDER BY prob_good
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score),
auc AS (
  SELECT run_id, CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL
                 ELSE sum(pos * (below + 0.5e0 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc
  FROM ranked GROUP BY run_id)"""


@query("quality_confusion", sql([QUALITY_PRED, CELLS], "SELECT run_id, tn, fp, fn, tp FROM cells"))
def confusion(spark, sf):
    return metrics.confusion(metrics.scored(quality_predictions(spark, sf)), ["run_id"])


def _ratio(a: str, b: str) -> str:
    return r6(f"CASE WHEN {b} = 0 THEN 0e0 ELSE 1e0 * {a} / ({b}) END")


@query(
    "quality_class_scores",
    sql(
        [QUALITY_PRED, CELLS, F1],
        f"""SELECT run_id, {_ratio('tn', 'tn + fn')} AS bad_precision, {_ratio('tn', 'tn + fp')} AS bad_recall,
        {r6('bad_f1')} AS bad_f1, tn + fp AS bad_support,
        {_ratio('tp', 'tp + fp')} AS good_precision, {_ratio('tp', 'tp + fn')} AS good_recall,
        {r6('good_f1')} AS good_f1, tp + fn AS good_support FROM f1""",
    ),
)
def class_scores(spark, sf):
    cells = metrics.confusion(metrics.scored(quality_predictions(spark, sf)), ["run_id"])
    return cells.select("run_id", *[c.alias(n) for n, c in metrics.class_scores().items()])


@query(
    "quality_macro_f1_accuracy",
    sql(
        [QUALITY_PRED, CELLS, F1],
        f"""SELECT run_id, tn + fp + fn + tp AS n, {r6('(bad_f1 + good_f1) / k')} AS macro_f1,
        {r6('1e0 * (tn + tp) / (tn + fp + fn + tp)')} AS accuracy FROM f1""",
    ),
)
def macro_f1_accuracy(spark, sf):
    return metrics.quality_metrics(quality_predictions(spark, sf)).select(
        "run_id", "n", "macro_f1", "accuracy"
    )


@query("quality_roc_auc", sql([QUALITY_PRED, AUC], f"SELECT run_id, {r6('roc_auc')} AS roc_auc FROM auc"))
def roc_auc(spark, sf):
    rows = metrics.scored(quality_predictions(spark, sf))
    return metrics.roc_auc(rows).select("run_id", "roc_auc")


_CLASS_SQL = {
    "bad_precision": _ratio("tn", "tn + fn"), "bad_recall": _ratio("tn", "tn + fp"), "bad_f1": r6("bad_f1"), "bad_support": "(tn + fp)",
    "good_precision": _ratio("tp", "tp + fp"), "good_recall": _ratio("tp", "tp + fn"), "good_f1": r6("good_f1"), "good_support": "(tp + fn)",
}
SUMMARY_SQL = sql(
    [QUALITY_PRED, HR_PRED, CELLS, F1, AUC,
     """both_pred AS (SELECT run_id, task, y_true, y_pred, parse_status FROM quality_pred
        UNION ALL SELECT 'hr_' || run_id AS run_id, task, y_true, y_pred, parse_status FROM hr_pred)"""],
    f"""
SELECT b.run_id, b.task, count(*) AS n_records, count(b.y_pred) AS n_scored,
       count(*) FILTER (b.parse_status = 'invalid') AS n_invalid_responses,
       {r6("1e0 * count(*) FILTER (b.parse_status = 'invalid') / count(*)")} AS invalid_response_fraction,
       {r6("max(CASE WHEN b.task = 'quality' THEN (bad_f1 + good_f1) / k END)")} AS macro_f1,
       {r6("max(CASE WHEN b.task = 'quality' THEN 1e0 * (tn + tp) / (tn + fp + fn + tp) END)")} AS accuracy,
       {r6("max(CASE WHEN b.task = 'quality' THEN roc_auc END)")} AS roc_auc,
       {r6("avg(CASE WHEN b.task = 'hr' THEN abs(b.y_true - b.y_pred) END)")} AS mae,
       {r6("sqrt(avg(CASE WHEN b.task = 'hr' THEN (b.y_true - b.y_pred) * (b.y_true - b.y_pred) END))")} AS rmse,
       max(CASE WHEN b.task = 'quality' THEN tn END) AS tn, max(CASE WHEN b.task = 'quality' THEN fp END) AS fp,
       max(CASE WHEN b.task = 'quality' THEN fn END) AS fn, max(CASE WHEN b.task = 'quality' THEN tp END) AS tp,
       {", ".join(f"max(CASE WHEN b.task = 'quality' THEN {c} END) AS {n}" for n, c in _CLASS_SQL.items())}
FROM both_pred b LEFT JOIN f1 ON b.run_id = f1.run_id LEFT JOIN auc ON b.run_id = auc.run_id
GROUP BY b.run_id, b.task""",
)


@query("prediction_summary", SUMMARY_SQL)
def prediction_summary(spark, sf):
    """The evaluation report of every prediction file."""
    quality = quality_predictions(spark, sf).drop("n_chars")
    hr = hr_predictions(spark, sf).withColumn("run_id", F.concat(F.lit("hr_"), "run_id"))  # a run has one task
    return metrics.evaluate(quality.unionByName(hr))


CURVE = """
grid AS (SELECT CAST(unnest(generate_series(1, 199)) AS DOUBLE) * 0.005e0 AS threshold),
swept AS (
  SELECT run_id, threshold,
         count(*) FILTER (y_true = 1 AND prob_good >= threshold) AS tp,
         count(*) FILTER (y_true = 0 AND prob_good >= threshold) AS fp,
         count(*) FILTER (y_true = 1 AND prob_good < threshold) AS fn,
         count(*) FILTER (y_true = 0 AND prob_good < threshold) AS tn
  FROM quality_pred CROSS JOIN grid GROUP BY run_id, threshold),
curve AS (
  SELECT run_id, threshold,
         (CASE WHEN 2 * tn + fp + fn = 0 THEN 0e0 ELSE 2e0 * tn / (2 * tn + fp + fn) END
          + CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END)
         / (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) AS f
  FROM swept)"""


@query(
    "threshold_curve",
    sql([QUALITY_PRED, CURVE], f"SELECT run_id, {r6('threshold')} AS threshold, {r6('f')} AS macro_f1 FROM curve"),
)
def threshold_curve(spark, sf):
    return metrics.threshold_curve(quality_predictions(spark, sf))


@query(
    "threshold_choice",
    sql(
        [QUALITY_PRED, CURVE],
        f"""SELECT run_id, {r6('min(threshold)')} AS threshold, {r6('max(f)')} AS macro_f1
        FROM curve c WHERE f = (SELECT max(f) FROM curve d WHERE d.run_id = c.run_id) GROUP BY run_id""",
    ),
)
def threshold_choice(spark, sf):
    return metrics.best_threshold(quality_predictions(spark, sf))


FOLD = "CASE WHEN substr(md5('3|' || record_id), 1, 1) < '8' THEN 'val' ELSE 'test' END"


@query(
    "frozen_threshold",
    sql(
        [
            QUALITY_PRED.replace("quality_pred AS", "all_pred AS"),
            f"quality_pred AS (SELECT * FROM all_pred WHERE {FOLD} = 'val')",
            CURVE,
            """best AS (SELECT run_id, min(threshold) AS threshold FROM curve c
               WHERE f = (SELECT max(f) FROM curve d WHERE d.run_id = c.run_id) GROUP BY run_id)""",
        ],
        f"""SELECT run_id, record_id, {r6('prob_good')} AS prob_good,
        CASE WHEN prob_good >= threshold THEN 1e0 ELSE 0e0 END AS y_pred
        FROM all_pred JOIN best USING (run_id) WHERE {FOLD} = 'test'""",
    ),
)
def frozen_threshold(spark, sf):
    """A threshold chosen on one fold, applied to the other."""
    rows = quality_predictions(spark, sf).withColumn(
        "fold",
        F.when(F.substring(seeded_hash(3, F.col("record_id")), 1, 1) < "8", "val").otherwise("test"),
    )
    chosen = metrics.best_threshold(rows.where("fold = 'val'")).drop("macro_f1")
    return (
        join_dimension(rows.where("fold = 'test'"), chosen, "run_id")
        .select("run_id", "record_id", "prob_good",
                decide(F.col("prob_good"), F.col("threshold")).alias("y_pred"))
    )


def _gate_sql(truth: str, decided: str, total: str) -> str:
    acc, rej = f"coalesce({decided} = 1, false)", f"NOT coalesce({decided} = 1, false)"
    return f"""count(*) AS {total}, count(*) FILTER ({acc}) AS n_accepted,
       {r6(f'1e0 * count(*) FILTER ({acc}) / count(*)')} AS accepted_fraction,
       {r6(f'1e0 * count(*) FILTER ({rej} AND {truth} = 1) / nullif(count(*) FILTER ({truth} = 1), 0)')} AS false_reject_rate,
       {r6(f'1e0 * count(*) FILTER ({acc} AND {truth} = 0) / nullif(count(*) FILTER ({truth} = 0), 0)')} AS false_accept_rate"""


@query(
    "gate_on_common_windows",
    sql(
        [QUALITY_PRED, HR_PRED],
        f"""SELECT {_gate_sql('q.y_true', 'q.y_pred', 'n_windows')},
        {r6('avg(CASE WHEN q.y_pred = 1 THEN abs(h.y_true - h.y_pred) END)')} AS mae,
        {r6('sqrt(avg(CASE WHEN q.y_pred = 1 THEN (h.y_true - h.y_pred) * (h.y_true - h.y_pred) END))')} AS rmse,
        count(*) FILTER (coalesce(q.y_pred = 1, false) AND h.y_pred IS NULL) AS n_null
        FROM quality_pred q JOIN hr_pred h USING (record_id)""",
    ),
)
def gate_on_common_windows(spark, sf):
    return gates.pipeline_report(quality_predictions(spark, sf), hr_predictions(spark, sf))


@query(
    "cascade_report",
    sql(
        [
            QUALITY_PRED,
            HR_PRED,
            """acc AS (SELECT h.* FROM hr_pred h
               WHERE h.record_id IN (SELECT record_id FROM quality_pred WHERE y_pred = 1))""",
        ],
        f"""SELECT {_gate_sql('y_true', 'y_pred', 'n_test')},
        (SELECT count(*) FROM acc) AS hr_windows_scored,
        (SELECT {r6('avg(abs(y_true - y_pred))')} FROM acc) AS mae,
        (SELECT {r6('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} FROM acc) AS rmse,
        (SELECT count(*) - count(y_pred) FROM acc) AS n_null
        FROM quality_pred""",
    ),
)
def cascade_report(spark, sf):
    return gates.cascade_report(quality_predictions(spark, sf), hr_predictions(spark, sf))


@query(
    "accepted_windows",
    sql(
        [QUALITY_PRED, HR_PRED],
        f"""SELECT record_id, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred FROM hr_pred
        WHERE record_id IN (SELECT record_id FROM quality_pred WHERE y_pred = 1)""",
    ),
)
def accepted_windows(spark, sf):
    rows = gates.accepted_windows(quality_predictions(spark, sf), hr_predictions(spark, sf))
    return rows.select("record_id", "y_true", "y_pred")


@query(
    "accepted_share",
    sql([QUALITY_PRED], f"""SELECT {r6("avg(CASE WHEN y_pred = 1 THEN 1e0 ELSE 0e0 END)")} AS accepted_fraction
    FROM quality_pred"""),
)
def accepted_share(spark, sf):
    return gates.accepted_share(quality_predictions(spark, sf))


@query(
    "scored_rows",
    sql([QUALITY_PRED], f"""SELECT run_id, record_id, y_true, y_pred, {r6('prob_good')} AS prob_good
    FROM quality_pred WHERE y_pred IS NOT NULL"""),
)
def scored_rows(spark, sf):
    return metrics.scored(quality_predictions(spark, sf)).select(
        "run_id", "record_id", "y_true", "y_pred", "prob_good"
    )


@query(
    "canonical_predictions",
    sql(
        [QUALITY_PRED],
        f"""SELECT record_id, subject_id, 'quality' AS task, CAST(y_true AS DOUBLE) AS y_true, y_pred,
        {r6('prob_good')} AS prob_good, CAST(NULL AS VARCHAR) AS raw_response,
        CAST(NULL AS VARCHAR) AS parse_status FROM quality_pred""",
    ),
)
def canonical_predictions(spark, sf):
    rows = quality_predictions(spark, sf).withColumn("quality_label", F.col("y_true"))
    return prediction_frame(rows, "quality", F.col("y_pred"), F.col("prob_good"))
