"""Regression predictions: errors, activities."""

from pyspark.sql import functions as F

from pulsemill.functions.labels import is_motion
from pulsemill.operators import gates, metrics
from queryset.base import query, r6, sql
from queryset.inputs import ACTIVITIES, PRICE_PRED, QUALITY_PRED, activities, price_predictions, quality_predictions

ERRORS = f"""count(y_pred) AS n, {r6('avg(abs(y_true - y_pred))')} AS mae,
{r6('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} AS rmse"""


@query(
    "hr_errors",
    sql(
        [PRICE_PRED],
        f"SELECT run_id, {ERRORS}, CAST(0 AS BIGINT) AS n_null FROM price_pred WHERE y_pred IS NOT NULL GROUP BY run_id",
    ),
)
def hr_errors(spark, sf):
    return metrics.hr_metrics(price_predictions(spark, sf))


@query(
    "activity_report",
    sql(
        [PRICE_PRED, ACTIVITIES, QUALITY_PRED,
         """joined AS (SELECT p.*, a.activity FROM price_pred p LEFT JOIN activities a
            ON p.record_id = a.record_id)"""],
        f"""SELECT 'overall' AS level, CAST(NULL AS VARCHAR) AS activity, count(*) AS n_windows, {ERRORS},
        (SELECT {r6("avg(CASE WHEN y_pred = 1 THEN 1e0 ELSE 0e0 END)")} FROM quality_pred) AS accepted_fraction FROM joined
        UNION ALL
        SELECT 'activity' AS level, activity, count(*) AS n_windows, {ERRORS}, CAST(NULL AS DOUBLE) FROM joined
        WHERE activity IS NOT NULL GROUP BY activity HAVING count(y_pred) > 0""",
    ),
)
def activity_report(spark, sf):
    return gates.activity_report(
        price_predictions(spark, sf), activities(spark, sf), quality_predictions(spark, sf)
    )


@query(
    "predictions_with_activity",
    sql(
        [PRICE_PRED, ACTIVITIES],
        """SELECT p.run_id, a.activity, count(*) AS n, count(p.y_pred) AS n_scored,
        coalesce(a.activity IN ('Walking', 'Jogging', 'Running', 'Promo'), false) AS strong_motion
        FROM price_pred p LEFT JOIN activities a ON p.record_id = a.record_id
        GROUP BY p.run_id, a.activity""",
    ),
)
def predictions_with_activity(spark, sf):
    """Window counts by activity, with the motion flag (one part type stands for Walking)."""
    renamed = activities(spark, sf)
    rows = gates.with_activity(price_predictions(spark, sf), renamed)
    walking = F.when(F.col("activity") == "Promo", "Walking").otherwise(F.col("activity"))
    return (
        rows.groupBy("run_id", "activity")
        .agg(F.count(F.lit(1)).alias("n"), F.count("y_pred").alias("n_scored"))
        .withColumn("strong_motion", F.coalesce(is_motion(walking), F.lit(False)))
    )
