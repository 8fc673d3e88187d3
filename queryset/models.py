"""Baselines: trivial statistics, MLlib models, external scorers."""

import uuid

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pulsemill.operators import baselines
from pulsemill.operators.features import feature_table
from pulsemill.operators.records import fold_rows, task_rows, with_split
from pulsemill.plans import predict, train
from pulsemill.session import materialize, shared_folder
from pulsemill.sources.lazy import opened
from queryset.base import query, r6, sql
from queryset.inputs import HASHED_SPLIT, PPG_RAW, REGISTRY, SIGNALS, hashed_split, registry, signal_registry

FOLDS = """
folds AS (SELECT r.*, s.fold AS split FROM registry r JOIN split s ON r.subject_id = s.subject_id),
fitted AS (
  SELECT (SELECT CAST(quality_label AS DOUBLE) FROM folds WHERE split = 'train' AND quality_label IS NOT NULL
          GROUP BY quality_label ORDER BY count(*) DESC, quality_label LIMIT 1) AS majority_label,
         (SELECT 1e0 * count(*) FILTER (quality_label = 1) / count(*) FROM folds WHERE split = 'train') AS prob_good,
         (SELECT median(hr_ref) FROM folds WHERE split = 'train' AND quality_label = 1) AS median_hr)"""


def _folds(spark, sf):
    rows = with_split(registry(spark, sf), hashed_split(spark, sf))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query(
    "majority_class",
    sql([REGISTRY, HASHED_SPLIT, FOLDS], f"SELECT majority_label, {r6('prob_good')} AS prob_good FROM fitted"),
)
def majority_class(spark, sf):
    return baselines.fit_majority(_folds(spark, sf)[0])


@query(
    "median_hr",
    sql([REGISTRY, HASHED_SPLIT, FOLDS], f"SELECT {r6('median_hr')} AS median_hr FROM fitted"),
)
def median_hr(spark, sf):
    return baselines.fit_median_hr(_folds(spark, sf)[0])


@query(
    "trivial_predictions",
    sql(
        [REGISTRY, HASHED_SPLIT, FOLDS],
        f"""SELECT record_id, subject_id, 'quality' AS task, CAST(quality_label AS DOUBLE) AS y_true,
        majority_label AS y_pred, {r6('prob_good')} AS prob_good FROM folds, fitted WHERE split = 'test'
        UNION ALL
        SELECT record_id, subject_id, 'hr' AS task, {r6('hr_ref')} AS y_true, {r6('median_hr')} AS y_pred,
        CAST(NULL AS DOUBLE) AS prob_good FROM folds, fitted WHERE split = 'test'""",
    ),
)
def trivial_predictions(spark, sf):
    """Both trivial statistics refitted on the training fold and given to the test fold."""
    fit_on, target = _folds(spark, sf)
    both = baselines.predict_trivial("quality", None, fit_on, target).unionByName(
        baselines.predict_trivial("hr", "median", fit_on, target)
    )
    return both.drop("raw_response", "parse_status")


@query("logistic_baseline")
def logistic_baseline(spark, sf):
    """Balanced logistic regression; threshold from the validation fold, test fold predicted."""
    _, made = train.train_and_predict(signal_registry(spark, sf), "quality")
    return made.drop("raw_response", "parse_status")


@query("ridge_baseline")
def ridge_baseline(spark, sf):
    """Ridge regression of the heart rate on good windows."""
    _, made = train.train_and_predict(signal_registry(spark, sf), "hr")
    return made.drop("raw_response", "parse_status", "prob_good")


@query(
    "boosted_trees_baseline",
    sql(
        [SIGNALS],
        f"""SELECT record_id, 'quality' AS task, CAST(quality_label AS DOUBLE) AS y_true, TRUE AS readable, TRUE AS beats_constant
        FROM signals WHERE has_acc AND split = 'test'
        UNION ALL SELECT record_id, 'hr', {r6('hr_ref')}, TRUE, TRUE
        FROM signals WHERE has_acc AND split = 'test' AND quality_label = 1""",
    ),
)
def boosted_trees_baseline(spark, sf):
    """Boosted trees of both tasks on the widest input variant, with all rounds.

    Beside each row of the test fold stands whether it has a prediction and whether the
    model's squared error on the training fold is below that of the fold's mean.
    """
    out = None
    for task in ("quality", "hr"):
        rows = task_rows(signal_registry(spark, sf), task, acc_subset=True)
        table = materialize(feature_table(rows, "ppg_acc_cov"))
        model = train.fit(table, task, "ppg_acc_cov", "trees")
        guess = F.col("prob_good") if task == "quality" else F.col("y_pred")
        seen = train.predict(model, fold_rows(table, "train")).select("y_true", guess.alias("guess"))
        error = seen.agg((F.avg(F.pow(F.col("y_true") - F.col("guess"), 2.0)) < F.var_pop("y_true")).alias("better"))
        part = train.predict(model, fold_rows(table, "test")).select(
            "record_id", "task", "y_true", F.col("y_pred").isNotNull().alias("readable"), error.scalar().alias("beats_constant")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "saved_model_predictions",
    sql([SIGNALS], """SELECT split, count(*) AS n, CAST(0 AS BIGINT) AS n_different,
        CAST(count(*) AS BIGINT) AS n_scored FROM signals GROUP BY split"""),
)
def saved_model_predictions(spark, sf):
    """A fitted model stored, loaded and applied with its tuned threshold, against the one never stored."""
    base = signal_registry(spark, sf)
    model = train.fit(materialize(feature_table(base, "ppg")), "quality")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    model.save(spark, path)
    stored = predict.predict_saved(train.FeatureModel.load(spark, path), base)
    fresh = predict.predict_saved(model, base).select(
        "record_id", F.col("y_pred").alias("other_pred"), F.col("prob_good").alias("other_prob")
    )
    met = stored.join(fresh, "record_id").join(base.select("record_id", "split"), "record_id")
    same = F.col("y_pred").eqNullSafe(F.col("other_pred")) & (F.abs(F.col("prob_good") - F.col("other_prob")) < 1e-9)
    return met.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("n_different"), F.count("prob_good").alias("n_scored")
    )


def _mean_level(windows):
    return windows.mean(axis=1) * 40.0


@query(
    "external_scorer",
    sql(
        [SIGNALS, PPG_RAW],
        f"""SELECT s.record_id, CAST(s.quality_label AS DOUBLE) AS y_true,
        CASE WHEN 1e0 / (1e0 + exp(-m.z)) >= 0.5e0 THEN 1e0 ELSE 0e0 END AS y_pred,
        {r6('1e0 / (1e0 + exp(-m.z))')} AS prob_good
        FROM signals s JOIN (SELECT vec_id, avg(x) * 40e0 AS z FROM ppg_raw GROUP BY vec_id) m ON s.vec_id = m.vec_id""",
    ),
)
def external_scorer(spark, sf):
    """A user's model over window batches; here it scores the mean level."""
    made = predict.score_windows(signal_registry(spark, sf), _mean_level, "ppg", "quality")
    return made.select("record_id", "y_true", "y_pred", "prob_good")




def _load_profile(path):
    """A linear scorer from the stored mean windows of both classes: nearer to the good one is positive."""
    fs, folder = opened(path)
    rows = sorted(pq.read_table(folder, filesystem=fs).to_pylist(), key=lambda r: (r["quality_label"], r["i"]))
    bad, good = np.array([r["mean"] for r in rows]).reshape(2, -1)

    def scorer(windows):
        return (windows - (good + bad) / 2) @ (good - bad)

    return scorer


@query(
    "stored_scorer",
    sql(
        [SIGNALS, PPG_RAW,
         """profile AS (SELECT quality_label, i, avg(x) AS mean FROM signals s JOIN ppg_raw p ON s.vec_id = p.vec_id
                        WHERE split = 'train' GROUP BY quality_label, i),
         scores AS (SELECT p.vec_id, sum((p.x - (g.mean + b.mean) / 2e0) * (g.mean - b.mean)) AS z FROM ppg_raw p
                    JOIN profile g ON g.i = p.i AND g.quality_label = 1
                    JOIN profile b ON b.i = p.i AND b.quality_label = 0 GROUP BY p.vec_id)"""],
        f"""SELECT s.record_id, CAST(s.quality_label AS DOUBLE) AS y_true,
        CASE WHEN 1e0 / (1e0 + exp(-z)) >= 0.5e0 THEN 1e0 ELSE 0e0 END AS y_pred,
        {r6('1e0 / (1e0 + exp(-z))')} AS prob_good FROM signals s JOIN scores c ON s.vec_id = c.vec_id""",
    ),
)
def stored_scorer(spark, sf):
    """A model in the shared folder, the mean training window of each class, read once by every worker process."""
    base = signal_registry(spark, sf)
    cells = base.where("split = 'train'").select("quality_label", F.posexplode("ppg").alias("i", "x"))
    profile = cells.groupBy("quality_label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    profile.coalesce(1).write.parquet(path)  # a row per class and sample position of a window
    made = predict.score_stored(base, _load_profile, path, "ppg", "quality")
    return made.select("record_id", "y_true", "y_pred", "prob_good")
