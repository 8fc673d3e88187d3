"""Fitted models whose optimum SQL can reach too: every predicted value has a twin.

The features are those of a z-scored window that are more than rounding noise. The twins
solve the normal equations by elimination in a recursive CTE, take Newton steps for the
logistic regression, and try every split for the stump.
"""

import uuid

from pyspark.sql import functions as F

from pulsemill.operators.features import feature_table
from pulsemill.operators.records import fold_rows, task_rows
from pulsemill.plans import comparison, predict, train
from pulsemill.session import materialize, shared_folder
from queryset.base import query, r6, sql
from queryset.inputs import signal_registry
from queryset.ledger import LEDGER, ledger
from queryset.signals import PPG_BLOCK

SHAPE = ["ppg_min", "ppg_max", "ppg_skew", "ppg_kurtosis", "ppg_spec_centroid"]
NEWTON_STEPS = 9
DIGITS = 4  # an iterative solver stops near the optimum, not on it

BASE = f"""
base AS (
  SELECT s.record_id, s.split, s.quality_label, s.hr_ref, {', '.join(SHAPE)}
  FROM signals s JOIN ppg_time t ON s.vec_id = t.vec_id JOIN ppg_freq f ON s.vec_id = f.vec_id)"""


def _scaled_sql(label: str, rows: str) -> str:
    """The rows of a task with a label and (1, scaled features) as a list."""
    fitted = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SHAPE)
    cells = ", ".join(f"({c} - {c}_m) / {c}_s" for c in SHAPE)
    return f"""
task_rows AS (SELECT *, CAST({label} AS DOUBLE) AS y FROM base WHERE {rows}),
scaling AS (SELECT {fitted} FROM task_rows WHERE split = 'train'),
scaled AS (SELECT record_id, split, y, [1e0, {cells}] AS x FROM task_rows, scaling),
train AS (SELECT *, 5e-1 * (SELECT count(*) FROM scaled WHERE split = 'train')
                    / count(*) OVER (PARTITION BY y) AS balance FROM scaled WHERE split = 'train'),
places AS (SELECT CAST(unnest(generate_series(1, {len(SHAPE) + 1})) AS BIGINT) AS i)"""


def _solved_sql(name: str, system: str) -> str:
    """``name_x`` (x): the solution of ``system`` (i, j, v), whose last column is the right side."""
    n = len(SHAPE) + 1
    return f"""
{name}_m AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS line FROM {system} GROUP BY i)),
{name}_r(c, m) AS (
  SELECT 0, m FROM {name}_m
  UNION ALL
  SELECT c + 1, list_transform(m, lambda line, i: CASE WHEN i = c + 1
           THEN list_transform(line, lambda v: v / m[c + 1][c + 1])
           ELSE list_transform(line, lambda v, j: v - line[c + 1] / m[c + 1][c + 1] * m[c + 1][j]) END)
  FROM {name}_r WHERE c < {n}),
{name}_x AS (SELECT list_transform(m, lambda line: line[{n + 1}]) AS x FROM {name}_r WHERE c = {n})"""


def _newton_sql() -> list[str]:
    """Parameters ``beta{k}`` (b) of the penalised likelihood after k steps from zero; no penalty on the constant."""
    n = len(SHAPE) + 1
    out = [f"beta0 AS (SELECT [{', '.join(['0e0'] * n)}] AS b)"]
    for k in range(NEWTON_STEPS):
        out.append(f"""
at{k} AS (SELECT x, y, balance, b, 1e0 / (1e0 + exp(-list_dot_product(x, b))) AS p FROM train, beta{k}),
system{k} AS (
  SELECT r.i, c.i AS j, sum(balance * p * (1e0 - p) * x[r.i] * x[c.i])
         + CASE WHEN r.i = c.i AND r.i > 1 THEN 1e0 ELSE 0e0 END AS v
  FROM at{k}, places r, places c GROUP BY r.i, c.i
  UNION ALL
  SELECT i, {n + 1}, sum(balance * (p - y) * x[i]) + CASE WHEN i > 1 THEN any_value(b[i]) ELSE 0e0 END
  FROM at{k}, places GROUP BY i)""")
        out.append(_solved_sql(f"step{k}", f"system{k}"))
        out.append(f"beta{k + 1} AS (SELECT list_transform(b, lambda v, i: v - x[i]) AS b FROM beta{k}, step{k}_x)")
    return out


CHOICE = f"""
scored AS (SELECT record_id, split, y, 1e0 / (1e0 + exp(-list_dot_product(x, b))) AS p FROM scaled, beta{NEWTON_STEPS}),
grid AS (SELECT CAST(unnest(generate_series(1, 199)) AS DOUBLE) * 0.005e0 AS threshold),
swept AS (
  SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
         count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn
  FROM scored, grid WHERE split = 'val' GROUP BY threshold),
curve AS (
  SELECT threshold, (CASE WHEN 2 * tn + fp + fn = 0 THEN 0e0 ELSE 2e0 * tn / (2 * tn + fp + fn) END
          + CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END)
         / (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) AS f
  FROM swept),
chosen AS (SELECT min(threshold) AS threshold FROM curve WHERE f = (SELECT max(f) FROM curve))"""

RIDGE = f"""
system AS (
  SELECT r.i, c.i AS j, sum(x[r.i] * x[c.i]) + CASE WHEN r.i = c.i AND r.i > 1 THEN 1e0 ELSE 0e0 END AS v
  FROM train, places r, places c GROUP BY r.i, c.i
  UNION ALL SELECT i, {len(SHAPE) + 2}, sum(x[i] * y) FROM train, places GROUP BY i)"""


def _recursive(ctes: list[str], select: str) -> str:
    return sql(ctes, select).replace("WITH ", "WITH RECURSIVE ", 1)


def _shape_table(spark, sf, task):
    """The folds of a task with the features in ``SHAPE`` alone."""
    made = feature_table(task_rows(signal_registry(spark, sf), task))
    return materialize(made.select("record_id", "subject_id", "split", "quality_label", "hr_ref", *SHAPE))


@query(
    "logistic_on_shape",
    _recursive(
        [*PPG_BLOCK, BASE, _scaled_sql("quality_label", "TRUE"), *_newton_sql(), CHOICE],
        f"""SELECT record_id, y AS y_true, CASE WHEN p >= threshold THEN 1e0 ELSE 0e0 END AS y_pred,
        (ROUND(p, {DIGITS}) + 0e0) AS prob_good, {r6('threshold')} AS threshold FROM scored, chosen WHERE split = 'test'""",
    ),
)
def logistic_on_shape(spark, sf):
    """Scaler, balanced weights, fit, threshold of the validation fold, and the test fold's predictions."""
    table = _shape_table(spark, sf, "quality")
    model = train.fit(table, "quality")
    made = train.predict(model, fold_rows(table, "test"))
    return made.select(
        "record_id", "y_true", "y_pred", F.round("prob_good", DIGITS).alias("prob_good"),
        F.lit(model.threshold).alias("threshold"),
    )


@query(
    "ridge_on_shape",
    _recursive(
        [*PPG_BLOCK, BASE, _scaled_sql("hr_ref", "quality_label = 1"), RIDGE, _solved_sql("beta", "system")],
        f"""SELECT record_id, {r6('y')} AS y_true, {r6('list_dot_product(s.x, b.x)')} AS y_pred
        FROM scaled s, beta_x b WHERE split = 'test'""",
    ),
)
def ridge_on_shape(spark, sf):
    """Ridge regression of the heart rate on good windows, against the normal equations."""
    table = _shape_table(spark, sf, "hr")
    made = train.predict(train.fit(table, "hr"), fold_rows(table, "test"))
    return made.select("record_id", "y_true", "y_pred")


RERUNS = """
sources AS (SELECT model, task, arg_max(run_id, (created_at, run_id)) AS run_id FROM ledger
            WHERE status = 'finished' AND (model = 'baseline_features' AND task = 'hr' OR model = 'trivial' AND task = 'quality')
            GROUP BY model, task),
made AS (
  SELECT r.run_id, s.record_id, 'hr' AS task, y AS y_true, list_dot_product(s.x, b.x) AS y_pred
  FROM scaled s, beta_x b, sources r WHERE s.split = 'test' AND r.task = 'hr'
  UNION ALL
  SELECT r.run_id, record_id, 'quality', CAST(quality_label AS DOUBLE),
         (SELECT CAST(quality_label AS DOUBLE) FROM base WHERE split = 'train'
          GROUP BY quality_label ORDER BY count(*) DESC, quality_label LIMIT 1)
  FROM base, sources r WHERE split = 'test' AND r.task = 'quality')"""
RERUN_CTES = [
    *PPG_BLOCK, BASE, _scaled_sql("hr_ref", "quality_label = 1"), RIDGE, _solved_sql("beta", "system"), LEDGER, RERUNS,
]


def _reruns(spark, sf):
    """The newest feature run of the heart rate, with a stored model, and the newest trivial quality run, run again."""
    base = signal_registry(spark, sf)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    train.fit(_shape_table(spark, sf, "hr"), "hr").save(spark, path)
    runs = ledger(spark, sf).withColumn("best_checkpoint", F.when(F.col("model") == "baseline_features", path))
    newest = comparison.latest_finished(runs.drop("config"), ["model", "task"])
    for model, task in (("baseline_features", "hr"), ("trivial", "quality")):
        run_id = newest.where((F.col("model") == model) & (F.col("task") == task)).first()["run_id"]
        rows = task_rows(base, task)
        yield runs, run_id, predict.predict_run(runs, run_id, fold_rows(rows, "test"), fold_rows(rows, "train"))


@query(
    "rerun_predictions",
    _recursive(RERUN_CTES, f"SELECT run_id, record_id, task, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred FROM made"),
)
def rerun_predictions(spark, sf):
    """Predictions of recorded runs from their ids: one loads its model, the other is refitted."""
    (_, a, first), (_, b, second) = _reruns(spark, sf)
    both = first.withColumn("run_id", F.lit(a)).unionByName(second.withColumn("run_id", F.lit(b)))
    return both.select("run_id", "record_id", "task", "y_true", "y_pred")


@query(
    "rerun_records",
    _recursive(
        RERUN_CTES,
        f"""SELECT 'again_' || any_value(run_id) AS run_id, task, 'finished' AS status,
        CASE WHEN task = 'quality' THEN {r6('avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END)')} END AS accuracy,
        CASE WHEN task = 'hr' THEN {r6('avg(abs(y_true - y_pred))')} END AS mae,
        CASE WHEN task = 'hr' THEN {r6('sqrt(avg(pow(y_true - y_pred, 2)))')} END AS rmse FROM made GROUP BY task""",
    ),
)
def rerun_records(spark, sf):
    """The ledger rows of runs that were run again, with their own metrics."""
    out = None
    for runs, run_id, made in _reruns(spark, sf):
        row = predict.rerun_record(runs, run_id, f"again_{run_id}", "2030-01-01", made)
        out = row if out is None else out.unionByName(row)
    return out.select("run_id", "task", "status", "metrics.accuracy", "metrics.mae", "metrics.rmse")


# steps per unit, lowest and highest level of each feature
LEVELS = {"ppg_min": (4.0, -11.0, -7.0), "ppg_max": (4.0, 7.0, 11.0), "ppg_skew": (4.0, -2.0, 2.0)}
LEVEL_SQL = ", ".join(
    f"least(greatest(floor({c} * {step}e0), {lo}e0), {hi}e0) AS {c}" for c, (step, lo, hi) in LEVELS.items()
)
STUMP_PARTS = " UNION ALL ".join(
    f"SELECT task, record_id, split, y, {k} AS k, {c} AS level FROM levels" for k, c in enumerate(LEVELS)
)
STUMPS = f"""
levels AS (
  SELECT 'quality' AS task, record_id, split, quality_label * 2e0 - 1e0 AS y, {LEVEL_SQL} FROM base
  UNION ALL
  SELECT 'hr', record_id, split, hr_ref, {LEVEL_SQL} FROM base WHERE quality_label = 1),
cells AS ({STUMP_PARTS}),
cuts AS (SELECT DISTINCT task, k, level AS cut FROM cells WHERE split = 'train'),
sides AS (
  SELECT c.task, c.k, t.cut,
         avg(y) FILTER (level <= cut) AS below, avg(y) FILTER (level > cut) AS above,
         coalesce(count(*) FILTER (level <= cut) * var_pop(y) FILTER (level <= cut), 0e0)
         + coalesce(count(*) FILTER (level > cut) * var_pop(y) FILTER (level > cut), 0e0) AS rest
  FROM cells c JOIN cuts t ON c.task = t.task AND c.k = t.k WHERE split = 'train'
  GROUP BY c.task, c.k, t.cut HAVING count(*) FILTER (level > cut) > 0),
stumps AS (SELECT task, arg_min(k, rest) AS k, arg_min(cut, rest) AS cut, arg_min(below, rest) AS below,
                  arg_min(above, rest) AS above FROM sides GROUP BY task),
leaves AS (
  SELECT c.task, record_id, y, CASE WHEN level <= cut THEN below ELSE above END AS leaf
  FROM cells c JOIN stumps s ON c.task = s.task AND c.k = s.k WHERE split = 'test')"""


@query(
    "boosted_stumps",
    sql(
        [*PPG_BLOCK, BASE, STUMPS],
        f"""SELECT record_id, task, CASE WHEN task = 'hr' THEN {r6('y')} ELSE (y + 1e0) / 2e0 END AS y_true,
        {r6("CASE WHEN task = 'hr' THEN leaf ELSE 1e0 / (1e0 + exp(-2e0 * leaf)) END")} AS score FROM leaves""",
    ),
)
def boosted_stumps(spark, sf):
    """One boosting round of depth 1 on features in levels: the score of both tasks' test rows."""
    out = None
    for task in ("quality", "hr"):
        table = _shape_table(spark, sf, task).withColumns(
            {c: F.greatest(F.least(F.floor(F.col(c) * step).cast("double"), F.lit(hi)), F.lit(lo))
             for c, (step, lo, hi) in LEVELS.items()}
        ).drop(*[c for c in SHAPE if c not in LEVELS])
        whole = {"maxDepth": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
        model = train.fit(table, task, kind="trees", rounds=1, trees=whole)
        made = train.predict(model, fold_rows(table, "test"))
        score = F.col("prob_good") if task == "quality" else F.col("y_pred")
        part = made.select("record_id", "task", "y_true", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
