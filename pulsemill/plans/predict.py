"""Scoring with models that already exist."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.functions.batches import window_model, window_number
from pulsemill.functions.labels import config_value, decide, sigmoid
from pulsemill.operators import baselines, metrics
from pulsemill.operators.features import feature_table
from pulsemill.operators.records import fold_rows, prediction_frame, with_split
from pulsemill.plans import train
from pulsemill.sources.tables import load_run

MODEL_BYTES = 16 << 20
Loader = Callable[[str], Callable[[np.ndarray], np.ndarray]]


def target_rows(registry: DataFrame, split: DataFrame | None = None, fold: str = "test") -> DataFrame:
    """One fold of the registry; without a split every row is a target."""
    return registry if split is None else fold_rows(with_split(registry, split), fold)


def predict_saved(model: train.FeatureModel, target: DataFrame, threshold: float | None = None) -> DataFrame:
    """Apply a fitted baseline to another registry without refitting."""
    return train.predict(model, feature_table(target, model.variant), threshold)


def score_windows(
    windows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], column: str, task: str
) -> DataFrame:
    """Predictions of an external model over window arrays.

    ``scorer`` takes a (rows, n) matrix and returns one number per row: a logit
    for quality, a rate for HR. It runs per Arrow batch inside the tasks.
    """

    def run(matrix: np.ndarray) -> np.ndarray:
        return np.asarray(scorer(matrix), dtype=np.float64).reshape(len(matrix))

    return _from_output(windows.withColumn("_out", window_number(F.col(column), run)), task)


def score_stored(
    windows: DataFrame, load: Loader, path: str, column: str, task: str, max_bytes: int = MODEL_BYTES
) -> DataFrame:
    """Predictions of a model that stands in a shared folder.

    ``load(path)`` reads it and gives a scorer as :func:`score_windows` takes. It runs in the workers,
    once per Python process, so that nothing of the model passes through the driver or a task's
    closure; a model that changes needs another path. The scorer gets at most ``max_bytes`` of
    samples at a time. Null and empty windows get no prediction.
    """
    key = f"{load.__module__}.{load.__qualname__}|{path}"
    out = window_model(F.col(column), key, lambda: load(path), max_bytes)
    return _from_output(windows.withColumn("_out", out), task)


def _from_output(out: DataFrame, task: str) -> DataFrame:
    """Canonical predictions from the column ``_out``: logits of quality, or rates."""
    if task == "hr":
        return prediction_frame(out, "hr", F.col("_out"))
    prob = sigmoid(F.col("_out"))
    return prediction_frame(out, "quality", decide(prob), prob_good=prob)


def predict_run(
    ledger: DataFrame, run_id: str, target: DataFrame, fit_on: DataFrame | None = None,
    loaders: dict[str, Loader] | None = None, column: str = "ppg", threshold: float | None = None,
) -> DataFrame:
    """Predictions of a recorded run for other rows, from its id alone.

    A trivial run is refitted on ``fit_on``, its training rows; a feature baseline is loaded from the
    run's checkpoint; any other model needs its entry in ``loaders`` (see :func:`score_stored`), which
    is given the checkpoint. An unknown run, a run without what it needs and an unfinished run are errors.
    """
    run = load_run(ledger, run_id).select(
        "model", "task", "status", "best_checkpoint", config_value(F.col("config"), "method").alias("method")
    ).first()
    if run["status"] != "finished":
        raise ValueError(f"run {run_id} is {run['status']}, not finished")
    if run["model"] == "trivial":
        if fit_on is None:
            raise ValueError(f"run {run_id} is refitted: its training rows are needed")
        return baselines.predict_trivial(run["task"], run["method"], fit_on, target)
    if not run["best_checkpoint"]:
        raise ValueError(f"run {run_id} has no checkpoint")
    if run["model"] == "baseline_features":
        model = train.FeatureModel.load(ledger.sparkSession, run["best_checkpoint"])
        if model.task != run["task"]:
            raise ValueError(f"run {run_id} is of task {run['task']}, its checkpoint of task {model.task}")
        return predict_saved(model, target, threshold)
    if run["model"] not in (loaders or {}):
        raise ValueError(f"no way to predict with model {run['model']!r}")
    return score_stored(target, loaders[run["model"]], run["best_checkpoint"], column, run["task"])


def rerun_record(ledger: DataFrame, run_id: str, new_id: str, created_at: str, predictions: DataFrame) -> DataFrame:
    """The ledger row of such predictions: the run's model, task and settings under ``new_id``, with their metrics."""
    scores = metrics.evaluate(predictions.withColumn("run_id", F.lit(new_id)))
    scores = scores.withColumn("n", F.when(F.col("task") == "hr", F.col("n_scored")))
    fields = ledger.schema["metrics"].dataType.fields
    cells = [(F.col(f.name) if f.name in scores.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    fresh = {"run_id": F.lit(new_id), "created_at": F.lit(created_at), "metrics": scores.select(F.struct(*cells)).scalar()}
    return load_run(ledger, run_id).withColumns(fresh)
