"""Feature baselines with MLlib: fit on the training fold, tune on validation, keep the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.functions.labels import decide
from pulsemill.operators.features import align, feature_names, feature_table, scale, scaler_columns
from pulsemill.operators.metrics import fitted_threshold
from pulsemill.operators.records import fold_rows, prediction_frame, target, task_rows
from pulsemill.session import materialize

# fixed values: tree depth, step, row and column sampling, and rounds per task
TREES = {"maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
ROUNDS = {"quality": 300, "hr": 400}
DEFAULT_ESTIMATOR = {"quality": "logreg", "hr": "ridge"}


@dataclass
class FeatureModel:
    """A fitted baseline: pipeline, feature order, scaling values and decision threshold."""

    task: str
    variant: str
    names: list[str]
    scaling: dict[str, float]
    threshold: float | None
    pipeline: PipelineModel

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = (self.task, self.variant, self.names, self.scaling, self.threshold)
        schema = (
            "task STRING, variant STRING, names ARRAY<STRING>, "
            "scaling MAP<STRING,DOUBLE>, threshold DOUBLE"
        )
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        s = spark.read.parquet(f"{path}/settings").first()
        pipeline = PipelineModel.load(f"{path}/pipeline")
        return cls(s["task"], s["variant"], s["names"], s["scaling"], s["threshold"], pipeline)


def label_facts() -> list[Column]:
    """Number of labels, their population std, and the number of ones."""
    one = F.count_if(F.col("label") == 1.0)
    return [F.count("label").alias("n"), F.stddev_pop("label").alias("sd"), one.alias("n_good")]


def balanced_weights(rows: DataFrame, label: str = "label", sizes: dict[float, int] | None = None) -> DataFrame:
    """Weight n / (2 * n_class) per row; ``sizes`` are the rows per class, counted if not given."""
    if sizes is None:
        sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two classes
    n, k = sum(sizes.values()), len(sizes)
    weight = F.when(F.lit(False), 0.0)
    for value, size in sizes.items():
        weight = weight.when(F.col(label) == value, n / (k * size))
    return rows.withColumn("weight", weight)


def estimator(
    task: str, kind: str, rows: DataFrame, rounds: int | None = None, trees: dict | None = None, facts=None
):
    """The MLlib estimator for ``logreg``, ``ridge`` or ``trees`` with its penalty in MLlib's scale.

    ``trees`` replaces some of the settings in ``TREES``; ``facts`` are the ``label_facts`` of the
    rows if they are known already.
    """
    if kind == "trees":
        tree = GBTClassifier if task == "quality" else GBTRegressor
        return tree(maxIter=rounds or ROUNDS[task], seed=42, **{**TREES, **(trees or {})})
    stats = facts or rows.agg(*label_facts()).first()
    if kind == "logreg":  # MLlib averages the weighted loss: C = 1 is a penalty of 1 / n
        return LogisticRegression(
            weightCol="weight", maxIter=2000, tol=1e-8, regParam=1.0 / stats["n"], standardization=False
        )
    if kind == "ridge":  # MLlib divides the penalty by the label's std
        return LinearRegression(
            solver="normal",
            regParam=stats["sd"] / stats["n"],
            elasticNetParam=0.0,
            standardization=False,
        )
    raise ValueError(f"unknown estimator {kind!r}")


def fit(
    features: DataFrame, task: str, variant: str = "ppg", kind: str | None = None,
    rounds: int | None = None, trees: dict | None = None,
) -> FeatureModel:
    """Fit on fold ``train`` of a feature table; the threshold comes from fold ``val``."""
    kind = kind or DEFAULT_ESTIMATOR[task]
    names = feature_names(features)
    labelled = features.withColumn("label", target(task)).where("label IS NOT NULL")
    train = fold_rows(labelled, "train").select("label", *names).persist()
    try:
        scaling = train.agg(*label_facts(), *scaler_columns(names)).first().asDict()
        facts = {c: scaling.pop(c) for c in ("n", "sd", "n_good")}
        if not facts["n"]:
            raise ValueError(f"{task} training fold: no rows")
        ready = scale(train, names, scaling)
        if kind == "logreg":
            classes = {0.0: facts["n"] - facts["n_good"], 1.0: facts["n_good"]}
            ready = balanced_weights(ready, sizes={c: size for c, size in classes.items() if size})
        steps = [
            VectorAssembler(inputCols=names, outputCol="features"),
            estimator(task, kind, ready, rounds, trees, facts),
        ]
        pipeline = Pipeline(stages=steps).fit(ready)
    finally:
        train.unpersist()
    model = FeatureModel(task, variant, names, scaling, None, pipeline)
    if task == "quality":
        val = score(model, fold_rows(labelled, "val"))
        model.threshold = fitted_threshold(
            val.select(F.col("label").alias("y_true"), F.col("prob_good"))
        )
    return model


def score(model: FeatureModel, features: DataFrame) -> DataFrame:
    """Add ``prob_good`` (quality) or ``y_pred`` (HR) to a feature table."""
    ready = scale(align(features, model.names), model.names, model.scaling)
    out = model.pipeline.transform(ready)
    if model.task == "hr":
        return out.withColumn("y_pred", F.col("prediction"))
    return out.withColumn("prob_good", vector_to_array("probability")[1])


def predict(
    model: FeatureModel, features: DataFrame, threshold: float | None = None
) -> DataFrame:
    """Canonical predictions; the tuned threshold unless another one is given."""
    out = score(model, features)
    if model.task == "hr":
        return prediction_frame(out, "hr", F.col("y_pred"))
    limit = threshold if threshold is not None else model.threshold
    return prediction_frame(
        out, "quality", decide(F.col("prob_good"), limit), prob_good=F.col("prob_good")
    )


def train_and_predict(
    registry: DataFrame, task: str, variant: str = "ppg", kind: str | None = None,
    acc_subset: bool = False, rounds: int | None = None,
) -> tuple[FeatureModel, DataFrame]:
    """Features, fit and test-fold predictions of a registry that carries ``split``.

    Variants with ACC are compared on the records that have it.
    """
    rows = task_rows(registry, task, acc_subset or variant != "ppg")
    features = materialize(feature_table(rows, variant))
    model = fit(features, task, variant, kind, rounds)
    return model, predict(model, fold_rows(features, "test"))
