"""Table schemas. Column names and value domains are fixed by the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG, REAL, FLAG = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)
TEXTS, REALS = T.ArrayType(TEXT), T.ArrayType(REAL)
SERIES = T.ArrayType(T.FloatType())
MATRIX = T.ArrayType(SERIES)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# fixed values: the registry's columns, arrays standing beside the metadata
REGISTRY = table(
    record_id=TEXT, subject_id=TEXT, dataset=TEXT, quality_label=INT, hr_ref=REAL, has_acc=FLAG,
    ppg=SERIES, acc=MATRIX, measurement_site=TEXT, sex=TEXT, age=REAL, height=REAL, weight=REAL,
    activity=TEXT,
)
REGISTRY_OPTIONAL = table(has_ecg=FLAG, ecg=SERIES)

# fixed values: the canonical prediction columns
PREDICTIONS = table(
    record_id=TEXT, subject_id=TEXT, task=TEXT, y_true=REAL, y_pred=REAL, prob_good=REAL,
    raw_response=TEXT, parse_status=TEXT,
)

# a run's config differs by model, so it stays a VARIANT; metrics is the union of both tasks
METRICS = table(n=LONG, macro_f1=REAL, accuracy=REAL, roc_auc=REAL, mae=REAL, rmse=REAL)
LEDGER = table(
    run_id=TEXT, model=TEXT, task=TEXT, status=TEXT, created_at=TEXT, updated_at=TEXT,
    config=T.VariantType(), mart_dir=TEXT, device=TEXT, best_checkpoint=TEXT, metrics=METRICS,
    error=TEXT,
)

SPLIT_FILE = table(
    seed=INT, ratios=REALS, train_subjects=TEXTS, val_subjects=TEXTS, test_subjects=TEXTS,
    low_data=table(fraction=REAL, seed=INT, n_train_subjects=INT),
)
SPLIT = table(
    split_id=TEXT, subject_id=TEXT, fold=TEXT, fraction=REAL, seed=INT, n_train_subjects=INT
)

# fixed values: raw annotation and subject-info headers
ANNOTATIONS = table(ID=TEXT, Quality=INT, HR=REAL)
SUBJECT_INFO = table(**{
    "ID": TEXT, "Gender": TEXT, "Age [years]": REAL, "Height [cm]": REAL, "Weight [kg]": REAL,
    "Ear/finger": INT,
})

RAW_PPG = table(record_id=TEXT, sig_name=TEXTS, p_signal=MATRIX, reject_reason=TEXT)
WINDOW_ARRAY = table(record_id=TEXT, x=SERIES, reject_reason=TEXT)
MATRIX_ARRAY = table(record_id=TEXT, x=MATRIX, reject_reason=TEXT)

# fixed values: the domains
TASKS = ("quality", "hr")
FOLDS = ("train", "val", "test")
STATUSES = ("created", "running", "finished", "failed")
MODELS = ("trivial", "cnn1d", "baseline_features", "sigma_ppg", "opentslm")
VARIANTS = ("ppg", "ppg_acc", "ppg_acc_cov")
PARSE_STATUSES = ("ok", "invalid")
HR_RANGE = (30.0, 220.0)
