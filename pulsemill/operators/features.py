"""Feature tables from window arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemill.functions import labels, spectral
from pulsemill.schemas import VARIANTS

PPG_FS = 30.0
ACC_FS = 100.0


def ppg_features(df: DataFrame, column: str = "ppg", fs: float = PPG_FS) -> DataFrame:
    """Append 12 time and 7 spectral features of the z-scored window."""
    block = spectral.window_features(F.col(column), fs, "ppg", spectral.PPG_BAND)
    return df.withColumn("_block", block).select(*df.columns, "_block.*")


def acc_features(df: DataFrame, column: str = "acc", fs: float = ACC_FS) -> DataFrame:
    """The same of the acceleration magnitude; zeros where there is no signal, or ``has_acc`` says so."""
    block = spectral.window_features(F.col(column), fs, "acc", spectral.ACC_BAND, axes=True)
    out = df.withColumn("_block", block).select(*df.columns, "_block.*")
    there = F.col(column).isNotNull()
    if "has_acc" in df.columns:
        there = there & F.coalesce(F.col("has_acc"), F.lit(False))
    names = [n for n in out.columns if n.startswith("acc_") and n not in df.columns]
    return out.withColumns({n: F.coalesce(F.when(there, F.col(n)), F.lit(0.0)) for n in names})


def covariate_features(df: DataFrame) -> DataFrame:
    cov = labels.covariates(*[F.col(c) for c in ("sex", "age", "height", "weight", "measurement_site")])
    return df.withColumn("_cov", cov).select(*df.columns, "_cov.*")


def feature_table(registry: DataFrame, variant: str = "ppg") -> DataFrame:
    """Registry metadata with 19, 38 or 43 feature columns; unreadable values are 0."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}, expected one of {VARIANTS}")
    out = ppg_features(registry)
    if variant != "ppg":
        out = acc_features(out)
    if variant == "ppg_acc_cov":
        out = covariate_features(out)
    names = feature_names(out)
    clean = {n: F.coalesce(F.when(~F.isnan(n), F.col(n)), F.lit(0.0)) for n in names}
    return out.drop("ppg", "acc", "ecg").withColumns(clean)


def feature_names(table: DataFrame) -> list[str]:
    known = ("ppg_", "acc_", "cov_")
    return [f.name for f in table.schema
            if f.name.startswith(known) and f.dataType.simpleString() == "double"]


def align(table: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the trained feature columns in trained order; absent ones are 0."""
    have = set(table.columns)
    keep = [c for c in table.columns if c not in feature_names(table)]
    return table.select(
        *keep, *[F.col(n) if n in have else F.lit(0.0).alias(n) for n in names]
    )


def scaler(table: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean and population std per feature, in a single pass."""
    return table.agg(*scaler_columns(names))


def scaler_columns(names: list[str]) -> list[Column]:
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}__mean"), F.stddev_pop(n).alias(f"{n}__std")]
    return aggs


def scale(table: DataFrame, names: list[str], fitted: dict[str, float]) -> DataFrame:
    """Standardise with fitted values; a constant feature is only centred."""
    return table.withColumns(
        {
            n: (F.col(n) - F.lit(fitted[f"{n}__mean"])) / F.lit(fitted[f"{n}__std"] or 1.0)
            for n in names
        }
    )
