"""Maths on window arrays. None of these shuffle: a window is one row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsemill.functions.batches import Matrix, window_map, window_struct

EPS = 1e-8
TIME_NAMES = (
    "mean", "std", "min", "max", "range", "median", "iqr", "rms", "skew", "kurtosis",
    "mean_abs_diff", "zero_cross",
)


# -- batch helpers ------------------------------------------------------------------------------
def standardized(x: Matrix, eps: float = EPS) -> Matrix:
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + eps)


def _scaled_pm1(x: Matrix) -> Matrix:
    lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    span = hi - lo
    flat = span < 1e-9
    return np.where(flat, 0.0, 2.0 * (x - lo) / np.where(flat, 1.0, span) - 1.0)


def time_statistics(x: Matrix, prefix: str) -> dict[str, np.ndarray]:
    """The 12 statistics of each row; skew and kurtosis are the biased ones."""
    mu, sd = x.mean(axis=1), x.std(axis=1)
    d = x - mu[:, None]
    varies = sd > 1e-8
    safe = np.where(varies, sd, 1.0)
    quarter, half, three = np.percentile(x, [25, 50, 75], axis=1)
    steps = np.diff(x, axis=1)
    crossed = np.diff(np.sign(d), axis=1) != 0
    short = x.shape[1] < 2
    out = {
        "mean": mu,
        "std": sd,
        "min": x.min(axis=1),
        "max": x.max(axis=1),
        "range": np.ptp(x, axis=1),
        "median": half,
        "iqr": three - quarter,
        "rms": np.sqrt((x * x).mean(axis=1)),
        "skew": np.where(varies, (d**3).mean(axis=1) / safe**3, 0.0),
        "kurtosis": np.where(varies, (d**4).mean(axis=1) / safe**4 - 3.0, 0.0),
        "mean_abs_diff": np.zeros(len(x)) if short else np.abs(steps).mean(axis=1),
        "zero_cross": np.zeros(len(x)) if short else crossed.mean(axis=1),
    }
    return {f"{prefix}_{name}": values for name, values in out.items()}


# -- columns ------------------------------------------------------------------------------------
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``; inside a lambda it would be redone per element."""
    return F.transform(F.array(value), body)[0]


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def zscore(x: Column, eps: float = EPS) -> Column:
    """STRUCT<x, mean, std> with x = (v - mean) / (population std + eps)."""

    def run(m: Matrix) -> dict[str, np.ndarray]:
        return {"x": standardized(m, eps), "mean": m.mean(axis=1), "std": m.std(axis=1)}

    return window_struct(x, run, ["x", "mean", "std"], arrays=("x",))


def minmax_pm1(x: Column) -> Column:
    """Scale to [-1, 1]; a flat window becomes zeros."""
    return window_map(x, _scaled_pm1)


def magnitude(axes: Column) -> Column:
    """L2 norm over exactly three axes; any other number of axes is an error."""
    return window_map(axes, lambda m: m, axes=True)


def time_features(x: Column, prefix: str) -> Column:
    """STRUCT of the 12 statistics of one window."""
    names = [f"{prefix}_{n}" for n in TIME_NAMES]
    return window_struct(x, lambda m: time_statistics(m, prefix), names)


def first_difference(x: Column) -> Column:
    n = F.size(x)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(
        F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)
    )


def invert(x: Column) -> Column:
    return F.transform(x, lambda v: -v)


def pad_cut(x: Column, length: int) -> Column:
    """Zero-pad or cut to ``length``."""
    return F.slice(F.concat(as_doubles(x), F.array_repeat(F.lit(0.0), length)), 1, length)


def patches(x: Column, size: int) -> Column:
    """Cut (n * size) samples into n rows of ``size``; other lengths are an error."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(
        F.size(x) % size == 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * size + 1, size)),
    ).otherwise(F.raise_error(F.lit(f"length is not a multiple of {size}")))


def complete(x: Column, length: int) -> Column:
    """True where the window has ``length`` samples, none null or NaN."""
    return (F.size(x) == length) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def percentile_of_sorted(s: Column, q: float) -> Column:
    """Linear-interpolation percentile of an ascending array."""
    at = (F.size(s) - 1) * F.lit(float(q))
    return let(
        F.struct(F.floor(at).cast("int").alias("i"), (at - F.floor(at)).alias("frac")),
        lambda p: F.get(s, p["i"])
        + F.coalesce(F.get(s, p["i"] + 1) - F.get(s, p["i"]), F.lit(0.0)) * p["frac"],
    )
