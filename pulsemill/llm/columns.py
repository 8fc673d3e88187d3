"""Keeping a table's other columns out of an operator's way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shield(df: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with plain names for all columns but ``own``, and a function that gives a result
    its first columns back, so that no name clashes with those an operator adds."""
    to = {c: c if c in own else f"other{i}" for i, c in enumerate(df.columns)}
    plain = df.select(*(F.col(f"`{c}`").alias(name) for c, name in to.items()))
    return plain, lambda out: out.select(*(F.col(f"`{name}`").alias(c) for c, name in to.items()))
