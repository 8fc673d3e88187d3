"""Reading free-text model answers, and writing the expected ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsemill.functions.arrays import let
from pulsemill.schemas import HR_RANGE

# fixed values: answer anchor, tokens and number pattern
ANCHOR = r"(?iU)answer\s*:\s*"
GOOD_TOKEN = "(?i)(?<![a-z0-9])(?:good|1)(?![a-z0-9])"
BAD_TOKEN = "(?i)(?<![a-z0-9])(?:bad|0)(?![a-z0-9])"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def _blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def after_anchor(text: Column) -> Column:
    """Text behind the last ``answer:``, or the whole text."""
    return F.element_at(F.split(text, ANCHOR, -1), -1)


def _parsed(value: Column) -> Column:
    return F.struct(
        value.alias("y_pred"),
        F.when(value.isNull(), "invalid").otherwise("ok").alias("parse_status"),
    )


def parse_quality(text: Column) -> Column:
    """STRUCT<y_pred, parse_status>: 1 for good, 0 for bad, null where unclear."""

    def verdict(tail: Column) -> Column:
        good, bad = tail.rlike(GOOD_TOKEN), tail.rlike(BAD_TOKEN)
        return F.when(good & ~bad, 1.0).when(bad & ~good, 0.0)

    value = F.when(_blank(text), None).otherwise(let(after_anchor(text), verdict))
    return let(value.cast("double"), _parsed)


def parse_hr(text: Column, valid_range: tuple[float, float] = HR_RANGE) -> Column:
    """STRUCT<y_pred, parse_status>: the first number in range behind the anchor.

    The whole text is tried only where nothing behind the anchor is a number.
    """
    lo, hi = valid_range

    def numbers(source: Column) -> Column:
        return F.regexp_extract_all(source, F.lit(NUMBER), F.lit(0)).cast("array<double>")

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda v: v.between(lo, hi)), F.lit(0))

    value = F.when(_blank(text), None).otherwise(
        let(
            numbers(after_anchor(text)),
            lambda tail: F.when(F.size(tail) > 0, first(tail)).otherwise(first(numbers(text))),
        )
    )
    return let(value.cast("double"), _parsed)


def quality_answer(label: Column) -> Column:
    return F.when(label == 1, "good").when(label.isNotNull(), "bad")


def hr_answer(hr: Column) -> Column:
    """Half-even rounded integer text."""
    return F.bround(hr, 0).cast("bigint").cast("string")


def text_answer(task: str, quality_label: Column, hr_ref: Column) -> Column:
    return quality_answer(quality_label) if task == "quality" else hr_answer(hr_ref)


def label_from_answer(task: str, answer: Column) -> Column:
    """The label a text answer stands for."""
    if task == "quality":
        return F.when(F.lower(F.trim(answer)) == "good", 1.0).otherwise(0.0)
    return answer.try_cast("double")
