"""Scalar rules for ids, covariates, event names, run labels and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: row labels by model kind, in table order
MAIN_ORDER = (
    "Majority class",
    "Median HR",
    "Dominant-frequency HR",
    "Features + LogReg/XGBoost",
    "1D-CNN / ResNet1D",
    "OpenTSLM",
    "OpenTSLM (ECG)",
    "SIGMA-PPG",
)
EXTENDED_ROWS = ("Features + LogReg/XGBoost", "1D-CNN / ResNet1D")
# fixed values: size tags looked for in a language-model id, in this order
SIZE_TAGS = ("270m", "1b", "3b", "7b", "8b")
# fixed values: activities with strong motion
MOTION_ACTIVITIES = ("Walking", "Jogging", "Running")
MALE_TOKENS = ("M", "MALE", "1")
DASH = "—"


def subject_of(record_id: Column) -> Column:
    return F.substring(record_id, 1, 3)


def site(flag: Column) -> Column:
    return F.when(F.coalesce(flag == 1, F.lit(False)), "finger").otherwise("ear")


def event_name(raw: Column) -> Column:
    """``Walking_ENTER`` -> ``Walking``; null where nothing is left.

    A word starts behind anything but a letter, so ``2x`` becomes ``2X``.
    """
    words = F.regexp_replace(raw, "ENTER|EXIT|enter|exit|:|_", " ")
    trimmed = F.regexp_replace(words, r"(?U)^\s+|\s+$", "")
    split = F.regexp_extract_all(trimmed, F.lit(r"\p{L}+|[^\p{L} ]+"), F.lit(0))
    name = F.array_join(F.transform(split, F.initcap), "")
    return F.when(name != "", name)


def is_motion(activity: Column) -> Column:
    return activity.isin(*MOTION_ACTIVITIES)


def covariates(sex: Column, age: Column, height: Column, weight: Column, where: Column) -> Column:
    """STRUCT of the five numeric covariates; anything unreadable is 0."""

    def number(c: Column) -> Column:
        d = c.cast("string").try_cast("double")
        return F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0))

    def flag(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)

    def bare(c: Column) -> Column:
        """Without white space of any kind around it."""
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    return F.struct(
        flag(F.upper(bare(sex)).isin(*MALE_TOKENS)).alias("cov_sex_male"),
        number(age).alias("cov_age"),
        number(height).alias("cov_height"),
        number(weight).alias("cov_weight"),
        flag(F.lower(bare(where)) == "finger").alias("cov_site_finger"),
    )


def config_value(config: Column, path: str, default: str | None = None) -> Column:
    """A VARIANT config entry as text, with a default."""
    value = F.try_variant_get(config, f"$.{path}", "string")
    return value if default is None else F.coalesce(value, F.lit(default))


def llm_size(llm_id: Column) -> Column:
    llm = F.lower(F.coalesce(llm_id, F.lit("")))
    size = F.when(F.lit(False), "")
    for tag in SIZE_TAGS:
        size = size.when(llm.contains(tag), tag.upper())
    tail = F.element_at(F.split(llm, "/"), -1)
    return size.when(llm.contains("gemma"), "Gemma").when(tail != "", tail).otherwise("?")


def run_label(
    model: Column, task: Column, method: Column, llm_id: Column, ecg_init: Column
) -> Column:
    """The comparison-table label of a run, from its config entries."""
    started_on_ecg = ~F.lower(F.coalesce(ecg_init, F.lit(""))).isin("", "false", "0")
    prompted = F.concat(F.lit("OpenTSLM-"), llm_size(llm_id))
    return (
        F.when((model == "trivial") & (task == "quality"), MAIN_ORDER[0])
        .when(
            (model == "trivial")
            & F.coalesce(method == "dominant_frequency", F.lit(False)),
            MAIN_ORDER[2],
        )
        .when(model == "trivial", MAIN_ORDER[1])
        .when(model == "baseline_features", MAIN_ORDER[3])
        .when(model == "cnn1d", MAIN_ORDER[4])
        .when(model == "sigma_ppg", MAIN_ORDER[7])
        .when(
            model == "opentslm",
            F.concat(prompted, F.when(started_on_ecg, " (ECG)").otherwise("")),
        )
        .otherwise(model)
    )


def row_family(label: Column) -> Column:
    """The MAIN_ORDER row a label belongs to: sized models share one row."""
    return (
        F.when(label.startswith("OpenTSLM-") & label.endswith("(ECG)"), MAIN_ORDER[6])
        .when(label.startswith("OpenTSLM-"), MAIN_ORDER[5])
        .otherwise(label)
    )


def input_variant(config: Column) -> Column:
    return config_value(config, "input_variant", "ppg")


def primary_metric(task: Column, macro_f1: Column, mae: Column) -> Column:
    return (
        F.when(
            (task == "quality") & macro_f1.isNotNull(), F.format_string("macro_f1=%.4f", macro_f1)
        )
        .when((task == "hr") & mae.isNotNull(), F.format_string("MAE=%.3f", mae))
        .otherwise("-")
    )


def display(value: Column, digits: int = 4, missing: str = DASH) -> Column:
    return F.when(value.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", value))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def decide(prob: Column, threshold: Column | float = 0.5) -> Column:
    """1 where the score reaches the threshold, else 0; null stays null."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(prob.isNull(), None).when(prob >= limit, 1.0).otherwise(0.0)
