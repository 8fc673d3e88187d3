"""Subject-wise splits: strata, folds, nested low-data subsets and their checks.

A split is a table (subject_id, fold); records follow their subject, so no person
is ever in two folds. Orders come from a seeded md5 of the subject, which every
engine and every cluster size reproduces.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.operators.scale import dense_index, exact_median, hash_rank, join_dimension
from pulsemill.schemas import FOLDS
from pulsemill.session import materialize

PLACED_AT_ONCE = 100_000  # strata ordered in one task; more are range-sorted


def subject_mode(registry: DataFrame, column: str, key: str = "subject_id") -> DataFrame:
    """Most common non-null value per subject, the smallest one on ties."""
    counts = registry.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col(column).isNotNull(), F.struct(-F.col("n"), F.col(column)))
    return counts.groupBy(key).agg(F.min_by(column, known).alias(column))


def subject_strata(registry: DataFrame, balance_on: Sequence[str]) -> DataFrame:
    """One stratum text per subject.

    Numbers and booleans: is the subject's mean above the median of all subject means. Other
    columns: the subject's mode. Parts are joined with a bar.
    """
    missing = [c for c in balance_on if c not in registry.columns]
    if missing:
        raise ValueError(f"cannot balance on missing columns {missing}")
    kinds = (T.NumericType, T.BooleanType)
    numbers = [i for i, c in enumerate(balance_on) if isinstance(registry.schema[c].dataType, kinds)]
    means = [F.avg(F.col(balance_on[i]).cast("double")).alias(f"mean{i}") for i in numbers]
    out = registry.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n"), *means)  # one scan for all of them
    if numbers:
        out = materialize(out)
    for i in numbers:
        middle = exact_median(out.select(f"mean{i}", F.lit(0).alias("everyone")), f"mean{i}", "everyone")
        above = F.col(f"mean{i}") > middle.select("median").scalar()
        out = out.withColumn(f"part{i}", F.when(above, "1").otherwise("0"))
    for i, column in enumerate(balance_on):
        if i not in numbers:
            bucket = subject_mode(registry, column).select(
                "subject_id", F.coalesce(F.col(column).cast("string"), F.lit("na")).alias(f"part{i}")
            )
            out = out.join(bucket, "subject_id", "left")
    parts = [F.col(f"part{i}") for i in range(len(balance_on))]
    return out.select("subject_id", F.concat_ws("|", *parts).alias("stratum"))


def _sizes(strata: DataFrame) -> DataFrame:
    return strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("m"))


def _seen(sizes: DataFrame):
    """One row: subjects, the smallest stratum and the number of strata, empty ones left out."""
    full = sizes.where("m > 0")
    return full.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.min("m").alias("least"), F.count("m").alias("k")).first()


def _spreads(seen, wanted: int) -> bool:
    """Is every stratum large enough to be spread over both sides of a draw?"""
    k, left = seen["k"], seen["n"] - wanted
    return k > 0 and seen["least"] >= 2 and wanted >= k and left >= k


def _quotas(sizes: DataFrame, seen, wanted: int, name: str = "quota") -> DataFrame:
    """Add each stratum's proportional number of ``wanted`` subjects, rounded by largest remainder."""
    quota = F.col("m") * F.lit(wanted) / F.lit(seen["n"])
    parts = sizes.withColumns({"_base": F.floor(quota), "_missing": F.floor(quota) - quota, "_everyone": F.lit(0)})
    spare = F.lit(wanted) - sizes.agg(F.sum(F.floor(quota))).scalar()
    if seen["k"] <= PLACED_AT_ONCE:
        place = F.row_number().over(W.partitionBy("_everyone").orderBy("_missing", "stratum")) - 1
        placed = parts.withColumn("_place", place)
    else:
        placed = dense_index(parts, ["_everyone"], ["_missing", "stratum"], "_place")
    taken = F.col("_base") + F.when(F.col("_place") < spare, 1).otherwise(0)
    return placed.select(*sizes.columns, taken.alias(name))


def take_share(strata: DataFrame, share: float, seed: int) -> DataFrame:
    """Mark ``taken`` for ceil(share * n) subjects, spread over the strata.

    Each stratum gets its proportional number, rounded by largest remainder.
    With a stratum too small to spread, the draw ignores strata.
    """
    sizes = _sizes(strata)
    seen = _seen(sizes)
    wanted = ceil(share * seen["n"])
    if not _spreads(seen, wanted):
        strata = strata.withColumn("stratum", F.lit("all"))
        sizes = _sizes(strata)
    quotas = _quotas(sizes, seen, wanted).drop("m")
    ranked = hash_rank(strata, ["stratum"], seed, "subject_id")
    return join_dimension(ranked, quotas, "stratum").select(
        "subject_id", (F.col("rank") <= F.col("quota")).alias("taken")
    )


def subject_split(
    registry: DataFrame,
    ratios: Sequence[float] = (0.6, 0.2, 0.2),
    seed: int = 42,
    balance_on: Sequence[str] = ("quality_label", "measurement_site"),
) -> DataFrame:
    """(subject_id, fold): the test fold is drawn first, then the validation fold.

    Both draws go by the same order within a stratum, so the second continues where the first
    ends: subjects are ranked once, and the quotas of both draws follow from the sizes of the
    strata. Only with strata too small to spread are there two draws over the subjects.
    """
    if len(ratios) != 3 or abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must be three shares adding up to 1, got {tuple(ratios)}")
    train, val, test = ratios
    strata = materialize(subject_strata(registry, balance_on))
    sizes = materialize(_sizes(strata))
    seen = _seen(sizes)
    if seen["n"] < 3:
        raise ValueError(f"a split needs at least 3 subjects, got {seen['n']}")
    n_test = ceil(test * seen["n"])
    if _spreads(seen, n_test):
        first = materialize(_quotas(sizes, seen, n_test, "n_test"))
        rest = first.withColumn("m", F.col("m") - F.col("n_test"))
        left = _seen(rest)
        n_val = ceil(val / (train + val) * left["n"])
        if _spreads(left, n_val):
            quotas = _quotas(rest, left, n_val, "n_val").drop("m")
            ranked = hash_rank(strata, ["stratum"], seed, "subject_id")
            fold = F.when(F.col("rank") <= F.col("n_test"), "test").when(
                F.col("rank") <= F.col("n_test") + F.col("n_val"), "val"
            )
            return join_dimension(ranked, quotas, "stratum").select("subject_id", fold.otherwise("train").alias("fold"))
    first = materialize(take_share(strata, test, seed))
    rest = strata.join(first.where("NOT taken").select("subject_id"), "subject_id", "left_semi")
    second = take_share(rest, val / (train + val), seed)
    return first.where("taken").select("subject_id", F.lit("test").alias("fold")).unionByName(
        second.select("subject_id", F.when(F.col("taken"), "val").otherwise("train").alias("fold"))
    )


def all_test_split(registry: DataFrame) -> DataFrame:
    """Every subject in the test fold, for external data."""
    return registry.select("subject_id").distinct().withColumn("fold", F.lit("test"))


def low_data_subsets(
    split: DataFrame, fractions: Sequence[float], seeds: Sequence[int]
) -> DataFrame:
    """Nested training subsets: (seed, fraction, subject_id, n_train_subjects).

    Per seed the subjects are ordered once and each fraction takes a prefix of
    max(1, round-half-even(fraction * n)); 1.0 takes all.
    """
    if any(not 0.0 < f <= 1.0 for f in fractions):
        raise ValueError(f"fractions must be in (0, 1], got {tuple(fractions)}")
    train = split.where("fold = 'train'").select("subject_id").distinct()
    n = train.agg(F.count(F.lit(1))).scalar()
    per_seed = train.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    ranked = hash_rank(per_seed, ["seed"], F.col("seed"), "subject_id")
    sized = ranked.withColumn(
        "fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    ).withColumn(
        "n_train_subjects",
        F.when(F.col("fraction") >= 1.0, n)
        .otherwise(F.greatest(F.lit(1), F.bround(F.col("fraction") * n, 0)))
        .cast("bigint"),
    )
    return sized.where(F.col("rank") <= F.col("n_train_subjects")).select(
        "seed", "fraction", "subject_id", "n_train_subjects"
    )


def low_data_splits(
    split: DataFrame, fractions: Sequence[float], seeds: Sequence[int]
) -> DataFrame:
    """Complete split tables per (fraction, seed): shrunken train, unchanged val and test."""
    sid = F.format_string(
        "f%d_s%d", F.bround(F.col("fraction") * 100, 0).cast("int"), F.col("seed")
    )
    train = low_data_subsets(split, fractions, seeds).withColumn("fold", F.lit("train"))
    sizes = train.groupBy("seed", "fraction").agg(
        F.max("n_train_subjects").alias("n_train_subjects")
    )
    grid = F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), F.lit(int(s)).alias("seed"))
        for f in fractions for s in seeds
    ])
    rest = (
        split.where("fold <> 'train'")
        .select("subject_id", "fold", F.explode(grid).alias("g"))
        .select("subject_id", "fold", "g.*")
        .join(F.broadcast(sizes), ["seed", "fraction"])  # len(fractions) * len(seeds) rows
    )
    return train.unionByName(rest).select(
        sid.alias("split_id"), "subject_id", "fold", "fraction", "seed", "n_train_subjects"
    )


def fold_map(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """One (subject_id, fold) table from three subject lists."""
    out = None
    for fold, table in zip(FOLDS, (train, val, test)):
        part = table.select("subject_id", F.lit(fold).alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out


def overlapping_subjects(split: DataFrame) -> DataFrame:
    """Subjects in more than one fold; must be empty."""
    return (
        split.groupBy("subject_id")
        .agg(F.array_sort(F.collect_set("fold")).alias("folds"))  # at most three folds
        .where(F.size("folds") > 1)
        .select("subject_id", F.array_join("folds", ",").alias("folds"))
    )


def nesting_violations(subsets: DataFrame) -> DataFrame:
    """Subjects of a smaller subset that the next larger one of the seed lacks; must be empty."""
    sizes = subsets.select("seed", "fraction").distinct()
    steps = sizes.select(
        "seed",
        "fraction",
        F.lead("fraction").over(W.partitionBy("seed").orderBy("fraction")).alias("larger"),
    ).where("larger IS NOT NULL")
    smaller = subsets.join(steps, ["seed", "fraction"]).select(
        "seed", F.col("larger").alias("fraction"), "subject_id"
    )
    return smaller.exceptAll(subsets.select("seed", "fraction", "subject_id"))


def fold_lists(split: DataFrame) -> DataFrame:
    """The sorted subject list of each fold as rows: (fold, position, subject_id)."""
    listed = split.select("fold", "subject_id").distinct()
    return dense_index(listed, ["fold"], ["subject_id"], "position")
