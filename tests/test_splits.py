"""Split contract: disjoint, complete, balanced, nested, reproducible."""

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import records, splits


def registry(spark, n=50, per=4):
    rows = [(f"{s:03d}{w}", f"{s:03d}", int((s * 7 + w) % 3 > 0), ["finger", "ear"][s % 2])
            for s in range(n) for w in range(per)]
    return spark.createDataFrame(
        rows, "record_id STRING, subject_id STRING, quality_label INT, measurement_site STRING")


def folds(split):
    return {r["subject_id"]: r["fold"] for r in split.collect()}


def test_sizes_and_disjointness(spark):
    got = folds(splits.subject_split(registry(spark)))
    count = lambda f: sum(v == f for v in got.values())
    assert (count("train"), count("val"), count("test")) == (30, 10, 10)
    assert splits.overlapping_subjects(splits.subject_split(registry(spark))).isEmpty()


def test_reproducible_and_seeded(spark):
    a = folds(splits.subject_split(registry(spark)))
    b = folds(splits.subject_split(registry(spark).repartition(5)))
    c = folds(splits.subject_split(registry(spark), seed=7))
    assert a == b and a != c


def test_strata_are_spread_evenly(spark):
    reg = registry(spark, 60)
    strata = {r["subject_id"]: r["stratum"] for r in splits.subject_strata(
        reg, ["quality_label", "measurement_site"]).collect()}
    got = folds(splits.subject_split(reg))
    for stratum in set(strata.values()):
        members = [s for s in strata if strata[s] == stratum]
        tested = sum(got[s] == "test" for s in members)
        assert abs(tested - 0.2 * len(members)) <= 1


def test_booleans_are_balanced_like_numbers(spark):
    rows = [(s, i < k) for s, k in (("a", 0), ("b", 1), ("c", 3), ("d", 4)) for i in range(4)]
    got = splits.subject_strata(spark.createDataFrame(rows, "subject_id STRING, flag BOOLEAN"), ["flag"])
    assert {r["subject_id"]: r["stratum"] for r in got.collect()} == {"a": "0", "b": "0", "c": "1", "d": "1"}


def test_tiny_input_falls_back_to_a_plain_draw(spark):
    got = folds(splits.subject_split(registry(spark, 3)))
    assert sorted(got.values()) == ["test", "train", "val"]


def test_bad_arguments(spark):
    reg = registry(spark, 5)
    with pytest.raises(ValueError, match="three shares"):
        splits.subject_split(reg, (0.5, 0.2, 0.2))
    with pytest.raises(ValueError, match="at least 3"):
        splits.subject_split(reg.where("subject_id < '002'"))
    with pytest.raises(ValueError, match="missing columns"):
        splits.subject_split(reg, balance_on=["age"])
    with pytest.raises(ValueError, match="fractions"):
        splits.low_data_subsets(splits.all_test_split(reg), [0.0], [1])


def test_mode_takes_the_smallest_of_equals_and_skips_nulls(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "w"), ("b", None), ("b", None), ("b", "z"), ("c", None)], "subject_id STRING, v STRING")
    got = {r["subject_id"]: r["v"] for r in splits.subject_mode(df, "v").collect()}
    assert got == {"a": "w", "b": "z", "c": None}
    assert {r["stratum"] for r in splits.subject_strata(df, ["v"]).collect()} == {"w", "z", "na"}


def test_low_data_subsets_are_nested_prefixes(spark):
    split = splits.subject_split(registry(spark))
    made = splits.low_data_subsets(split, [0.25, 0.5, 1.0], [0, 1]).collect()
    sets = {}
    for r in made:
        sets.setdefault((r["seed"], r["fraction"]), set()).add(r["subject_id"])
    for seed in (0, 1):
        assert len(sets[seed, 0.25]) == 8 and len(sets[seed, 0.5]) == 15 and len(sets[seed, 1.0]) == 30
        assert sets[seed, 0.25] < sets[seed, 0.5] < sets[seed, 1.0]
    assert sets[0, 0.25] != sets[1, 0.25]
    assert splits.nesting_violations(splits.low_data_subsets(split, [0.25, 0.5], [0, 1])).isEmpty()


def test_low_data_splits_keep_val_and_test(spark):
    split = splits.subject_split(registry(spark))
    made = splits.low_data_splits(split, [0.5, 1.0], [3])
    counts = {(r["split_id"], r["fold"]): r["count"] for r in made.groupBy("split_id", "fold").count().collect()}
    assert counts["f50_s3", "train"] == 15 and counts["f100_s3", "train"] == 30
    assert counts["f50_s3", "val"] == counts["f100_s3", "test"] == 10


def test_uncovered_subjects_fail_the_join(spark):
    reg = registry(spark, 4)
    split = splits.all_test_split(reg).where("subject_id <> '002'")
    assert [r[0] for r in records.uncovered_subjects(reg, split).collect()] == ["002"]
    with pytest.raises(Exception, match="subject without a fold: 002"):
        records.with_split(reg, split).collect()
    whole = records.with_split(reg, splits.all_test_split(reg))
    assert records.fold_rows(whole, "test").count() == 16 and records.fold_rows(whole, "all").count() == 16


def test_leak_is_reported(spark):
    split = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "subject_id STRING, fold STRING")
    assert [tuple(r) for r in splits.overlapping_subjects(split).collect()] == [("a", "test,train")]
    parts = [split.where(F.col("fold") == f) for f in ("train", "val", "test")]
    assert splits.fold_map(*parts).count() == 3


@pytest.mark.parametrize("sizes", [(40, 25, 17), (30, 5, 3), (9, 2, 2), (6, 1)])
def test_one_ranking_gives_the_folds_of_two_draws(spark, sizes):
    """Strata that both draws spread over, that one does, and that none does."""
    rows = [(f"s{stratum}_{i}", f"k{stratum}", "ear") for stratum, n in enumerate(sizes) for i in range(n)]
    registry = spark.createDataFrame(rows, "subject_id string, kind string, measurement_site string")
    ours = {r["subject_id"]: r["fold"] for r in splits.subject_split(registry, balance_on=("kind",)).collect()}
    strata = splits.subject_strata(registry, ("kind",))
    test = {r["subject_id"] for r in splits.take_share(strata, 0.2, 42).where("taken").collect()}
    rest = strata.where(~F.col("subject_id").isin(*test))
    val = {r["subject_id"] for r in splits.take_share(rest, 0.2 / 0.8, 42).where("taken").collect()}
    assert ours == {s: "test" if s in test else "val" if s in val else "train" for s, _, _ in rows}


def test_many_strata_are_placed_by_a_range_sort(spark, monkeypatch):
    sizes = spark.createDataFrame([(f"s{i}", 2 + i % 7) for i in range(50)], "stratum string, m long")
    seen = splits._seen(sizes)
    few = {r["stratum"]: r["quota"] for r in splits._quotas(sizes, seen, 61).collect()}
    monkeypatch.setattr(splits, "PLACED_AT_ONCE", 10)
    many = {r["stratum"]: r["quota"] for r in splits._quotas(sizes, seen, 61).collect()}
    assert few == many and sum(few.values()) == 61
