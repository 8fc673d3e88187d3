"""Building blocks against brute force, with one key holding most of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import scale


def skewed(spark, n=3000):
    """Key 'hot' holds two thirds of the rows; order values collide, ``seq`` breaks ties."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        (F.hash("id") % 40).cast("double").alias("t"),
        F.col("id").alias("seq"),
    )


def test_dense_index_counts_every_row_once(spark, many_runs):
    df = skewed(spark)
    got = scale.dense_index(df, ["key"], ["t", "seq"]).toPandas()
    want = df.toPandas().sort_values(["key", "t", "seq"])
    want["idx"] = want.groupby("key").cumcount()
    merged = got.merge(want, on=["key", "t", "seq"], suffixes=("", "_want"))
    assert len(merged) == len(want)
    assert (merged["idx"] == merged["idx_want"]).all()


def test_sorted_runs_spread_a_hot_key(spark, many_runs):
    runs = scale.sorted_runs(skewed(spark, 20000).repartition(4), ["key"], ["t", "seq"])
    assert runs.where("key = 'hot'").select("run").distinct().count() > 1


def test_hash_rank_is_a_permutation_and_reproducible(spark):
    df = skewed(spark).select("key", F.col("seq").cast("string").alias("id"))
    ranked = scale.hash_rank(df, ["key"], 5, "id").toPandas()
    for _, part in ranked.groupby("key"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    again = scale.hash_rank(df.repartition(7), ["key"], 5, "id").toPandas()
    both = ranked.merge(again, on=["key", "id"])
    assert (both["rank_x"] == both["rank_y"]).all()


def test_exact_median(spark, many_runs):
    rng = np.random.default_rng(0)
    rows = [("even", float(v)) for v in rng.normal(size=400)]
    rows += [("odd", float(v)) for v in rng.integers(0, 5, 301)]
    rows += [("one", 3.5), ("flat", 2.0), ("flat", 2.0), ("flat", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r["g"]: r["median"] for r in scale.exact_median(df, "v", "g").collect()}
    for g in ("even", "odd", "one", "flat"):
        assert got[g] == np.median([v for k, v in rows if k == g and v is not None])


def test_median_with_an_outlier_looks_at_few_values(spark, many_runs, monkeypatch):
    """One far value squeezes all others together; still no run holds more than its part."""
    rows = spark.range(4000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) / 20 AS v").union(spark.sql("SELECT 'g', 1e15D"))
    seen = []
    plain = scale.sorted_runs

    def watched(*args):
        out = plain(*args)
        seen.append(out.groupBy("run").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(scale, "sorted_runs", watched)
    assert scale.exact_median(rows, "v", "g").first()["median"] == 100.0
    assert seen[0] < 2500


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [0.001, 0.3, 1.0])
def test_hot_split_join_equals_plain_join(spark, how, share):
    facts = skewed(spark)
    dim = facts.select("key").distinct().where("key <> 'k7'").withColumn("fold", F.upper("key"))
    got = scale.hot_split_join(facts, dim, "key", how, share).toPandas()
    want = facts.join(dim, "key", how).toPandas()
    order = ["key", "t", "seq"]
    got, want = (d.sort_values(order).reset_index(drop=True) for d in (got, want))
    assert got.equals(want[got.columns])


def test_join_dimension_checks_the_size(spark):
    facts = skewed(spark)
    dim = facts.select("key").distinct().withColumn("fold", F.lit("train"))
    assert scale.fits_broadcast(dim) and not scale.fits_broadcast(dim, 2)
    assert scale.join_dimension(facts, dim, "key", max_rows=2).count() == facts.count()


def test_hot_keys_are_bounded(spark):
    hot = [r["key"] for r in scale.hot_keys(skewed(spark), "key", 0.5).collect()]
    assert hot == ["hot"]


def test_require_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        scale.require_rows(spark.range(0), "something")
