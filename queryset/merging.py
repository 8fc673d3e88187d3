"""What is kept between batches: partial aggregates of prediction files, and landed keys."""

import uuid

from pyspark.sql import functions as F

from pulsemill.operators import keyledger, partials
from pulsemill.session import shared_folder
from queryset.base import ORACLES, query, table
from queryset.quality import SUMMARY_SQL, hr_predictions, quality_predictions


def _store(predictions, parts: int = 3) -> str:
    """Predictions counted into a new store by parts, as sources that come one after the other; one comes twice."""
    store = f"{shared_folder(predictions.sparkSession)}/{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("record_id"), F.lit(parts))
    for i in [*range(parts), 0]:
        partials.add(predictions.where(part == i), store, f"part/{i}")
    return store


@query("merged_evaluation", SUMMARY_SQL)
def merged_evaluation(spark, sf):
    """The evaluation report from counts of each part."""
    quality = quality_predictions(spark, sf).drop("n_chars")
    hr = hr_predictions(spark, sf).withColumn("run_id", F.concat(F.lit("hr_"), "run_id"))  # a run has one task
    return partials.evaluate(partials.merged(spark, _store(quality.unionByName(hr))))


@query("merged_threshold_curve", ORACLES["threshold_curve"])
def merged_threshold_curve(spark, sf):
    return partials.threshold_curve(partials.merged(spark, _store(quality_predictions(spark, sf))))


@query(
    "landed_twice",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'landed before' AS problem, 'batch 0' AS origin FROM orders
    WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'repeated in the batch', NULL FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 7 = 0""",
)
def landed_twice(spark, sf):
    """Orders landed in batches: the last one repeats keys of the first, and keys of its own."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(key.cast("string").alias("record_id"), (key % 3).alias("part"), key)
    ledger = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for part in (0, 1):
        keyledger.land(orders.where(F.col("part") == part), ledger, f"batch {part}")
    own = orders.where("part = 2")
    last = own.unionByName(own.where(key % 7 == 0)).unionByName(orders.where((F.col("part") == 0) & (key % 5 == 0)))
    return keyledger.violations(last, ledger, "batch 2")
