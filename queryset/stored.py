"""Array files read by their headers, and tables in buckets."""

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.session import shared_folder
from pulsemill.sources import buckets, lazy
from pulsemill.sources.named import write_named
from queryset.base import query, r6, sql, table
from queryset.inputs import HASHED_SPLIT, PPG_RAW, REGISTRY, SIGNALS, hashed_split, registry


def _npy_of_kind(batch: pa.Array, kind: pa.Array) -> pa.Array:
    """Arrays as files: by kind 6 of two dimensions, 7 cut short, 8 of texts."""
    out = []
    for row, k in zip(batch, kind.to_pylist()):
        buffer = io.BytesIO()
        array = np.array(row.as_py(), dtype=np.float64)
        np.save(buffer, array.reshape(2, -1) if k == 6 else array.astype("U8") if k == 8 else array)
        out.append(buffer.getvalue()[: -16 if k == 7 else None])
    return pa.array(out, type=pa.binary())


@query(
    "lazy_windows",
    sql(
        [SIGNALS, PPG_RAW, "sums AS (SELECT vec_id, sum(x * (i + 1)) AS checksum, count(*) AS n FROM ppg_raw GROUP BY vec_id)"],
        f"""SELECT s.record_id, CASE WHEN s.label NOT IN (6, 7, 8) THEN c.n END AS n,
        CASE WHEN s.label NOT IN (6, 7, 8) THEN {r6('c.checksum')} END AS checksum,
        CASE s.label WHEN 6 THEN 'expected shape (64,), got (2, 32)' WHEN 7 THEN 'expected 512 bytes of samples, got 496'
        WHEN 8 THEN 'expected numbers, got <U8' END AS reject_reason
        FROM signals s JOIN sums c ON s.vec_id = c.vec_id""",
    ),
)
def lazy_windows(spark, sf):
    """Window files of a wrong shape, type or length are rejected by their first bytes."""
    content = F.arrow_udf(_npy_of_kind, "binary")(F.col("embedding"), F.col("label"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_named(table(spark, sf, "embeddings").select(F.format_string("%d.npy", F.col("vec_id")).alias("name"), content.alias("content")), folder, whole=True)
    rows = lazy.read_windows(spark, folder, 64)
    checksum = arrays.total(F.transform(F.col("x"), lambda v, i: v.cast("double") * (i + 1)))
    return rows.select("record_id", F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), checksum.alias("checksum"), "reject_reason")


@query(
    "bucketed_registry_with_split",
    sql([REGISTRY, HASHED_SPLIT], "SELECT record_id, subject_id, fold AS split FROM registry JOIN split USING (subject_id)"),
)
def bucketed_registry_with_split(spark, sf):
    """Registry and split saved in the same buckets and joined without moving a row."""
    mark = uuid.uuid4().hex
    buckets.save(registry(spark, sf).select("record_id", "subject_id"), f"registry_{mark}", "subject_id", 16)
    buckets.save(hashed_split(spark, sf).select("subject_id", "fold"), f"split_{mark}", "subject_id", 16)
    return buckets.join(spark, f"registry_{mark}", f"split_{mark}", "subject_id").select("record_id", "subject_id", F.col("fold").alias("split"))
