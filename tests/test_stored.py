"""Array files read by their headers, and joins of tables in buckets."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.sources import buckets, lazy


class Counting(io.BytesIO):
    n = 0

    def read(self, size=-1):
        out = super().read(size)
        self.n += len(out)
        return out


def as_file(array, **options):
    buffer = io.BytesIO()
    np.save(buffer, array, **options)
    return buffer.getvalue()


@pytest.mark.parametrize("array, problem", [
    (np.zeros((1000, 3)), "expected shape"), (np.zeros(999), "expected shape"), (np.array(["a"] * 1000), "expected numbers"),
    (np.zeros(1000, complex), "expected numbers"),
])
def test_wrong_arrays_are_rejected_by_their_first_bytes(array, problem):
    content = as_file(array)
    source = Counting(content)
    with pytest.raises(ValueError, match=problem):
        lazy.samples(source, len(content), (1000,))
    assert source.n < 200


def test_short_files_are_rejected_by_their_length():
    content = as_file(np.arange(1000.0))
    source = Counting(content[:-1])
    with pytest.raises(ValueError, match="bytes of samples"):
        lazy.samples(source, len(content) - 1, None)
    assert source.n < 200
    with pytest.raises(ValueError, match="bytes of samples"):
        lazy.samples(Counting(content[:-1]), None, None)


@pytest.mark.parametrize("array", [
    np.arange(6.0).reshape(2, 3), np.asfortranarray(np.arange(6).reshape(2, 3)), np.zeros(0), np.array(3.5), np.arange(5, dtype=">i2"), np.array([True]),
])
def test_arrays_come_in_row_order(array):
    content = as_file(array)
    shape, x = lazy.samples(io.BytesIO(content), len(content), None)
    assert shape == array.shape and x.dtype == np.float32 and x.tolist() == array.ravel().astype(np.float32).tolist()


def test_files_of_a_folder(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    for name, content in {"a": as_file(np.arange(4.0)), "b c": as_file(np.zeros((2, 2))), "empty": b"", "text": b"no array at all", "short": as_file(np.arange(4.0))[:-3]}.items():
        (folder / f"{name}.npy").write_bytes(content)
    np.savez(folder / "z.npz", p_signal=np.arange(6.0).reshape(3, 2), sig_name=np.array(["a"]))
    got = {r["record_id"]: r for r in lazy.read_windows(spark, str(folder), 4).collect()}
    assert got["a"]["x"] == [0, 1, 2, 3] and got["a"]["shape"] == [4] and got["a"]["reject_reason"] is None
    assert {k for k, r in got.items() if r["reject_reason"]} == {"b c", "text", "short"} and "expected shape" in got["b c"]["reject_reason"]
    files = lazy.listed(spark, str(folder), "*.npz")
    row = lazy.read_arrays(files, (None, 2), member="p_signal").first()
    assert row["shape"] == [3, 2] and row["x"] == [0, 1, 2, 3, 4, 5]
    assert lazy.read_arrays(files, (None, 3), member="p_signal").first()["reject_reason"] == "expected shape (any, 3), got (3, 2)"
    assert "nothing" in lazy.read_arrays(files, None, member="nothing").first()["reject_reason"]
    assert "content" not in files.columns


@pytest.fixture
def saved(spark, tmp_path):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, v int")
    buckets.save(left, "some_left", "k", 8, str(tmp_path))
    buckets.save(right, "some_right", "k", 8, str(tmp_path))
    yield left, right
    for name in ("some_left", "some_right"):
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"DROP TABLE {name}_hot")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_in_buckets(spark, saved, how):
    left, right = saved
    rows = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()), key=repr)
    assert rows(buckets.join(spark, "some_left", "some_right", "k", how)) == rows(left.join(right, "k", how))
    assert sorted(buckets.read(spark, "some_left").collect(), key=repr) == sorted(left.collect(), key=repr)
    assert {r["k"] for r in spark.table("some_left_hot").select("k").distinct().collect()} == {"hot", None}
    with pytest.raises(ValueError):
        buckets.join(spark, "some_left", "some_right", "k", "full")


def test_joins_and_sums_in_buckets_move_no_rows(spark, saved):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(buckets.join(spark, "some_left", "some_right", "k"))
        assert "SortMergeJoin" in joined and "Exchange hashpartitioning" not in joined
        assert "Exchange" not in plan(spark.table("some_left").groupBy("k").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
