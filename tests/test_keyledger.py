"""Keys of batches that land one after the other."""

import shutil

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import keyledger


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keys_that_land_twice_are_found_in_their_buckets_only(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([(f"r{i}",) for i in range(40)], "record_id string")
    keyledger.land(first, ledger, "a/1", buckets=8)
    keyledger.land(spark.createDataFrame([("x1",), ("x2",)], "record_id string"), ledger, "a/2", buckets=8)
    bad = spark.createDataFrame([("r7",), ("x1",), ("new",), ("new",), (None,), (None,)], "record_id string")
    want = [(None, "no key", None), ("new", "repeated in the batch", None), ("r7", "landed before", "a/1"), ("x1", "landed before", "a/2")]
    assert found(keyledger.violations(bad, ledger, "b", buckets=8)) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="r7|x1|new"):
        keyledger.land(bad, ledger, "b", buckets=8)
    assert found(keyledger.violations(first, ledger, "a/1", buckets=8)) == []  # the same batch once more

    bucket = lambda k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(8))).first()[0]
    one = spark.createDataFrame([("r7",)], "record_id string")
    for path in (tmp_path / "ledger").glob("batch=*/bucket=*"):
        if path.name != f"bucket={bucket('r7')}":
            for file in path.glob("*.parquet"):
                file.write_bytes(b"unreadable")  # an untouched bucket is not read
            shutil.rmtree(path / "none", ignore_errors=True)
    for crc in (tmp_path / "ledger").rglob(".*.crc"):
        crc.unlink()
    assert found(keyledger.violations(one, ledger, "c", buckets=8)) == [("r7", "landed before", "a/1")]


def test_joined_batches_keep_their_keys(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    keyledger.compact(spark, ledger, ["none"])
    for name, keys in (("a", ["1", "2"]), ("b", ["3"]), ("c", ["4"])):
        keyledger.land(spark.createDataFrame([(k,) for k in keys], "record_id string"), ledger, name)
    keyledger.compact(spark, ledger, ["a"])
    keyledger.compact(spark, ledger, ["b"])
    assert sorted(p.name for p in (tmp_path / "ledger").glob("batch=*")) == ["batch=all", "batch=c"]
    every = spark.createDataFrame([(k,) for k in "12345"], "record_id string")
    assert found(keyledger.violations(every, ledger, "d")) == [(k, "landed before", b) for k, b in zip("1234", "aabc")]
    assert found(keyledger.violations(every.where("record_id < 3"), ledger, "a")) == []
    with pytest.raises(ValueError):
        keyledger.record(every, ledger, keyledger.ALL)
