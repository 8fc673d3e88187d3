"""Best epochs: means of equal epochs do not depend on how the table is cut into tasks."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from queryset import ledger
from queryset.base import ORACLES


def test_values_are_added_in_the_order_of_the_rows(spark, tmp_path):
    draw = random.Random(7)
    rows = []
    for supplier in range(60):
        values = [draw.randrange(11) / 100 for _ in range(40)]
        for status in "FO":
            for line in range(1, 8):  # the same values in another order: equal means, sums that round differently
                rows += [(supplier, line, status, v) for v in draw.sample(values, len(values))]
    draw.shuffle(rows)
    columns = dict(zip(("l_suppkey", "l_linenumber", "l_linestatus", "l_discount"), map(list, zip(*rows))))
    (tmp_path / "lineitem.parquet").mkdir()
    lines, step = pa.table(columns), len(rows) // 8
    for i in range(8):
        pq.write_table(lines.slice(i * step, step), tmp_path / "lineitem.parquet" / f"part-{i}.parquet", row_group_size=step // 4)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(ORACLES["best_epoch"])
    names = [d[0] for d in found.description]
    want = {(r["run_id"], r["task"]): r["epoch"] for r in (dict(zip(names, row)) for row in found.fetchall())}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r["run_id"], r["task"]): r["epoch"] for r in ledger.best_epoch(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(set(want.values())) > 1 and got == want
