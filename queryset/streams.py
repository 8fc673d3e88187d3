"""Operators on streams: the given tables come in the order of time, some files at a time."""

import uuid

from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.session import shared_folder
from pulsemill.streaming import windows as stream
from queryset.base import ORACLES, query, table
from queryset.series import _series

#: parts of the whole time, which come one after the other
PARTS = 3


def _in_order(rows, at: str, last) -> tuple[str, float]:
    """Write ``rows`` by parts of the time, then ``last``; the folder, and the length of a part."""
    folder = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(at), F.max(at)).first()
    span = ((high or 0) - (low or 0)) / PARTS or 1.0
    part = F.least(F.floor((F.col(at) - F.lit(low or 0)) / span), F.lit(PARTS - 1))
    for i in range(PARTS):
        rows.where(part == i).write.mode("append").parquet(folder)
    last(high or 0, span).write.mode("append").parquet(folder)
    return folder, span


def _run(out, columns: str):
    """The rows that a stream gives when all files there are have been read."""
    spark = out.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(columns).parquet(folder)


@query("stream_label_as_of", ORACLES["label_as_of"])
def stream_label_as_of(spark, sf):
    """Each observation with the marker in force when it was made, by state per subject."""
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    marker = F.col("event_type").isin("signup", "purchase")
    rows = stream.rows_of(events.where(~marker), stream.WINDOW, "at", identity="event_id", subject="user_id").unionByName(
        stream.rows_of(events.where(marker), stream.LOG, "at", label="event_type", subject="user_id"))
    ends = events.select("user_id").distinct().withColumn("at", F.lit(None).cast("double"))
    folder, span = _in_order(rows, "at", lambda high, span: stream.rows_of(ends, stream.END, "at", subject="user_id"))
    files = spark.readStream.schema(stream.INPUT).option("maxFilesPerTrigger", 32).parquet(folder)
    out = _run(stream.labelled(files, delay=span), stream.OUTPUT)
    return out.where(~F.col("late")).select(F.col("id").cast("bigint").alias("event_id"), "subject_id", F.col("label").alias("activity"))


@query("stream_daily_windows", ORACLES["daily_windows"])
def stream_daily_windows(spark, sf):
    """Days with exactly two samples, as the watermark closes them."""
    rows = _series(spark, sf).select("subject_id", "t", F.timestamp_seconds("t").alias("ts"), "value")

    def end(high, span):
        at = F.lit(high + span + 3 * 86400.0)
        return spark.range(1).select(F.lit("end").alias("subject_id"), at.alias("t"), F.timestamp_seconds(at).alias("ts"), F.lit(None).cast("double").alias("value"))

    folder, span = _in_order(rows, "t", end)
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 32).parquet(folder)
    cut = stream.timed(files, 86400.0, 2 / 86400.0, f"{int(span) + 1} seconds")
    out = _run(cut, "subject_id string, window_idx long, x array<double>")
    return out.select("subject_id", "window_idx", arrays.total(F.col("x")).alias("total"))
