"""Windows and their labels on streams: state per subject, or Spark's watermark.

``labelled`` is ``label_as_of`` as a stateful operator. Log entries and windows come in one
stream in any order; per subject the state holds the label in force, a clock (the latest time
seen less ``delay``), and the rows that are ahead of the clock. A window gets its label once
the clock has passed it. What comes behind the clock is returned as late, by name, instead of
being dropped. A row of kind ``end`` closes a subject, and so does ``idle`` of processing time
without a row: all that waits is labelled, and the label in force is kept. State grows with the
rows of ``delay`` per subject, not with the stream; one subject's rows meet in one task of each
batch, so it is the rate of a subject that counts here, not its total.

``timed`` cuts windows by event time under a watermark: a window is given out when it closes,
and only if all its samples have come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: kinds of rows in the order in which those of one time count
LOG, WINDOW, END = "0 log", "1 window", "2 end"
INPUT = T.StructType([
    T.StructField("subject_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.DoubleType()),
    T.StructField("label", T.StringType()), T.StructField("id", T.StringType()),
])
OUTPUT = "subject_id string, id string, at double, label string, late boolean, kind string"
#: clock, time and label in force, and the rows ahead of the clock
STATE = "clock double, since double, label string, kinds array<string>, ats array<double>, labels array<string>, ids array<string>"


def rows_of(df: DataFrame, kind: str, at: str, label: str | None = None, identity: str | None = None, subject: str = "subject_id") -> DataFrame:
    """Rows of one kind for ``labelled``; those without a time are left out."""
    none = F.lit(None).cast("string")
    return df.select(
        F.col(subject).cast("string").alias("subject_id"), F.lit(kind).alias("kind"), F.col(at).cast("double").alias("at"),
        (F.col(label).cast("string") if label else none).alias("label"), (F.col(identity).cast("string") if identity else none).alias("id"),
    ).where(F.col("at").isNotNull() | (F.col("kind") == END))


def labelled(rows: DataFrame, delay: float, idle: int | None = None, default: str = "unknown") -> DataFrame:
    """(subject_id, id, at, label, late, kind) of a stream of ``rows_of`` rows.

    Windows have the label of the last entry up to their time (of entries at one time the
    greatest counts; an entry without a label changes nothing), or ``default``. Late rows,
    entries among them, have the label null, or their own, and ``late``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            clock, since, label, kinds, ats, labels, ids = state.get
        else:
            clock, since, label, kinds, ats, labels, ids = float("-inf"), float("-inf"), None, [], [], [], []
        waiting = list(zip(ats, kinds, labels, ids, strict=True))
        late, closed, newest = [], state.hasTimedOut, clock + delay
        for batch in batches:
            for kind, at, own, name in zip(batch["kind"], batch["at"], batch["label"], batch["id"], strict=True):
                own, name = (None if pd.isna(x) else x for x in (own, name))
                if kind == END:
                    closed = True
                elif at < clock:
                    late.append((key[0], name, at, own, True, kind))
                else:
                    waiting.append((at, kind, own, name))
                    newest = max(newest, at)
        clock = float("inf") if closed else max(clock, newest - delay)
        waiting.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        out, ahead = [], []
        for at, kind, own, name in waiting:
            if at >= clock:
                ahead.append((at, kind, own, name))
            elif kind == LOG:
                since, label = (at, own) if own is not None else (since, label)
            else:
                out.append((key[0], name, at, default if label is None else label, False, kind))
        if closed:  # what comes later must not be older than what was closed
            clock = newest
        columns = ([r[i] for r in ahead] for i in (1, 0, 2, 3))
        state.update((clock, since, label, *columns))
        if ahead and idle is not None:
            state.setTimeoutDuration(idle)
        if out or late:
            yield pd.DataFrame(out + late, columns=["subject_id", "id", "at", "label", "late", "kind"])

    timer = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("subject_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timer)


def timed(samples: DataFrame, seconds: float, fs: float, delay: str, time: str = "ts", value: str = "value", key: str = "subject_id") -> DataFrame:
    """(key, window_idx, x): windows of ``seconds`` with all their ``seconds * fs`` samples, as they close.

    Windows are cut from the epoch. A sample later than ``delay`` behind the newest one is
    dropped by the watermark, which leaves its window incomplete and thus out. Rows without a
    value only move the watermark.
    """
    size = int(seconds * fs)
    in_time = samples.withWatermark(time, delay)
    real = F.col(value).isNotNull()
    groups = in_time.groupBy(F.window(time, f"{seconds:g} seconds").alias("window"), key).agg(
        F.count_if(real).alias("n"), F.sort_array(F.collect_list(F.when(real, F.struct(time, value)))).alias("pairs")
    )
    index = F.floor(F.unix_micros(F.col("window")["start"]) / F.lit(seconds * 1e6)).cast("long")
    return groups.where(F.col("n") == size).select(key, index.alias("window_idx"), F.transform("pairs", lambda p: p[value]).alias("x"))
