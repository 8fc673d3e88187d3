"""Sample series, windows and event logs from ``events``."""

from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.operators import heartbeat, windows
from pulsemill.operators.records import plausible_hr
from pulsemill.operators.scale import dense_index
from pulsemill.plans.process import watch_windows
from pulsemill.sources import watch
from queryset.base import query, r6, sql, table
from queryset.inputs import MARKERS, SAMPLES, SIGNALS, markers, samples, signal_registry

SIZE = 8
WINDOWS = f"""
windows AS (
  SELECT subject_id, idx // {SIZE} AS window_idx, count(*) AS n,
         sum(value * (idx % {SIZE} + 1)) AS checksum, avg(value) AS mean,
         min(value) AS lo, max(value) AS hi,
         sum(CASE WHEN idx % {SIZE} = 0 THEN value END) AS first_value,
         sum(CASE WHEN idx % {SIZE} = {SIZE} - 1 THEN value END) AS last_value
  FROM samples GROUP BY subject_id, idx // {SIZE} HAVING count(*) = {SIZE})"""


def _series(spark, sf, kind=None):
    rows = samples(spark, sf)
    if kind:
        rows = rows.where(F.col("event_type") == kind)
    return watch.series(rows, watch.VALUE_KEYS["ppg"], ["ts", "event_id"], key="user_id")


def _checksum(x):
    return F.aggregate(
        F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )


@query(
    "sample_series",
    sql([SAMPLES], f"SELECT subject_id, {r6('t')} AS t, idx, {r6('value')} AS value FROM samples"),
)
def sample_series(spark, sf):
    return _series(spark, sf)


@query("event_log", sql([MARKERS], f"SELECT subject_id, {r6('t')} AS t, activity FROM log"))
def event_log(spark, sf):
    return watch.event_log(markers(spark, sf), key="user_id")


@query(
    "event_log_without_exits",
    sql(
        [MARKERS.replace("IN ('signup', 'purchase')", "= 'signup'")],
        f"SELECT subject_id, {r6('t')} AS t, activity FROM log",
    ),
)
def event_log_without_exits(spark, sf):
    return watch.event_log(markers(spark, sf), keep_exits=False, key="user_id")


@query(
    "tumbling_windows",
    sql(
        [SAMPLES, WINDOWS],
        f"""SELECT format('{{}}_{{:04d}}', subject_id, window_idx) AS record_id, subject_id, window_idx,
        window_idx * 10e0 AS t0, {r6('checksum')} AS checksum, {r6('first_value')} AS first_value,
        {r6('last_value')} AS last_value FROM windows""",
    ),
)
def tumbling_windows(spark, sf):
    x = F.col("x")
    return windows.tumbling_windows(_series(spark, sf), SIZE).select(
        windows.window_id(F.col("subject_id"), F.col("window_idx")).alias("record_id"),
        "subject_id",
        "window_idx",
        windows.window_start(F.col("window_idx"), 10.0).alias("t0"),
        _checksum(x).alias("checksum"),
        F.get(x, F.lit(0)).alias("first_value"),
        F.get(x, F.lit(SIZE - 1)).alias("last_value"),
    )


@query(
    "daily_windows",
    sql(
        [SAMPLES],
        f"""SELECT subject_id, CAST(floor(t / 86400e0) AS BIGINT) AS window_idx, {r6('sum(value)')} AS total
        FROM samples GROUP BY subject_id, floor(t / 86400e0) HAVING count(*) = 2""",
    ),
)
def daily_windows(spark, sf):
    """Windows by time: days that hold exactly the two samples a 2-per-day sensor sends."""
    cut = windows.time_windows(_series(spark, sf), 86400.0, 2 / 86400.0)
    return cut.select("subject_id", "window_idx", arrays.total(F.col("x")).alias("total"))


BAD = "CASE WHEN value < 1 THEN NULL ELSE value END"


@query(
    "usable_windows",
    sql(
        [SAMPLES],
        f"""SELECT subject_id, idx // {SIZE} AS window_idx, {r6('avg(value)')} AS mean FROM samples
        GROUP BY subject_id, idx // {SIZE}
        HAVING count(*) = {SIZE} AND count({BAD}) = {SIZE}""",
    ),
)
def usable_windows(spark, sf):
    """Windows without a bad sample; values below 1 stand for sensor dropouts."""
    series = _series(spark, sf).withColumn(
        "value", F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    kept = windows.usable(windows.tumbling_windows(series, SIZE), SIZE)
    return kept.select("subject_id", "window_idx", arrays.mean(F.col("x")).alias("mean"))


def _kind_sql(kind: str, size: int) -> str:
    return f"""
{kind}_w AS (
  SELECT subject_id, idx // {size} AS window_idx, sum(value * (idx % {size} + 1)) AS checksum, avg(value) AS mean,
         sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * (idx % {size} + 1)) AS float_sum
  FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
        FROM events WHERE event_type = '{kind}')
  GROUP BY subject_id, idx // {size} HAVING count(*) = {size})"""


@query(
    "paired_windows",
    sql(
        [_kind_sql("view", 4), _kind_sql("click", 4)],
        f"""SELECT subject_id, window_idx, {r6('v.checksum')} AS ppg, {r6('c.checksum')} AS ecg
        FROM view_w v JOIN click_w c USING (subject_id, window_idx)""",
    ),
)
def paired_windows(spark, sf):
    """Two signals of a subject side by side: views and clicks in windows of four."""
    view = windows.tumbling_windows(_series(spark, sf, "view"), 4)
    click = windows.tumbling_windows(_series(spark, sf, "click"), 4)
    pairs = windows.pair_windows(view, click, ["subject_id"], ("_ppg", "_ecg"))
    return pairs.select(
        "subject_id", "window_idx", _checksum(F.col("x_ppg")).alias("ppg"),
        _checksum(F.col("x_ecg")).alias("ecg"),
    )


ASOF = """
obs AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, epoch_us(ts) / 1e6 AS at
        FROM events WHERE event_type NOT IN ('signup', 'purchase')),
marks AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, epoch_us(ts) / 1e6 AS t, max(event_type) AS activity
          FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL)"""


@query(
    "label_as_of",
    sql(
        [ASOF],
        """SELECT o.event_id, o.subject_id, coalesce(m.activity, 'unknown') AS activity
        FROM obs o ASOF LEFT JOIN marks m ON o.subject_id = m.subject_id AND o.at >= m.t""",
    ),
)
def label_as_of(spark, sf):
    """Each observation with the marker in force when it was made."""
    events = table(spark, sf, "events").withColumn(
        "at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ).withColumn("subject_id", F.col("user_id").cast("string"))
    marker = F.col("event_type").isin("signup", "purchase")
    observed = events.where(~marker).select("event_id", "subject_id", "at")
    log = events.where(marker).select(
        "subject_id", F.col("at").alias("t"), F.col("event_type").alias("activity")
    )
    return windows.label_as_of(observed, log, ["subject_id"], "at", "t", "activity").drop("at")


@query(
    "watch_registry",
    sql(
        [_kind_sql("view", 4), _kind_sql("click", 4), MARKERS,
         """rated AS (SELECT v.subject_id, v.window_idx, v.window_idx * 86400e0 AS t0, c.mean AS hr_ref, v.float_sum
            FROM view_w v JOIN click_w c USING (subject_id, window_idx) WHERE c.mean BETWEEN 30 AND 220)""",
         "marks AS (SELECT subject_id, t, max(activity) AS activity FROM log GROUP BY subject_id, t)"],
        f"""SELECT format('{{}}_{{:04d}}', r.subject_id, r.window_idx) AS record_id, r.subject_id,
        {r6('r.hr_ref')} AS hr_ref, {r6('-r.float_sum')} AS ppg,
        coalesce(m.activity, 'unknown') AS activity, 'wrist' AS measurement_site
        FROM rated r ASOF LEFT JOIN marks m ON r.subject_id = m.subject_id AND r.t0 >= m.t""",
    ),
)
def watch_registry(spark, sf):
    """Series to registry rows: window, pair, rate, invert, label by the event log.

    A view window stands for PPG, a click window for ECG, its mean for the rate.
    """
    mean = arrays.mean(F.col("x"))
    rows = watch_windows(
        _series(spark, sf, "view"), _series(spark, sf, "click"),
        watch.event_log(markers(spark, sf), key="user_id"),
        seconds=86400.0, ppg_fs=4 / 86400.0, ecg_fs=4 / 86400.0, target_fs=4 / 86400.0,
        hr=F.when(plausible_hr(mean), mean),
    )
    return rows.select(
        "record_id", "subject_id", "hr_ref", _checksum(F.col("ppg").cast("array<double>")).alias("ppg"),
        "activity", "measurement_site",
    )


@query(
    "first_difference",
    sql(
        [SAMPLES],
        f"""SELECT subject_id, idx // {SIZE} AS window_idx, {r6('avg(abs(step))')} AS mean_abs_diff
        FROM (SELECT *, value - lag(value) OVER (PARTITION BY subject_id, idx // {SIZE} ORDER BY idx) AS step
              FROM samples)
        GROUP BY subject_id, idx // {SIZE} HAVING count(*) = {SIZE}""",
    ),
)
def first_difference(spark, sf):
    step = F.transform(arrays.first_difference(F.col("x")), F.abs)
    return windows.tumbling_windows(_series(spark, sf), SIZE).select(
        "subject_id", "window_idx", arrays.mean(step).alias("mean_abs_diff")
    )


@query(
    "series_position",
    sql(
        [],
        """SELECT l_returnflag, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, count(*) AS n,
        min(idx) AS first_idx, max(idx) AS last_idx
        FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber,
              l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx FROM lineitem) GROUP BY ALL""",
    ),
)
def series_position(spark, sf):
    """Positions within three keys that hold a third of all rows each."""
    lines = table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    placed = dense_index(lines.select("l_returnflag", *order), ["l_returnflag"], order)
    return placed.groupBy("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


ECG_FS, ECG_PAD, ECG_APART = 32, 21, 8


def _filtered_sql(x: str) -> str:
    """The recursive filter over list ``x``: before its start the input stood still, the output at zero."""
    b, a = heartbeat.bandpass(float(ECG_FS))
    at = "CAST(place[1] AS BIGINT)"
    taps = [f"{float(c)!r} * {x}[greatest({at} - {k}, 1)]" for k, c in enumerate(b)]
    taps += [f"CASE WHEN {at} > {k} THEN {-float(c)!r} * done[{at} - {k}] ELSE 0e0 END" for k, c in enumerate(a) if k]
    return f"""list_reduce(list_transform(generate_series(1, len({x})), lambda i: [CAST(i AS DOUBLE)]),
        lambda done, place: list_append(done, {' + '.join(taps)}), CAST([] AS DOUBLE[]))"""


BEATS = f"""
ecg AS (SELECT record_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS n FROM signals),
padded AS (
  SELECT record_id, n, list_transform(generate_series(1 - {ECG_PAD}, n + {ECG_PAD}), lambda i:
           CASE WHEN i < 1 THEN 2e0 * x[1] - x[2 - i] WHEN i > n THEN 2e0 * x[n] - x[2 * n - i] ELSE x[i] END) AS x
  FROM ecg),
forward AS (SELECT record_id, n, list_reverse({_filtered_sql('x')}) AS x FROM padded),
both_ways AS (SELECT record_id, n, list_reverse({_filtered_sql('x')})[{ECG_PAD + 1}:{ECG_PAD} + n] AS x FROM forward),
tops AS (
  SELECT b.record_id, b.i, b.v FROM (
    SELECT record_id, i, x[i] AS v, x[i - 1] AS before, x[i + 1] AS after, list_stddev_pop(x) AS height
    FROM both_ways, generate_series(2, n - 1) g(i)) b
  WHERE v > before AND v > after AND v >= height),
kept AS (
  SELECT record_id, list_reduce(list([i] ORDER BY v DESC, i DESC), lambda found, new:
           CASE WHEN len(list_filter(found, lambda o: abs(o - new[1]) < {ECG_APART})) = 0
                THEN list_append(found, new[1]) ELSE found END, CAST([] AS BIGINT[])) AS beats
  FROM tops GROUP BY record_id),
gaps AS (
  SELECT record_id, beat - lag(beat) OVER (PARTITION BY record_id ORDER BY beat) AS gap
  FROM (SELECT record_id, unnest(beats) AS beat FROM kept)),
rates AS (SELECT record_id, count(*) AS n_beats, 60e0 / (median(gap) / {ECG_FS}e0) AS hr FROM gaps GROUP BY record_id)"""


@query(
    "ecg_heart_rate",
    sql(
        [SIGNALS, BEATS],
        f"""SELECT e.record_id, coalesce(n_beats, 0) AS n_beats,
        {r6('CASE WHEN n_beats >= 3 AND hr BETWEEN 30 AND 220 THEN hr END')} AS hr
        FROM ecg e LEFT JOIN rates r ON e.record_id = r.record_id""",
    ),
)
def ecg_heart_rate(spark, sf):
    """Band-pass, R peaks and rate of every embedding, read as two seconds at 32 Hz.

    The twin filters by the difference equation, sample by sample, and keeps the highest peaks one by one.
    """
    beats = signal_registry(spark, sf).withColumn("beats", heartbeat.r_peaks(F.col("ppg"), 32.0))
    return beats.select(
        "record_id", F.size("beats").alias("n_beats"), heartbeat.rate(F.col("beats"), 32.0).alias("hr")
    )


@query(
    "beat_rate",
    sql(
        [SAMPLES,
         f"""gaps AS (
           SELECT subject_id, idx // {SIZE} AS window_idx,
                  value - lag(value) OVER (PARTITION BY subject_id, idx // {SIZE} ORDER BY value) AS gap
           FROM samples),
         rates AS (SELECT subject_id, window_idx, 60e0 / (median(gap) / 10e0) AS hr FROM gaps
                   GROUP BY subject_id, window_idx HAVING count(gap) = {SIZE} - 1)"""],
        f"SELECT subject_id, window_idx, {r6('CASE WHEN hr BETWEEN 30 AND 220 THEN hr END')} AS hr FROM rates",
    ),
)
def beat_rate(spark, sf):
    """The rate rule on given beat positions: a window's sorted values, at 10 per second."""
    found = F.sort_array("x")
    return windows.tumbling_windows(_series(spark, sf), SIZE).select(
        "subject_id", "window_idx", heartbeat.rate(found, 10.0).alias("hr")
    )
