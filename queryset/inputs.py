"""The given tables in the shape of the library's tables.

Each input exists twice: as a DataFrame and as a common table expression of the
same name, built from the same portable functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.operators.scale import seeded_hash
from queryset.base import table


def unit(key: Column) -> Column:
    """A number in [0, 1] that depends on the key only."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / F.lit(65535.0)


def unit_sql(key: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({key}), 1, 4)) AS INTEGER) AS DOUBLE) / 65535e0"


# -- quality predictions: labels are the truth, a hash mixed with the truth is the score --------
def quality_predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    key = F.col("doc_id").cast("string")
    rows = (
        table(spark, sf, "labels").join(docs, "doc_id")
        .withColumn("p", unit(key) * 0.7 + F.col("quality") * 0.3)
        .withColumn("sure", ~F.col("p").between(0.47, 0.53))
    )
    return rows.select(
        F.col("lang").alias("run_id"),
        key.alias("record_id"),
        F.col("source").alias("subject_id"),
        F.lit("quality").alias("task"),
        F.col("quality").cast("double").alias("y_true"),
        F.when(F.col("sure"), F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).alias("y_pred"),
        F.col("p").alias("prob_good"),
        F.when(F.col("sure"), "ok").otherwise("invalid").alias("parse_status"),
        "n_chars",
    )


QUALITY_PRED = f"""
labelled AS (
  SELECT l.doc_id, l.quality, d.lang, d.source, d.n_chars,
         ({unit_sql('CAST(l.doc_id AS VARCHAR)')}) * 0.7e0 + l.quality * 0.3e0 AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
quality_pred AS (
  SELECT lang AS run_id, CAST(doc_id AS VARCHAR) AS record_id, source AS subject_id,
         'quality' AS task, CAST(quality AS DOUBLE) AS y_true,
         CASE WHEN p BETWEEN 0.47e0 AND 0.53e0 THEN NULL WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END AS y_pred,
         p AS prob_good,
         CASE WHEN p BETWEEN 0.47e0 AND 0.53e0 THEN 'invalid' ELSE 'ok' END AS parse_status, n_chars
  FROM labelled)"""


# -- HR predictions of the same records: good ones only ---------------------------------------
def hr_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality_predictions(spark, sf).where("y_true = 1")
    size = F.col("n_chars") / F.lit(10.0)
    guess = F.floor(size) + F.col("prob_good") * 5.0
    return rows.select(
        "run_id", "record_id", "subject_id", F.lit("hr").alias("task"),
        size.alias("y_true"),
        F.when(F.col("prob_good") >= 0.35, guess).alias("y_pred"),
        F.lit(None).cast("double").alias("prob_good"),
        F.when(F.col("prob_good") >= 0.35, "ok").otherwise("invalid").alias("parse_status"),
    )


HR_PRED = """
hr_pred AS (
  SELECT run_id, record_id, subject_id, 'hr' AS task, n_chars / 10e0 AS y_true,
         CASE WHEN prob_good >= 0.35e0 THEN floor(n_chars / 10e0) + prob_good * 5e0 END AS y_pred,
         CAST(NULL AS DOUBLE) AS prob_good,
         CASE WHEN prob_good >= 0.35e0 THEN 'ok' ELSE 'invalid' END AS parse_status
  FROM quality_pred WHERE y_true = 1)"""


# -- a large regression file: order lines against list prices ----------------------------------
def price_predictions(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    guess = F.col("l_quantity") * F.col("p_retailprice") / 1000.0
    return lines.select(
        F.col("l_returnflag").alias("run_id"),
        F.col("l_partkey").cast("string").alias("record_id"),
        F.lit("hr").alias("task"),
        (F.col("l_extendedprice") / 1000.0).alias("y_true"),
        F.when(F.col("l_tax") < 0.075, guess).alias("y_pred"),
        F.when(F.col("l_tax") < 0.075, "ok").otherwise("invalid").alias("parse_status"),
    )


PRICE_PRED = """
price_pred AS (
  SELECT l_returnflag AS run_id, CAST(l_partkey AS VARCHAR) AS record_id, 'hr' AS task,
         l_extendedprice / 1000e0 AS y_true,
         CASE WHEN l_tax < 0.075e0 THEN l_quantity * p_retailprice / 1000e0 END AS y_pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def activities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as windows with an activity; large ones have none."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"),
        F.when(F.col("p_size") <= 40, F.initcap("p_type")).alias("activity"),
    )


ACTIVITIES = """
activities AS (
  SELECT CAST(p_partkey AS VARCHAR) AS record_id,
         CASE WHEN p_size <= 40 THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) END AS activity
  FROM part)"""


# -- registry: orders are windows, customers are subjects --------------------------------------
def registry(spark: SparkSession, sf: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.lit("orders").alias("dataset"),
        F.when(status == "F", 1).when(status == "O", 0).alias("quality_label"),
        (price / 2200.0).alias("hr_ref"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("has_acc"),
        (F.col("o_orderpriority") == "5-LOW").alias("has_ecg"),
        F.substring("o_orderpriority", 3, 20).alias("measurement_site"),
        F.when(status == "P", "").otherwise(status).alias("activity"),
    )


REGISTRY = """
registry AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_custkey AS VARCHAR) AS subject_id,
         'orders' AS dataset,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS quality_label,
         o_totalprice / 2200e0 AS hr_ref,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS has_acc,
         o_orderpriority = '5-LOW' AS has_ecg,
         substr(o_orderpriority, 3, 20) AS measurement_site,
         CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS activity
  FROM orders)"""


def hashed_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split over all customers: fold by a hash of the subject."""
    subject = F.col("c_custkey").cast("string")
    digit = F.substring(seeded_hash(7, subject), 1, 1)
    return table(spark, sf, "customer").select(
        subject.alias("subject_id"),
        F.when(digit < "a", "train").when(digit < "d", "val").otherwise("test").alias("fold"),
    )


HASHED_SPLIT = """
split AS (
  SELECT CAST(c_custkey AS VARCHAR) AS subject_id,
         CASE WHEN substr(md5('7|' || CAST(c_custkey AS VARCHAR)), 1, 1) < 'a' THEN 'train'
              WHEN substr(md5('7|' || CAST(c_custkey AS VARCHAR)), 1, 1) < 'd' THEN 'val'
              ELSE 'test' END AS fold
  FROM customer)"""


# -- sample series and event log ---------------------------------------------------------------
def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")


SAMPLES = """
placed AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, value,
         CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ms, event_type, event_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS lo,
         max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS hi
  FROM events),
samples AS (
  SELECT subject_id, (ms - lo) / CASE WHEN hi - lo > 1e6 THEN 1e3 ELSE 1e0 END AS t, idx, value
  FROM placed)"""


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups and purchases as a raw event log with ENTER / EXIT wrapping."""
    kind = F.col("event_type")
    return table(spark, sf, "events").where(kind.isin("signup", "purchase")).select(
        "user_id",
        "ts",
        F.when(kind == "signup", F.concat(F.lit("ENTER_"), kind))
        .otherwise(F.concat(kind, F.lit(":exit big 2x"))).alias("event"),
    )


MARKERS = """
marked AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ms,
         CASE event_type WHEN 'signup' THEN 'Signup' ELSE 'PurchaseBig2X' END AS activity
  FROM events WHERE event_type IN ('signup', 'purchase')),
log AS (
  SELECT subject_id, activity,
         (ms - min(ms) OVER (PARTITION BY subject_id))
         / CASE WHEN max(ms) OVER (PARTITION BY subject_id) - min(ms) OVER (PARTITION BY subject_id) > 1e6
                THEN 1e3 ELSE 1e0 END AS t
  FROM marked)"""


# -- windows: embeddings -----------------------------------------------------------------------
def signal_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as PPG windows; three 21-sample slices as the ACC axes of most rows."""
    vec, x = F.col("vec_id"), F.col("embedding")
    key = vec.cast("string")
    u = unit(key)
    axes = F.array(*[F.slice(x, 1 + 21 * i, 21) for i in range(3)])
    digit = F.substring(seeded_hash(7, F.substring(F.md5(key), 1, 2)), 1, 1)
    return table(spark, sf, "embeddings").select(
        vec,
        key.alias("record_id"),
        F.substring(F.md5(key), 1, 2).alias("subject_id"),
        (F.col("label") >= 3).cast("int").alias("quality_label"),
        (F.lit(50.5) + F.col("label") * 7.0).alias("hr_ref"),
        (u < 0.8).alias("has_acc"),
        x.alias("ppg"),
        F.when(u < 0.8, axes).alias("acc"),
        F.when(F.col("label") < 5, "finger").otherwise("ear").alias("measurement_site"),
        F.element_at(F.array(*map(F.lit, (" m ", "F", "male", "1", ""))), (F.col("label") % 5 + 1))
        .alias("sex"),
        F.when(F.col("label") != 4, F.col("label") * 4.0 + 20.0).alias("age"),
        (F.col("label") + 150.0).alias("height"),
        F.lit(None).cast("double").alias("weight"),
        F.when(digit < "a", "train").when(digit < "d", "val").otherwise("test").alias("split"),
    )


SIGNALS = f"""
sig AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS record_id, label, embedding,
         substr(md5(CAST(vec_id AS VARCHAR)), 1, 2) AS subject_id,
         CASE WHEN label >= 3 THEN 1 ELSE 0 END AS quality_label,
         50.5e0 + label * 7e0 AS hr_ref,
         ({unit_sql('CAST(vec_id AS VARCHAR)')}) < 0.8e0 AS has_acc,
         substr(md5('7|' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 2)), 1, 1) AS digit
  FROM embeddings),
signals AS (
  SELECT *, CASE WHEN digit < 'a' THEN 'train' WHEN digit < 'd' THEN 'val' ELSE 'test' END AS split
  FROM sig)"""

PPG_RAW = """
ppg_raw AS (
  SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM signals)"""

ACC_RAW = """
acc_raw AS (
  SELECT a.vec_id, a.i, sqrt(a.x * a.x + b.x * b.x + c.x * c.x) AS x
  FROM ppg_raw a
  JOIN ppg_raw b ON a.vec_id = b.vec_id AND b.i = a.i + 21
  JOIN ppg_raw c ON a.vec_id = c.vec_id AND c.i = a.i + 42
  WHERE a.i < 21)"""


def zscored_sql(p: str) -> str:
    return f"""
{p}_st AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM {p}_raw GROUP BY vec_id),
{p}_z AS (SELECT r.vec_id, r.i, (r.x - t.m) / (t.s + 1e-8) AS z, t.n
          FROM {p}_raw r JOIN {p}_st t ON r.vec_id = t.vec_id)"""


def time_sql(p: str) -> str:
    return f"""
{p}_zs AS (SELECT vec_id, avg(z) AS m, stddev_pop(z) AS s FROM {p}_z GROUP BY vec_id),
{p}_c AS (SELECT z.*, t.m, t.s, z.z - t.m AS d,
                 z.z - lag(z.z) OVER (PARTITION BY z.vec_id ORDER BY z.i) AS step,
                 sign(z.z - t.m) AS side,
                 lag(sign(z.z - t.m)) OVER (PARTITION BY z.vec_id ORDER BY z.i) AS side_before
          FROM {p}_z z JOIN {p}_zs t ON z.vec_id = t.vec_id),
{p}_time AS (
  SELECT vec_id, avg(z) AS {p}_mean, stddev_pop(z) AS {p}_std, min(z) AS {p}_min, max(z) AS {p}_max,
         max(z) - min(z) AS {p}_range, quantile_cont(z, 0.5) AS {p}_median,
         quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS {p}_iqr, sqrt(avg(z * z)) AS {p}_rms,
         avg(d * d * d) / pow(max(s), 3) AS {p}_skew,
         avg(d * d * d * d) / pow(max(s), 4) - 3e0 AS {p}_kurtosis,
         avg(abs(step)) AS {p}_mean_abs_diff,
         avg(CASE WHEN side_before IS NULL THEN NULL WHEN side <> side_before THEN 1e0 ELSE 0e0 END)
           AS {p}_zero_cross
  FROM {p}_c GROUP BY vec_id)"""


TIME_NAMES = ("mean", "std", "min", "max", "range", "median", "iqr", "rms", "skew", "kurtosis",
              "mean_abs_diff", "zero_cross")
FREQ_NAMES = ("dom_freq", "dom_freq_bpm", "band_power", "band_power_ratio", "spec_centroid",
              "spec_entropy", "total_power")


def spectrum_sql(p: str, source: str, value: str, fs: float) -> str:
    """One-sided power density of (vec_id, i, n, value) rows."""
    return f"""
{p}_mean0 AS (SELECT vec_id, avg({value}) AS m0, count(*) AS n0 FROM {source} GROUP BY vec_id),
{p}_dft AS (
  SELECT s.vec_id, k.k, max(t.n0) AS n,
         sum((s.{value} - t.m0) * cos(2e0 * pi() * k.k * s.i / t.n0)) AS re,
         sum((s.{value} - t.m0) * sin(2e0 * pi() * k.k * s.i / t.n0)) AS im
  FROM {source} s JOIN {p}_mean0 t ON s.vec_id = t.vec_id
  JOIN (SELECT CAST(unnest(generate_series(0, 200)) AS BIGINT) AS k) k ON 2 * k.k <= t.n0
  GROUP BY s.vec_id, k.k),
{p}_spec AS (
  SELECT vec_id, k, n, k * {fs}e0 / n AS f,
         (re * re + im * im) / ({fs}e0 * n) * CASE WHEN k = 0 OR 2 * k = n THEN 1e0 ELSE 2e0 END AS p
  FROM {p}_dft)"""


def freq_sql(p: str, lo: float, hi: float) -> str:
    return f"""
{p}_tot AS (
  SELECT vec_id, sum(p) + 1e-12 AS total,
         sum(CASE WHEN f BETWEEN {lo} AND {hi} THEN p ELSE 0e0 END) AS band,
         arg_max(f, CASE WHEN f BETWEEN {lo} AND {hi} THEN p END) AS peak
  FROM {p}_spec GROUP BY vec_id),
{p}_freq AS (
  SELECT s.vec_id, max(CASE WHEN band > 0 THEN peak ELSE 0e0 END) AS {p}_dom_freq,
         max(CASE WHEN band > 0 THEN peak ELSE 0e0 END) * 60e0 AS {p}_dom_freq_bpm,
         max(band) AS {p}_band_power, max(band / total) AS {p}_band_power_ratio,
         sum(s.f * s.p) / max(total) AS {p}_spec_centroid,
         -sum(CASE WHEN s.p > 0 THEN s.p / total * ln(s.p / total) ELSE 0e0 END) AS {p}_spec_entropy,
         max(total) AS {p}_total_power
  FROM {p}_spec s JOIN {p}_tot t ON s.vec_id = t.vec_id GROUP BY s.vec_id)"""


def block_sql(p: str, fs: float, lo: float, hi: float) -> list[str]:
    """All 19 features of {p}_raw as {p}_time and {p}_freq."""
    return [zscored_sql(p), time_sql(p), spectrum_sql(p, f"{p}_z", "z", fs), freq_sql(p, lo, hi)]


def feature_columns(p: str) -> list[str]:
    return [f"{p}_{n}" for n in (*TIME_NAMES, *FREQ_NAMES)]
