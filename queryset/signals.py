"""Window arrays from ``embeddings``: normalising, resampling, spectra, features."""

from pyspark.sql import functions as F

from pulsemill.functions import arrays, labels, spectral
from pulsemill.operators import baselines, features
from queryset.base import query, r6, sql
from queryset.inputs import (
    ACC_RAW,
    FREQ_NAMES,
    PPG_RAW,
    SIGNALS,
    TIME_NAMES,
    block_sql,
    feature_columns,
    freq_sql,
    signal_registry,
    spectrum_sql,
    time_sql,
    zscored_sql,
)

FS = 30.0
PPG_BLOCK = [SIGNALS, PPG_RAW, *block_sql("ppg", FS, 0.5, 3.67)]
ACC_BLOCK = [SIGNALS, PPG_RAW, ACC_RAW, *block_sql("acc", 100.0, 0.5, 10.0)]


def _cells(df, array, *keep, value="x"):
    """One row per sample of an array column."""
    return df.select("vec_id", *keep, F.posexplode_outer(array).alias("i", value))


@query(
    "window_zscore",
    sql(
        [SIGNALS, PPG_RAW, zscored_sql("ppg")],
        f"""SELECT z.vec_id, z.i, {r6('z.z')} AS x, {r6('t.m')} AS mean, {r6('t.s')} AS std
        FROM ppg_z z JOIN ppg_st t ON z.vec_id = t.vec_id""",
    ),
)
def window_zscore(spark, sf):
    rows = signal_registry(spark, sf).withColumn("z", arrays.zscore(F.col("ppg")))
    rows = rows.select("vec_id", "z.*")
    return _cells(rows.withColumnRenamed("x", "z"), "z", "mean", "std")


@query(
    "window_minmax",
    sql(
        [SIGNALS, PPG_RAW],
        f"""SELECT vec_id, i, {r6('2e0 * (x - lo) / (hi - lo) - 1e0')} AS x FROM
        (SELECT *, min(x) OVER (PARTITION BY vec_id) AS lo, max(x) OVER (PARTITION BY vec_id) AS hi FROM ppg_raw)""",
    ),
)
def window_minmax(spark, sf):
    return _cells(signal_registry(spark, sf), arrays.minmax_pm1(F.col("ppg")))


@query(
    "window_inversion",
    sql([SIGNALS, PPG_RAW], f"SELECT vec_id, i, {r6('-x')} AS x FROM ppg_raw"),
)
def window_inversion(spark, sf):
    return _cells(signal_registry(spark, sf), arrays.invert(F.col("ppg")))


RESAMPLE = """
kern AS (
  SELECT j, i, (1e0 + 2e0 * sum(cos(k * th)) + max(cos(32e0 * th))) / 64e0 AS w
  FROM (SELECT j, i, 2e0 * pi() * (j / 96e0 - i / 64e0) AS th
        FROM (SELECT CAST(unnest(generate_series(0, 95)) AS BIGINT) AS j),
             (SELECT CAST(unnest(generate_series(0, 63)) AS BIGINT) AS i)),
       (SELECT CAST(unnest(generate_series(1, 31)) AS BIGINT) AS k)
  GROUP BY j, i)"""


@query(
    "window_resample",
    sql(
        [SIGNALS, PPG_RAW, RESAMPLE],
        f"""SELECT vec_id, j AS i, {r6('sum(w * x)')} AS x FROM ppg_raw JOIN kern USING (i) GROUP BY vec_id, j""",
    ),
)
def window_resample(spark, sf):
    """64 samples at 30 Hz to 96 at 45 Hz."""
    return _cells(signal_registry(spark, sf), spectral.resample(F.col("ppg"), FS, 45.0))


@query(
    "axis_magnitude",
    sql(
        [SIGNALS, PPG_RAW, ACC_RAW],
        f"""SELECT a.vec_id, a.i, {r6('a.x')} AS x FROM acc_raw a JOIN signals s ON a.vec_id = s.vec_id
        WHERE s.has_acc""",
    ),
)
def axis_magnitude(spark, sf):
    return _cells(signal_registry(spark, sf).where("has_acc"), arrays.magnitude(F.col("acc")))


@query(
    "window_pad_cut",
    sql(
        [SIGNALS, PPG_RAW],
        f"""SELECT s.vec_id, g.i, {r6('coalesce(r.x, 0e0)')} AS x
        FROM signals s CROSS JOIN (SELECT CAST(unnest(generate_series(0, 79)) AS BIGINT) AS i) g
        LEFT JOIN ppg_raw r ON r.vec_id = s.vec_id AND r.i = g.i
        WHERE g.i < CASE WHEN s.has_acc THEN 80 ELSE 50 END""",
    ),
)
def window_pad_cut(spark, sf):
    """Windows padded to 80 samples where there is ACC, cut to 50 elsewhere."""
    x = F.when(F.col("has_acc"), arrays.pad_cut(F.col("ppg"), 80)).otherwise(
        arrays.pad_cut(F.col("ppg"), 50)
    )
    return _cells(signal_registry(spark, sf), x)


@query(
    "window_patches",
    sql([SIGNALS, PPG_RAW], f"""SELECT vec_id, i // 16 AS patch, i % 16 AS i, {r6('x')} AS x FROM ppg_raw"""),
)
def window_patches(spark, sf):
    rows = signal_registry(spark, sf).select(
        "vec_id", F.posexplode(arrays.patches(F.col("ppg"), 16)).alias("patch", "row")
    )
    return _cells(rows, "row", "patch")


@query(
    "time_features",
    sql(
        [SIGNALS, PPG_RAW, zscored_sql("ppg"), time_sql("ppg")],
        f"SELECT vec_id, {', '.join(f'{r6(f'ppg_{n}')} AS ppg_{n}' for n in TIME_NAMES)} FROM ppg_time",
    ),
)
def time_features(spark, sf):
    z = signal_registry(spark, sf).withColumn("z", arrays.zscore(F.col("ppg"))["x"])
    return z.withColumn("f", arrays.time_features(F.col("z"), "ppg")).select("vec_id", "f.*")


@query(
    "window_periodogram",
    sql(
        [SIGNALS, PPG_RAW, spectrum_sql("raw", "ppg_raw", "x", FS)],
        f"SELECT vec_id, k, {r6('f')} AS f, {r6('p')} AS p FROM raw_spec",
    ),
)
def window_periodogram(spark, sf):
    rows = signal_registry(spark, sf).withColumn("p", spectral.periodogram(F.col("ppg"), FS))
    return rows.select(
        "vec_id", F.posexplode(spectral.bins(F.col("p"), F.size("ppg"), FS)).alias("k", "b")
    ).select("vec_id", "k", "b.f", "b.p")


@query(
    "spectral_features",
    sql(
        [SIGNALS, PPG_RAW, spectrum_sql("raw", "ppg_raw", "x", FS), freq_sql("raw", 0.5, 3.67)],
        f"SELECT vec_id, {', '.join(f'{r6(f'raw_{n}')} AS raw_{n}' for n in FREQ_NAMES)} FROM raw_freq",
    ),
)
def spectral_features(spark, sf):
    rows = signal_registry(spark, sf)
    return rows.withColumn("f", spectral.freq_features(F.col("ppg"), FS, "raw")).select("vec_id", "f.*")


def _rounded(columns, default=None):
    wrap = (lambda c: f"coalesce({c}, {default})") if default else (lambda c: c)
    return ", ".join(f"{r6(wrap(c))} AS {c}" for c in columns)


PPG_COLS, ACC_COLS = feature_columns("ppg"), feature_columns("acc")


@query(
    "ppg_features",
    sql(PPG_BLOCK, f"SELECT t.vec_id, {_rounded(PPG_COLS)} FROM ppg_time t JOIN ppg_freq f ON t.vec_id = f.vec_id"),
)
def ppg_features(spark, sf):
    return features.ppg_features(signal_registry(spark, sf).select("vec_id", "ppg")).drop("ppg")


ACC_SELECT = ", ".join(
    f"{r6(f'CASE WHEN s.has_acc THEN {c} ELSE 0e0 END')} AS {c}"
    for c in ACC_COLS
)


@query(
    "acc_features",
    sql(
        ACC_BLOCK,
        f"""SELECT s.vec_id, {ACC_SELECT},
        NOT s.has_acc AS no_power FROM signals s JOIN acc_time t ON s.vec_id = t.vec_id
        JOIN acc_freq f ON s.vec_id = f.vec_id""",
    ),
)
def acc_features(spark, sf):
    """Windows without ACC have exactly no power, which rounding would not tell from a little."""
    made = features.acc_features(signal_registry(spark, sf).select("vec_id", "acc", "has_acc"))
    return made.withColumn("no_power", F.col("acc_total_power") == 0.0).drop("acc", "has_acc")


COV = """
cov AS (
  SELECT vec_id,
         CASE WHEN label % 5 IN (0, 2, 3) THEN 1e0 ELSE 0e0 END AS cov_sex_male,
         CASE WHEN label <> 4 THEN label * 4e0 + 20e0 ELSE 0e0 END AS cov_age,
         label + 150e0 AS cov_height, 0e0 AS cov_weight,
         CASE WHEN label < 5 THEN 1e0 ELSE 0e0 END AS cov_site_finger
  FROM signals)"""
COV_COLS = ["cov_sex_male", "cov_age", "cov_height", "cov_weight", "cov_site_finger"]


@query("covariate_features", sql([SIGNALS, COV], f"SELECT vec_id, {_rounded(COV_COLS)} FROM cov"))
def covariate_features(spark, sf):
    rows = features.covariate_features(signal_registry(spark, sf))
    return rows.select("vec_id", *COV_COLS)


@query(
    "feature_table",
    sql(
        [*PPG_BLOCK, ACC_RAW, *block_sql("acc", 100.0, 0.5, 10.0), COV],
        f"""SELECT s.record_id, {_rounded(PPG_COLS)}, {ACC_SELECT}, {_rounded(COV_COLS)} FROM signals s
        JOIN ppg_time pt ON s.vec_id = pt.vec_id JOIN ppg_freq pf ON s.vec_id = pf.vec_id
        JOIN acc_time t ON s.vec_id = t.vec_id JOIN acc_freq f ON s.vec_id = f.vec_id
        JOIN cov c ON s.vec_id = c.vec_id""",
    ),
)
def feature_table(spark, sf):
    """All 43 features of the widest input variant."""
    rows = features.feature_table(signal_registry(spark, sf), "ppg_acc_cov")
    return rows.select("record_id", *PPG_COLS, *ACC_COLS, *COV_COLS)


@query(
    "aligned_features",
    sql(
        PPG_BLOCK,
        f"""SELECT t.vec_id, {r6('ppg_rms')} AS ppg_rms, 0e0 AS acc_std, {r6('ppg_dom_freq')} AS ppg_dom_freq
        FROM ppg_time t JOIN ppg_freq f ON t.vec_id = f.vec_id""",
    ),
)
def aligned_features(spark, sf):
    """Features in a trained model's order; a block the table lacks is zero."""
    rows = features.ppg_features(signal_registry(spark, sf).select("vec_id", "ppg")).drop("ppg")
    return features.align(rows, ["ppg_rms", "acc_std", "ppg_dom_freq"])


@query(
    "feature_scaler",
    sql(
        PPG_BLOCK,
        "SELECT " + ", ".join(
            f"{r6(f'avg({c})')} AS {c}__mean, {r6(f'stddev_pop({c})')} AS {c}__std" for c in PPG_COLS
        ) + " FROM ppg_time t JOIN ppg_freq f ON t.vec_id = f.vec_id",
    ),
)
def feature_scaler(spark, sf):
    rows = features.ppg_features(signal_registry(spark, sf).select("vec_id", "ppg"))
    return features.scaler(rows, PPG_COLS)


@query(
    "dominant_frequency_hr",
    sql(
        [SIGNALS, PPG_RAW, spectrum_sql("raw", "ppg_raw", "x", FS)],
        f"""SELECT s.record_id, {r6('s.hr_ref')} AS y_true, {r6('''coalesce(arg_max(f * 60e0,
        CASE WHEN f BETWEEN 30e0 / 60e0 AND 220e0 / 60e0 THEN p END), 125e0)''')} AS y_pred
        FROM signals s JOIN raw_spec r ON s.vec_id = r.vec_id GROUP BY s.record_id, s.hr_ref""",
    ),
)
def dominant_frequency_hr(spark, sf):
    rows = baselines.predict_dominant_frequency(signal_registry(spark, sf))
    return rows.select("record_id", "y_true", "y_pred")


@query(
    "sigmoid_decision",
    sql(
        [SIGNALS, PPG_RAW],
        f"""SELECT vec_id, {r6('1e0 / (1e0 + exp(-logit))')} AS prob_good,
        CASE WHEN 1e0 / (1e0 + exp(-logit)) >= 0.5e0 THEN 1e0 ELSE 0e0 END AS y_pred
        FROM (SELECT vec_id, sum(x) AS logit FROM ppg_raw GROUP BY vec_id)""",
    ),
)
def sigmoid_decision(spark, sf):
    prob = labels.sigmoid(arrays.total(arrays.as_doubles(F.col("ppg"))))
    rows = signal_registry(spark, sf).withColumn("prob_good", prob)
    return rows.select("vec_id", "prob_good", labels.decide(F.col("prob_good")).alias("y_pred"))
