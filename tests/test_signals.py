"""Window maths against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.functions import arrays, spectral
from pulsemill.operators import baselines, features, heartbeat

FS = 30.0


def windows(spark, rows, kind="ARRAY<FLOAT>"):
    return spark.createDataFrame(list(enumerate(rows)), f"id INT, x {kind}")


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=300).tolist() for _ in range(5)]
    return rows + [[2.0] * 300, rng.normal(size=301).tolist(), rng.normal(size=64).tolist(), None]


def test_zscore_and_minmax(spark, mixed):
    df = windows(spark, mixed)
    z = column(df, arrays.zscore(F.col("x")))
    m = column(df, arrays.minmax_pm1(F.col("x")))
    for raw, a, b in zip(mixed, z, m):
        if raw is None:
            assert a is None and b is None
            continue
        x = np.array(raw, dtype=np.float32).astype(float)
        assert np.allclose(a["x"], (x - x.mean()) / (x.std() + 1e-8))
        assert (a["mean"], a["std"]) == pytest.approx((x.mean(), x.std()))
        span = x.max() - x.min()
        assert np.allclose(b, 0 if span < 1e-9 else 2 * (x - x.min()) / span - 1)


def test_periodogram_keeps_the_energy(spark, mixed):
    df = windows(spark, mixed[:7])
    for raw, p in zip(mixed, column(df, spectral.periodogram(F.col("x"), FS))):
        x = np.array(raw, dtype=np.float32).astype(float)
        assert len(p) == len(x) // 2 + 1
        assert sum(p) * FS / len(x) == pytest.approx(x.var(), abs=1e-9)


def direct_resample(x, length):
    """Band-limited interpolation evaluated point by point."""
    n = len(x)
    spectrum = np.fft.fft(x) / n
    out = np.zeros(length, dtype=complex)
    t = np.arange(length) / length
    for k in range(n):
        f = k if k <= n // 2 else k - n
        keep = min(n, length)
        if abs(f) < keep / 2:
            out += spectrum[k] * np.exp(2j * np.pi * f * t)
        elif 2 * abs(f) == keep and length > n:
            out += spectrum[k] * np.cos(2 * np.pi * f * t)
        elif 2 * abs(f) == keep and length < n and f > 0:
            out += 2 * (spectrum[k] * np.exp(2j * np.pi * f * t)).real
    return out.real


@pytest.mark.parametrize("n,length", [(300, 500), (250, 300), (64, 96), (100, 30), (101, 31)])
def test_resample_equals_band_limited_interpolation(spark, n, length):
    x = np.random.default_rng(n).normal(size=n)
    df = windows(spark, [x.tolist()], "ARRAY<DOUBLE>")
    got = column(df, spectral.resample(F.col("x"), n, length))[0]
    if not (length < n and min(n, length) % 2 == 0):
        assert np.allclose(got, direct_resample(x, length), atol=1e-9)
    assert len(got) == length
    tone = np.cos(2 * np.pi * 3 * np.arange(n) / n)
    slow = column(windows(spark, [tone.tolist()], "ARRAY<DOUBLE>"), spectral.resample(F.col("x"), n, length))[0]
    assert np.allclose(slow, np.cos(2 * np.pi * 3 * np.arange(length) / length), atol=1e-9)


def test_resample_same_rate_is_identity(spark):
    assert column(windows(spark, [[1.0, 2.0]]), spectral.resample(F.col("x"), FS, FS)) == [[1.0, 2.0]]


def test_time_features(spark, mixed):
    out = column(windows(spark, mixed), arrays.time_features(F.col("x"), "p"))
    for raw, f in zip(mixed, out):
        if raw is None:
            assert f is None
            continue
        x = np.array(raw, dtype=np.float32).astype(float)
        d = x - x.mean()
        assert f["p_median"] == pytest.approx(np.median(x))
        assert f["p_iqr"] == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25))
        assert f["p_rms"] == pytest.approx(np.sqrt(np.mean(x**2)))
        if x.std() > 1e-8:
            assert f["p_skew"] == pytest.approx(np.mean(d**3) / x.std() ** 3)
            assert f["p_kurtosis"] == pytest.approx(np.mean(d**4) / x.std() ** 4 - 3)
        else:
            assert (f["p_skew"], f["p_kurtosis"]) == (0.0, 0.0)
        assert f["p_zero_cross"] == pytest.approx(np.mean(np.abs(np.diff(np.sign(d))) > 0))


def test_flat_window_has_no_dominant_frequency(spark):
    f = column(windows(spark, [[0.0] * 10]), spectral.freq_features(F.col("x"), 100.0, "a", (0.5, 10.0)))[0]
    assert f["a_dom_freq"] == 0.0 and f["a_total_power"] == 1e-12 and f["a_spec_entropy"] == 0.0


@pytest.mark.parametrize("bpm", [45, 72, 120])
def test_tone_gives_its_rate(spark, bpm):
    x = np.sin(2 * np.pi * bpm / 60 * np.arange(300) / FS)
    df = windows(spark, [x.tolist()])
    assert column(df, spectral.dominant_bpm(F.col("x"), FS))[0] == pytest.approx(bpm, abs=6)


def test_no_bin_in_band_gives_the_middle(spark):
    df = windows(spark, [[0.0, 1.0, 0.0, 1.0]])
    assert column(df, spectral.dominant_bpm(F.col("x"), 1000.0)) == [125.0]


def test_magnitude_and_shape_error(spark):
    df = windows(spark, [[[3.0, 0.0], [4.0, 0.0], [0.0, 2.0]], None], "ARRAY<ARRAY<FLOAT>>")
    assert column(df, arrays.magnitude(F.col("x"))) == [[5.0, 2.0], None]
    bad = windows(spark, [[[1.0], [2.0]]], "ARRAY<ARRAY<FLOAT>>")
    with pytest.raises(Exception, match="expected 3 axes"):
        column(bad, arrays.magnitude(F.col("x")))


def test_small_array_functions(spark):
    df = windows(spark, [[1.0, 4.0, 9.0, 16.0]], "ARRAY<DOUBLE>")
    x = F.col("x")
    assert column(df, arrays.first_difference(x)) == [[3.0, 5.0, 7.0]]
    assert column(df, arrays.pad_cut(x, 6)) == [[1.0, 4.0, 9.0, 16.0, 0.0, 0.0]]
    assert column(df, arrays.pad_cut(x, 2)) == [[1.0, 4.0]]
    assert column(df, arrays.patches(x, 2)) == [[[1.0, 4.0], [9.0, 16.0]]]
    with pytest.raises(Exception, match="multiple of 3"):
        column(df, arrays.patches(x, 3))
    assert column(df, arrays.complete(x, 4)) == [True]
    bad = windows(spark, [[1.0, float("nan")], [1.0, None], [1.0]], "ARRAY<DOUBLE>")
    assert column(bad, arrays.complete(x, 2)) == [False, False, False]


def registry(spark):
    rng = np.random.default_rng(0)
    rows = [
        (str(i), rng.normal(size=300).tolist(),
         rng.normal(size=(3, 1000)).tolist() if i % 2 else None, "M" if i % 3 else "F", 20.0 + i, None)
        for i in range(6)
    ]
    return spark.createDataFrame(
        rows, "record_id STRING, ppg ARRAY<FLOAT>, acc ARRAY<ARRAY<FLOAT>>, sex STRING, age DOUBLE, height DOUBLE"
    ).withColumns({"weight": F.lit("abc"), "measurement_site": F.lit("Finger ")})


@pytest.mark.parametrize("variant,width", [("ppg", 19), ("ppg_acc", 38), ("ppg_acc_cov", 43)])
def test_feature_width_grows_with_the_variant(spark, variant, width):
    table = features.feature_table(registry(spark), variant)
    names = features.feature_names(table)
    assert len(names) == width
    assert table.where(" OR ".join(f"{n} IS NULL OR isnan({n})" for n in names)).isEmpty()


def test_missing_acc_and_covariates(spark):
    rows = {r["record_id"]: r for r in features.feature_table(registry(spark), "ppg_acc_cov").collect()}
    assert rows["0"]["acc_std"] == 0.0 and rows["0"]["acc_total_power"] == 0.0
    assert rows["1"]["acc_std"] == pytest.approx(1.0, abs=1e-6)
    assert (rows["0"]["cov_sex_male"], rows["1"]["cov_sex_male"]) == (0.0, 1.0)
    assert (rows["1"]["cov_height"], rows["1"]["cov_weight"], rows["1"]["cov_site_finger"]) == (0, 0, 1)


def test_unknown_variant(spark):
    with pytest.raises(ValueError, match="unknown variant"):
        features.feature_table(registry(spark), "acc")


def test_scaling_centres_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "ppg_a DOUBLE, ppg_b DOUBLE")
    fitted = features.scaler(df, ["ppg_a", "ppg_b"]).first().asDict()
    assert [tuple(r) for r in features.scale(df, ["ppg_a", "ppg_b"], fitted).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def spikes(bpm, fs=130.0, seconds=10.0, noise=0.02):
    t = np.arange(int(fs * seconds)) / fs
    beat = np.mod(t, 60.0 / bpm)
    rng = np.random.default_rng(int(bpm))
    return (np.exp(-(((beat - 0.1) / 0.012) ** 2)) + noise * rng.normal(size=len(t))).tolist()


@pytest.mark.parametrize("bpm", [48, 60, 75, 110, 150])
def test_heart_rate_of_spike_trains(spark, bpm):
    df = windows(spark, [spikes(bpm)], "ARRAY<DOUBLE>").withColumn("b", heartbeat.r_peaks(F.col("x"), 130.0))
    assert column(df, heartbeat.rate(F.col("b"), 130.0))[0] == pytest.approx(bpm, rel=0.03)


def test_heart_rate_refuses_short_and_flat_windows(spark):
    rows = [[0.0] * 100, [0.0] * 1300, None, spikes(75)[:1000] + [float("nan")] * 300]
    df = windows(spark, rows, "ARRAY<DOUBLE>").withColumn("b", heartbeat.r_peaks(F.col("x"), 130.0))
    got = column(df, heartbeat.rate(F.col("b"), 130.0))
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(75, rel=0.03)


def test_band_pass_gain():
    b, a = heartbeat.bandpass(130.0)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * np.pi * f / 130.0)) / np.polyval(a, z))
    assert gain(9.0) == pytest.approx(1.0, abs=0.02)
    assert gain(5.0) == pytest.approx(2**-0.5, abs=1e-6) and gain(15.0) == pytest.approx(2**-0.5, abs=1e-6)
    assert gain(1.0) < 0.01 and gain(40.0) < 0.03


def test_zero_phase_keeps_a_pass_band_tone():
    t = np.arange(1300) / 130.0
    x = np.sin(2 * np.pi * 9 * t)[None, :]
    y = heartbeat.zero_phase(*heartbeat.bandpass(130.0), x)
    assert np.allclose(y[0, 200:-200], x[0, 200:-200], atol=0.03)


def test_peaks_rules():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 0.0])
    assert heartbeat.peaks(x, 1, 0.5).tolist() == [1, 4, 7, 9]
    assert heartbeat.peaks(x, 3, 0.5).tolist() == [1, 4, 9]
    assert heartbeat.peaks(x, 1, 2.5).tolist() == [4, 9]


def test_median_and_majority(spark):
    train = spark.createDataFrame(
        [(1, 60.0), (1, 80.0), (1, 70.0), (0, 200.0), (0, 10.0), (0, 10.0), (None, 1.0)],
        "quality_label INT, hr_ref DOUBLE",
    )
    assert baselines.fit_median_hr(train).first()[0] == 70.0
    row = baselines.fit_majority(train).first()
    assert row["majority_label"] == 0.0 and row["prob_good"] == pytest.approx(3 / 7)
    with pytest.raises(ValueError):
        baselines.fit_median_hr(train.where("quality_label = 0"))
