"""Spectra, spectral features and Fourier resampling of window arrays.

As SQL, a transform needs samples x bins rows per window; here a batch of windows
is transformed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsemill.functions.arrays import TIME_NAMES, standardized, time_statistics
from pulsemill.functions.batches import Matrix, lists, same_length, window_map, window_number, window_struct
from pulsemill.schemas import HR_RANGE

# fixed values: pass bands in Hz
PPG_BAND = (0.5, 3.67)
ACC_BAND = (0.5, 10.0)
FREQ_NAMES = (
    "dom_freq", "dom_freq_bpm", "band_power", "band_power_ratio", "spec_centroid",
    "spec_entropy", "total_power",
)


# -- batch helpers ------------------------------------------------------------------------------
def power_density(x: Matrix, fs: float) -> Matrix:
    """One-sided power density of the mean-free rows."""
    n = x.shape[1]
    spectrum = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
    power = (spectrum.real**2 + spectrum.imag**2) / (fs * n)
    power[:, 1 : (n + 1) // 2] *= 2.0
    return power


def _in_band(n: int, fs: float, band: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    freqs = np.arange(n // 2 + 1) * (fs / n)
    return freqs, (freqs >= band[0]) & (freqs <= band[1])


def spectral_statistics(
    x: Matrix, fs: float, prefix: str, band: tuple[float, float]
) -> dict[str, np.ndarray]:
    """The 7 spectral features of each row; without in-band power the dominant frequency is 0."""
    power = power_density(x, fs)
    freqs, inside = _in_band(x.shape[1], fs, band)
    total = power.sum(axis=1) + 1e-12
    in_band = power[:, inside]
    band_power = in_band.sum(axis=1)
    if inside.any():
        dominant = np.where(band_power > 0, freqs[inside][in_band.argmax(axis=1)], 0.0)
    else:
        dominant = np.zeros(len(x))
    share = power / total[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)
    out = {
        "dom_freq": dominant,
        "dom_freq_bpm": dominant * 60.0,
        "band_power": band_power,
        "band_power_ratio": band_power / total,
        "spec_centroid": (power * freqs).sum(axis=1) / total,
        "spec_entropy": entropy,
        "total_power": total,
    }
    return {f"{prefix}_{name}": values for name, values in out.items()}


def _resampled(x: Matrix, length: int) -> Matrix:
    n = x.shape[1]
    if n == length:
        return x
    spectrum = np.fft.rfft(x, axis=1)
    keep = min(n, length)
    cut = np.zeros((x.shape[0], length // 2 + 1), dtype=complex)
    cut[:, : keep // 2 + 1] = spectrum[:, : keep // 2 + 1]
    if keep % 2 == 0:  # the shared Nyquist bin stands for both signs on one side only
        cut[:, keep // 2] *= 2.0 if length < n else 0.5
    return np.fft.irfft(cut, length, axis=1) * (length / n)


# -- columns ------------------------------------------------------------------------------------
def periodogram(x: Column, fs: float) -> Column:
    """Power density per frequency bin k, at k * fs / n Hz."""
    return window_map(x, lambda m: power_density(m, fs))


def bins(power: Column, n: Column, fs: float) -> Column:
    """ARRAY<STRUCT<f, p>> of a periodogram over ``n`` samples."""
    return F.transform(
        power, lambda p, k: F.struct((k * F.lit(float(fs)) / n).alias("f"), p.alias("p"))
    )


def resample(x: Column, orig_fs: float, target_fs: float) -> Column:
    """Fourier resampling to round(n * target / orig) samples."""
    if orig_fs == target_fs:
        return x.cast("array<double>")
    return window_map(x, lambda m: _resampled(m, int(round(m.shape[1] * target_fs / orig_fs))))


def resampled(x: pa.Array, orig_fs: float, target_fs: float, length: int) -> pa.Array:
    """As :func:`resample` for an Arrow array of windows, cut to ``length`` samples."""
    return lists(len(x), [
        (where, _resampled(m, int(round(m.shape[1] * target_fs / orig_fs)))[:, :length]) for where, m in same_length(x)
    ])


def freq_features(
    x: Column, fs: float, prefix: str, band: tuple[float, float] = PPG_BAND
) -> Column:
    """STRUCT of the 7 spectral features of one window."""
    names = [f"{prefix}_{n}" for n in FREQ_NAMES]
    return window_struct(x, lambda m: spectral_statistics(m, fs, prefix, band), names)


def window_features(
    x: Column, fs: float, prefix: str, band: tuple[float, float], axes: bool = False
) -> Column:
    """STRUCT of all 19 features of the z-scored window, in one crossing to Python.

    With ``axes`` the column holds three axes and their magnitude is the window.
    """

    def run(m: Matrix) -> dict[str, np.ndarray]:
        z = standardized(m)
        return {**time_statistics(z, prefix), **spectral_statistics(z, fs, prefix, band)}

    names = [f"{prefix}_{n}" for n in (*TIME_NAMES, *FREQ_NAMES)]
    return window_struct(x, run, names, axes=axes)


def dominant_bpm(x: Column, fs: float, band_bpm: tuple[float, float] = HR_RANGE) -> Column:
    """Strongest in-band frequency as beats per minute; the band's middle if no bin is inside."""
    band = (band_bpm[0] / 60.0, band_bpm[1] / 60.0)

    def run(m: Matrix) -> np.ndarray:
        freqs, inside = _in_band(m.shape[1], fs, band)
        if not inside.any():
            return np.full(len(m), sum(band_bpm) / 2.0)
        return freqs[inside][power_density(m, fs)[:, inside].argmax(axis=1)] * 60.0

    return window_number(x, run)
