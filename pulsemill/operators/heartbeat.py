"""Reference heart rate from ECG windows.

The filter and the peak search need each sample's neighbours, so one Arrow
function takes a batch of windows; the rate itself is column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsemill.functions.arrays import first_difference, let, percentile_of_sorted
from pulsemill.functions.batches import same_length
from pulsemill.schemas import HR_RANGE

# fixed values: pass band in Hz and filter order
BAND = (5.0, 15.0)
ORDER = 3


def bandpass(fs: float, lo: float = BAND[0], hi: float = BAND[1], order: int = ORDER):
    """Digital Butterworth band-pass (b, a) by the bilinear transform."""
    low, high = (2 * fs * np.tan(np.pi * f / fs) for f in (lo, hi))
    width, centre = high - low, low * high
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - centre)
    poles = np.concatenate([proto + root, proto - root])
    a = np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))
    b = np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    middle = np.exp(2j * np.arctan(np.sqrt(centre) / (2 * fs)))  # unit gain at the centre
    gain = np.abs(np.polyval(a, middle) / np.polyval(b, middle))
    return b * gain, a


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct-form II transposed along axis 0, stepping through time for all columns at once."""
    y = np.empty_like(x)
    b_rest, a_rest = b[1:, None], a[1:, None]
    for t, now in enumerate(x):
        y[t] = b[0] * now + state[0]
        state[:-1] = state[1:]
        state[-1] = 0.0
        state += b_rest * now - a_rest * y[t]
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd edge padding and settled start states."""
    pad = 3 * len(a)
    steady = np.linalg.solve(
        np.eye(len(a) - 1) - np.vstack([-a[1:], np.eye(len(a) - 2, len(a) - 1)]).T,
        b[1:] - a[1:] * b[0],
    )
    x = np.ascontiguousarray(x.T)
    left = 2 * x[:1] - x[pad:0:-1]
    right = 2 * x[-1:] - x[-2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right])
    for _ in range(2):
        y = _filter(b, a, y, np.outer(steady, y[0]))[::-1]
    return y[pad:-pad].T


def peaks(x: np.ndarray, distance: int, height: float) -> np.ndarray:
    """Local maxima (middle of a plateau) of at least ``height``, highest first kept apart."""
    turn = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], turn])
    ends = np.concatenate([turn, [len(x)]]) - 1
    level = x[starts]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (starts[inner] + ends[inner]) // 2
    at = at[x[at] >= height]
    if (np.diff(at) >= distance).all():
        return at
    keep = np.ones(len(at), dtype=bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]


def r_peaks(ecg: Column, fs: float, max_bpm: float = HR_RANGE[1]) -> Column:
    """Sample positions of the R peaks among the finite samples; null below two seconds."""

    def beats(matrix: np.ndarray) -> list[np.ndarray]:
        smooth = zero_phase(*bandpass(fs), matrix)
        return [peaks(y, int(fs * 60 / max_bpm), float(np.std(y))) for y in smooth]

    @F.arrow_udf("array<int>")
    def find(batch: pa.Array) -> pa.Array:
        out: list = [None] * len(batch)
        for where, matrix in same_length(batch):
            finite = np.isfinite(matrix)
            whole = finite.all(axis=1)
            groups = [(where[whole], matrix[whole])]
            groups += [(where[[i]], matrix[i, finite[i]][None, :]) for i in np.flatnonzero(~whole)]
            for rows, part in groups:
                if len(rows) and part.shape[1] >= int(fs * 2):
                    for i, found in zip(rows, beats(part)):
                        out[i] = found
        return pa.array(out, type=pa.list_(pa.int32()))

    # not deterministic as far as the optimizer goes: a filter on the rate would
    # otherwise be pushed below and find all beats a second time
    return find.asNondeterministic()(ecg)


def rate(found: Column, fs: float, valid_range: tuple[float, float] = HR_RANGE) -> Column:
    """60 / median beat distance; null below three beats or outside the plausible range."""
    gaps = F.sort_array(first_difference(found))
    bpm = let(
        60.0 / (percentile_of_sorted(gaps, 0.5) / fs),
        lambda hr: F.when(hr.between(*valid_range), hr),
    )
    return F.when(F.size(found) >= 3, bpm).cast("double")
