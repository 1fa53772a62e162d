"""The pair score: root of the weighted Jensen-Shannon divergence of the target's states under the reference's two states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the score
CLIP, TINY = 1e-9, 1e-27


def pair_score(n11: Column, dp_i: Column, dp_j: Column, total: Column, clip: float = CLIP, least_ratio: float = 0.0) -> Column:
    """n11: joint weight; dp: weight of ones of reference i and target j; total: all weight. Null where i has only one state.

    Ratios of states to their mixture are at least least_ratio; single precision uses a clip of 1e-7 and a least ratio of 1e-27.
    """
    dq_i = total - dp_i
    cut = lambda c: F.least(F.greatest(c, F.lit(clip)), F.lit(1 - clip))
    p, q = cut(n11 / dp_i), cut((dp_j - n11) / dq_i)
    s = dp_i / total
    p1, p0, q1, q0 = p + TINY, 1 - p + TINY, q + TINY, 1 - q + TINY
    m1, m0 = s * p1 + (1 - s) * q1, s * p0 + (1 - s) * q0
    log = (lambda r: F.log2(F.greatest(r, F.lit(least_ratio)))) if least_ratio else F.log2
    js = s * (p1 * log(p1 / m1) + p0 * log(p0 / m0)) + (1 - s) * (q1 * log(q1 / m1) + q0 * log(q0 / m0))
    return F.when((dp_i > 0) & (dq_i > 0), F.sqrt(F.greatest(js, F.lit(0.0))))


def scores(n11: np.ndarray, dp_i: np.ndarray, dp_j: np.ndarray, total: np.ndarray | float, clip: float = CLIP) -> np.ndarray:
    """The same on arrays that broadcast to one shape. NaN where i has only one state."""
    with np.errstate(divide="ignore", invalid="ignore"):
        dq_i = total - dp_i
        p = np.clip(n11 / dp_i, clip, 1 - clip)
        q = np.clip((dp_j - n11) / dq_i, clip, 1 - clip)
        s = dp_i / total
        p1, p0, q1, q0 = p + TINY, 1 - p + TINY, q + TINY, 1 - q + TINY
        m1, m0 = s * p1 + (1 - s) * q1, s * p0 + (1 - s) * q0
        js = s * (p1 * np.log2(p1 / m1) + p0 * np.log2(p0 / m0)) + (1 - s) * (q1 * np.log2(q1 / m1) + q0 * np.log2(q0 / m0))
        return np.where((dp_i > 0) & (dq_i > 0), np.sqrt(np.maximum(js, 0)), np.nan)


def tile_scores(n11: np.ndarray, dp_i: np.ndarray, dp_j: np.ndarray, total: float, clip: float = CLIP) -> np.ndarray:
    """scores() of a tile: n11 has a row per reference and a column per target."""
    return scores(n11, dp_i[:, None], dp_j[None, :], total, clip)


def entropy(p: Column) -> Column:
    """Root of the binary entropy, 0 at p of 0 or 1."""
    return F.when((p > 0) & (p < 1), F.sqrt(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))).otherwise(0.0)
