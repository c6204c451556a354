"""Geometry on arrays of doubles, as Column expressions, and numpy kernels for frames."""
import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dist2(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dist(a, b) -> Column:
    return F.sqrt(dist2(a, b))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def normal_ratio(x, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z)


def motif_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Without superposition: both are in their own canonical frame."""
    return float(np.sqrt(((a - b) ** 2).sum() / len(a)))


def canonical_frame(a, b, c):
    """Shift and rotation that put the triangle's centroid at the origin, b on the first axis, a in the first plane."""
    a, b, c = (np.asarray(v, float) for v in (a, b, c))
    mid = (a + b + c) / 3
    x = (b - mid) / np.linalg.norm(b - mid)
    y = (a - mid) - np.dot(a - mid, x) * x
    y /= np.linalg.norm(y)
    return -mid, np.stack([x, y, np.cross(x, y)])
