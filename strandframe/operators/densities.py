"""How many places of a chain lie in a sphere.

A chain is a row and is counted by numpy within its task, by a grid whose cells are no smaller than the spheres' radius, so
that a sphere meets 27 cells; pairs of a sphere and a place are taken some at a time. Nothing is shuffled but what the
caller joins."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.geometry import canonical_frame

#: fixed values: how far the cavity's centre lies from the middle of the motifs' triangle along its first and third axis
CAVITY = (3.0, -10.0)
LEAST_RADIUS = 2.0**-10
#: pairs that are measured at a time, and chains up to this length without a grid
PAIRS, SHORT = 1 << 20, 128


def _pairs(first: np.ndarray, n: np.ndarray):
    """(which, place) in portions: which k has the n[k] places from first[k] on."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        for lo in range(0, int(ends[to - 1] - base), PAIRS):  # one sphere may meet more
            k = np.arange(lo, min(lo + PAIRS, int(ends[to - 1] - base)))
            which = at + np.searchsorted(ends[at:to] - base, k, "right")
            yield which, first[which] + k - (ends[which] - n[which] - base)
        at = to


def sphere_counts(points: np.ndarray, centres: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the points (place, axis) lie at most r away from each centre (sphere, axis); 0 where a value is none."""
    out = np.zeros(len(centres), np.int64)
    ok = np.isfinite(r) & np.isfinite(centres).all(1)
    points = points[np.isfinite(points).all(1)]

    def count(s, p, first, n):
        for which, place in _pairs(first, n):
            d = points[p[place]] - centres[s[which]]
            near = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= r[s[which]]
            out[s] += np.bincount(which[near], minlength=len(s))

    if not ok.any() or not len(points):
        return out
    if len(points) <= SHORT:
        s = np.flatnonzero(ok)
        count(s, np.arange(len(points)), np.zeros(len(s), int), np.full(len(s), len(points)))
        return out
    level = np.ceil(np.log2(np.maximum(r, LEAST_RADIUS, where=ok, out=np.ones(len(r)))))
    for v in np.unique(level[ok]):
        s = np.flatnonzero(ok & (level == v))
        g, h = np.floor(points / 2.0**v), np.floor(centres[s] / 2.0**v)
        axes = [np.unique(g[:, k], return_inverse=True) for k in range(3)]
        name = (axes[2][1].astype(np.int64) * len(axes[1][0]) + axes[1][1]) * len(axes[0][0]) + axes[0][1]
        order = np.argsort(name, kind="stable")
        name = name[order]
        for step in np.array(np.meshgrid(*[(-1, 0, 1)] * 3)).reshape(3, -1).T:
            to = h + step
            at, there = [], np.ones(len(s), bool)
            for k in range(3):
                i = np.minimum(np.searchsorted(axes[k][0], to[:, k]), len(axes[k][0]) - 1)
                there &= axes[k][0][i] == to[:, k]
                at.append(i)
            want = ((at[2] * len(axes[1][0]) + at[1]) * len(axes[0][0]) + at[0])[there]
            first, last = np.searchsorted(name, want), np.searchsorted(name, want, "right")
            count(s[there], order, first, last - first)
    return out


def _counted(chains: DataFrame, key: str, spheres, more: tuple = ()) -> DataFrame:
    """key, pos (from 1), n of spheres(points, *more) -> (centres, r) of each chain."""
    kind = chains.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            for at in range(0, len(f), 256):
                keys, pos, found = [], [], []
                for k, *rest in f.iloc[at : at + 256].itertuples(index=False):
                    xyz = rest[:3]
                    if any(v is None for v in xyz) or not len(xyz[0]):
                        continue
                    p = np.array(xyz, float).T
                    keys += [k] * len(p)
                    pos.append(np.arange(1, len(p) + 1))
                    found.append(sphere_counts(p, *spheres(p, *rest[3:])))
                if keys:
                    yield pd.DataFrame({key: keys, "pos": np.concatenate(pos), "n": np.concatenate(found)})

    return chains.select(key, "xs", "ys", "zs", *more).mapInPandas(run, f"{key} {kind}, pos int, n long")


def side_spheres(chains: DataFrame, radius: float, key: str = "label") -> DataFrame:
    """key, pos, n: places within radius of a point that lies radius off each place on its side chain's side; 0 at the ends."""

    def spheres(p):
        d = np.full(p.shape, np.nan)
        d[1:-1] = 2 * p[1:-1] - p[:-2] - p[2:]
        long = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        long = np.where(long > 0, long, np.nan)
        return p + radius * d / long[:, None], np.where(np.isnan(long), np.nan, radius)

    return _counted(chains, key, spheres)


def cavity_centre(p: np.ndarray, a, b, c) -> np.ndarray:
    shift, axes = canonical_frame(p[int(a)], p[int(b)], p[int(c)])
    return -shift + CAVITY[0] * axes[0] + CAVITY[1] * axes[2]


def cavity_centres(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, ox, oy, oz: the cavity's centre of chains whose motifs pos_a, pos_b, pos_c (from 0) lie within."""
    kind = chains.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for k, a, b, c, *xyz in f.itertuples(index=False):
                rows.append((k, *cavity_centre(np.array(xyz, float).T, a, b, c).tolist()))
            yield pd.DataFrame(rows, columns=[key, "ox", "oy", "oz"])

    return chains.select(key, "pos_a", "pos_b", "pos_c", "xs", "ys", "zs").mapInPandas(run, f"{key} {kind}, ox double, oy double, oz double")


def cavity_numbers(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, pos, n of chains with pos_a, pos_b, pos_c (from 0): places around the middle between each place and the cavity's centre, within half of its distance from the place."""
    good = chains.filter(" AND ".join(f"pos_{m} >= 0 AND pos_{m} < size(xs)" for m in "abc"))

    def spheres(p, a, b, c):
        o = cavity_centre(p, a, b, c)
        h = (p - o) / 2
        return (p + o) / 2, np.sqrt(h[:, 0] * h[:, 0] + h[:, 1] * h[:, 1] + h[:, 2] * h[:, 2]) / 2

    return _counted(good, key, spheres, ("pos_a", "pos_b", "pos_c"))
