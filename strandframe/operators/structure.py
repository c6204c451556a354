"""Searches and measures on chains (label, seq, xs, ys, zs).

Distances, secondary structure and half spheres are array expressions of one row; nothing is shuffled. The searches
are numpy over Arrow batches of chains, with references and profiles that the caller holds (a few hundred at most).
A chain is one row: its length, not the table's, bounds a task's memory.
"""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.geometry import canonical_frame, motif_rmsd

SIZES = (12, 14, 8)  # fixed values: lengths of the motifs
MAX_REFS = 1000


def _point(xs, ys, zs, i) -> Column:
    return F.array(*[F.get(c, i).cast("double") for c in (xs, ys, zs)])


def _gap(xs, ys, zs, i, j) -> Column:
    """Distance of two places of a chain, counted from 0."""
    d = [F.get(c, i).cast("double") - F.get(c, j).cast("double") for c in (xs, ys, zs)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def distance_matrix(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, i, j, dist for i < j, from 1."""
    xs, ys, zs = F.col("xs"), F.col("ys"), F.col("zs")
    i = chains.withColumn("i", F.explode(F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.size(xs) - 2))))
    ij = i.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size(xs) - 1)))
    return ij.select(key, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), _gap(xs, ys, zs, F.col("i"), F.col("j")).alias("dist"))


def secondary_structure(xs: Column, ys: Column, zs: Column) -> Column:
    """A letter a place: h helix, s strand, t turn, ~ else and for the two places at each end."""
    # fixed values: distances over one, two and three bonds and how far they may be off
    helix, strand = ((5.45, 5.18, 6.37), 2.1), ((6.1, 10.4, 13.0), 1.42)

    def letter(p):
        d = lambda a, b: _gap(xs, ys, zs, p + a, p + b)
        steps = [(d(-2, 0), 0), (d(-1, 1), 0), (d(0, 2), 0), (d(-2, 1), 1), (d(-1, 2), 1), (d(-2, 2), 2)]

        def near(kind):
            at, off = kind
            ok = F.lit(True)
            for x, k in steps:
                ok = ok & (F.abs(x - at[k]) < off)
            return ok

        end = (p < 2) | (p + 2 >= F.size(xs))
        return F.when(end, "~").when(near(helix), "h").when(near(strand), "s").when(d(-2, 2) < 8.2, "t").otherwise("~")

    return F.when(F.size(xs) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(xs) - 1), letter), "")).otherwise("")


def half_spheres(chains: DataFrame, radius: float = 12.0, key: str = "label") -> DataFrame:
    """key, pos (from 1, ends left out), up, down: neighbours within the radius on the side chain's side and on the other."""
    xs, ys, zs, p = F.col("xs"), F.col("ys"), F.col("zs"), F.col("p")
    at = chains.withColumn("p", F.explode(F.when(F.size(xs) > 2, F.sequence(F.lit(1), F.size(xs) - 2))))

    def side(j):
        """Twice the place less its neighbours points to the side chain; its product with the way to j."""
        out = F.lit(0.0)
        for c in (xs, ys, zs):
            g = lambda i, c=c: F.get(c, i).cast("double")
            out = out + ((g(p) - g(p - 1)) + (g(p) - g(p + 1))) * (g(j) - g(p))
        return out

    near = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda j: (j != p) & (_gap(xs, ys, zs, p, j) <= radius))
    at = at.withColumn("near", near)
    up = F.size(F.filter("near", lambda j: side(j) > 0))
    return at.select(key, (p + 1).alias("pos"), up.alias("up"), (F.size("near") - up).alias("down"))


@dataclass
class Reference:
    """A chain with the starts of its motifs, from 0."""

    label: str
    points: np.ndarray
    a: int
    b: int
    c: int

    def motifs(self) -> np.ndarray:
        return motif_points(self.points, self.a, self.b, self.c)


@dataclass
class Limits:
    """fixed values: least and most gaps of the motifs' starts (AB has no upper bound) and how far a triangle may be off."""

    ab: tuple = (10, None)
    bc: tuple = (10, 80)
    ac: tuple = (80, 200)
    side: float = 1.5
    squares: float = 1.5
    rmsd: float = 5.5


def motif_points(p: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    """The 34 points of the motifs in the frame of their first points."""
    shift, basis = canonical_frame(p[a], p[b], p[c])
    rows = np.concatenate([p[s : s + n] for s, n in zip((a, b, c), SIZES, strict=True)])
    return (rows + shift) @ basis.T


def _pairs(n: int, gap: tuple, ok: np.ndarray) -> np.ndarray:
    """Places (i, j) with j - i in the gap at which ok holds, as a mask."""
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    return ok & (d >= gap[0]) & (d <= (gap[1] or n))


def triangles(p: np.ndarray, ab: np.ndarray, bc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """(a, b, c) allowed by the three masks whose motifs end inside the chain, in ascending order."""
    out, n = [], len(p)
    for a, c in zip(*np.nonzero(ac), strict=True):
        if c + SIZES[2] <= n:
            b = np.flatnonzero(ab[a] & bc[:, c])
            b = b[b + SIZES[1] <= n]
            out.append(np.c_[np.full(len(b), a), b, np.full(len(b), c)])
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def _matrix(p: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def match_triangle(p: np.ndarray, ref: Reference, limits: Limits = Limits()) -> tuple | None:
    """(rmsd, a, b, c) of the place that fits the reference best, or None."""
    if len(p) < sum(SIZES):
        return None
    d, n = _matrix(p), len(p)
    q = [np.linalg.norm(ref.points[i] - ref.points[j]) for i, j in ((ref.a, ref.b), (ref.b, ref.c), (ref.a, ref.c))]
    masks = [_pairs(n, gap, np.abs(d - x) <= limits.side) for gap, x in zip((limits.ab, limits.bc, limits.ac), q, strict=True)]
    t = triangles(p, *masks)
    off = (d[t[:, 0], t[:, 1]] - q[0]) ** 2 + (d[t[:, 1], t[:, 2]] - q[1]) ** 2 + (d[t[:, 0], t[:, 2]] - q[2]) ** 2
    known, best = ref.motifs(), None
    for a, b, c in t[off < limits.squares].tolist():
        r = motif_rmsd(motif_points(p, a, b, c), known)
        if r < limits.rmsd and (best is None or r < best[0]):
            best = (r, a, b, c)
    return best


def _over_chains(chains: DataFrame, f, schema: str) -> DataFrame:
    """f(label, seq, points) gives the rows of one chain; a null coordinate array counts as an empty chain."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for label, seq, *xyz in b.itertuples(index=False):
                p = np.array([[] if v is None else v for v in xyz], float).T.reshape(-1, 3)
                rows += f(label, seq or "", p)
            yield pd.DataFrame(rows, columns=names)

    return chains.select("label", "seq", "xs", "ys", "zs").mapInPandas(run, schema)


def triangle_search(chains: DataFrame, refs: list[Reference], limits: Limits = Limits(), best_only: bool = True) -> DataFrame:
    """label, ref, rmsd, pos_a, pos_b, pos_c (from 1): the best reference of each chain, or each that fits."""
    if len(refs) > MAX_REFS:
        raise ValueError(f"more than {MAX_REFS} references: search in several runs and take the least rmsd of each label")
    known = chains.sparkSession.sparkContext.broadcast(refs)

    def f(label, seq, p):
        found = [(m, r.label) for r in known.value if (m := match_triangle(p, r, limits))]
        found.sort(key=lambda x: (x[0][0], x[1]))
        return [(label, ref, m[0], m[1] + 1, m[2] + 1, m[3] + 1) for m, ref in (found[:1] if best_only else found)]

    return _over_chains(chains, f, "label string, ref string, rmsd double, pos_a long, pos_b long, pos_c long")


def find_triangles(chains: DataFrame, stats: dict, k: float = 2.0, least: float = 0.3, dgd: bool = False) -> DataFrame:
    """label, score, pos_a, pos_b, pos_c (from 1) of each chain's best triangle by population statistics.

    stats: {"ab" | "bc" | "ac": (mean gap, its deviation, mean distance, its deviation)}; each value lies within k
    deviations, and the score is the mean of the six ratios of the normal density to its peak. dgd: the motifs also
    have a D, a G and a D at their anchors.
    """

    def f(label, seq, p):
        if len(p) < sum(SIZES):
            return []
        d, gap = _matrix(p), np.arange(len(p))[None, :] - np.arange(len(p))[:, None]
        masks, score = {}, {}
        for name in ("ab", "bc", "ac"):
            ml, sl, md, sd = stats[name]
            zl, zd = (gap - ml) / sl, (d - md) / sd
            upper = np.abs(zl) <= k if name != "ab" else zl >= -k  # AB has no upper bound
            masks[name] = upper & (np.abs(zd) <= k) & (gap > 0)
            score[name] = np.exp(-zl * zl / 2) + np.exp(-zd * zd / 2)
        if dgd:
            has = [np.array([seq[i + off : i + off + 1] == letter for i in range(len(p))], bool) for letter, off in (("D", 3), ("G", 1), ("D", 3))]
            masks["ab"] &= has[0][:, None] & has[1][None, :]
            masks["ac"] &= has[0][:, None] & has[2][None, :]
        t = triangles(p, masks["ab"], masks["bc"], masks["ac"])
        s = (score["ab"][t[:, 0], t[:, 1]] + score["bc"][t[:, 1], t[:, 2]] + score["ac"][t[:, 0], t[:, 2]]) / 6
        if not len(s) or s.max() <= least:
            return []
        a, b, c = t[int(s.argmax())].tolist()
        return [(label, float(s.max()), a + 1, b + 1, c + 1)]

    return _over_chains(chains, f, "label string, score double, pos_a long, pos_b long, pos_c long")


def contact_map(p: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    """Distances between the 34 points of the motifs."""
    return _matrix(np.concatenate([p[s : s + n] for s, n in zip((a, b, c), SIZES, strict=True)]))


def contact_maps(chains: DataFrame) -> DataFrame:
    """label, i, j, value (i > j, from 1) of chains that also carry pos_a, pos_b, pos_c (from 1)."""

    def run(batches):
        i, j = np.tril_indices(sum(SIZES), -1)
        for b in batches:
            out = [pd.DataFrame({"label": r.label, "i": i + 1, "j": j + 1, "value": contact_map(np.array([r.xs, r.ys, r.zs], float).T, r.pos_a - 1, r.pos_b - 1, r.pos_c - 1)[i, j]}) for r in b.itertuples(index=False)]
            yield pd.concat(out) if out else pd.DataFrame({"label": [], "i": [], "j": [], "value": []})

    return chains.select("label", "xs", "ys", "zs", "pos_a", "pos_b", "pos_c").mapInPandas(run, "label string, i long, j long, value double")
