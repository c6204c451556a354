"""Alignment operators over tables of pairs.

Pairs (a, b) are joined with their chains, so a pair is a row: nothing is broadcast and no chain meets all others in
one task. Searches against references take a list that the caller holds, in groups. Pairs of unknown, null or empty
chains give no row; extra columns of chains are ignored."""
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import align, superpose

GROUP = 256  # references that a task holds at a time


def joined(pairs: DataFrame, chains: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """a, b and both sides' columns, with 1 and 2 after their names."""
    out = pairs.select("a", "b")
    for side, end in (("1", "a"), ("2", "b")):
        out = out.join(chains.select(F.col(key).alias(end), *[F.col(c).alias(c + side) for c in cols]), end)
    return out.filter(F.col(cols[0] + "1").isNotNull() & F.col(cols[0] + "2").isNotNull())


def _xyz(row, side: str) -> np.ndarray:
    return np.stack([np.asarray(getattr(row, c + side), float) for c in ("xs", "ys", "zs")], 1)


def _over(rows: DataFrame, one, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([out for r in f.itertuples() if (out := one(r)) is not None], columns=names)

    return rows.mapInPandas(run, schema)


def frame_pairs(pairs: DataFrame, chains: DataFrame, key: str = "label", kind: str = "string") -> DataFrame:
    """a, b, tm and path of each pair of chains that are in one frame."""

    def one(r):
        x, y = _xyz(r, "1"), _xyz(r, "2")
        return (r.a, r.b, *align.frame_align(x, y)) if len(x) and len(y) else None

    return _over(joined(pairs, chains, key, ["xs", "ys", "zs"]), one, f"a {kind}, b {kind}, tm double, path string")


def tm_pairs(pairs: DataFrame, chains: DataFrame, key: str = "label", kind: str = "string") -> DataFrame:
    """a, b, tm (a share of b's length), rmsd, matched and path of pairs of chains in frames of their own; pairs of which no fragment matches, or under three places, give no row. Those of a batch that have the same two lengths are aligned together."""

    names = ["a", "b", "tm", "rmsd", "matched", "path"]

    def run(frames):
        for f in frames:
            same: dict = {}
            for r in f.itertuples():
                x, y = _xyz(r, "1"), _xyz(r, "2")
                if np.isfinite(x).all() and np.isfinite(y).all():
                    same.setdefault((len(x), len(y)), []).append((r.a, r.b, x, y))
            out = [((a, b, *got) for a, b, got in zip(one, other, superpose.tm_aligns(np.stack(x), np.stack(y)), strict=True) if got) for one, other, x, y in (zip(*v, strict=True) for v in same.values())]
            yield pd.DataFrame(list(itertools.chain(*out)), columns=names)

    rows = joined(pairs, chains, key, ["xs", "ys", "zs"])
    rows = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a pair is much work for few bytes
    return rows.mapInPandas(run, f"a {kind}, b {kind}, tm double, rmsd double, matched int, path string")


def tm_grid(chains: DataFrame, refs: DataFrame, key: str = "label") -> DataFrame:
    """Pairs (a, b) of every chain with every one of a stated set of references, in both directions; refs.key must be few, as their number multiplies the rows."""
    a, b = chains.select(F.col(key).alias("a")), refs.select(F.col(key).alias("b"))
    names = b.select(F.sort_array(F.collect_set("b")).alias("names")).first()["names"]
    there = a.select("a", F.explode(F.array(*map(F.lit, names)) if names else F.expr(f"CAST(array() AS array<{chains.schema[key].dataType.simpleString()}>)")).alias("b"))
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def frame_search(chains: DataFrame, refs: list[tuple], key: str = "label", kind: str = "string") -> DataFrame:
    """key, ref, tm: each chain's best of refs (name, array of place and axis), the first of equals."""

    def run(frames):
        for f in frames:
            best: list = [(None, -1.0)] * len(f)
            for at in range(0, len(refs), GROUP):
                for k, (xs, ys, zs) in enumerate(zip(f["xs"], f["ys"], f["zs"], strict=True)):
                    if xs is None or not len(xs):
                        continue
                    p = np.stack([np.asarray(v, float) for v in (xs, ys, zs)], 1)
                    for name, ref in refs[at : at + GROUP]:
                        if (tm := align.frame_align(p, ref)[0]) > best[k][1]:
                            best[k] = name, tm
            yield pd.DataFrame([(i, *b) for i, b in zip(f[key], best, strict=True) if b[0] is not None], columns=[key, "ref", "tm"])

    return chains.select(key, "xs", "ys", "zs").mapInPandas(run, f"{key} {kind}, ref string, tm double")


def vector_pairs(pairs: DataFrame, vectors: DataFrame, key: str = "label", bias: float = 0.0, kind: str = "string") -> DataFrame:
    """a, b, score and path of pairs of feature vectors by place (array of arrays `vecs`), aligned globally."""

    def one(r):
        x, y = (np.array([np.asarray(v, float) for v in w]) for w in (r.vecs1, r.vecs2))
        return (r.a, r.b, *align.global_path(align.vector_cells(x, y, bias))) if len(x) and len(y) else None

    return _over(joined(pairs, vectors, key, ["vecs"]), one, f"a {kind}, b {kind}, score double, path string")


def profile_pairs(pairs: DataFrame, profiles: DataFrame, odds: np.ndarray, key: str = "label", kind: str = "string") -> DataFrame:
    """a, b, score, both starts (from 1) and path of pairs of feature bins by place (array of arrays `bins`, null for none), aligned locally by log odds (feature, bin, bin)."""

    def one(r):
        x, y = (np.array([[-1 if v is None or v != v else int(v) for v in p] for p in w]) for w in (r.bins1, r.bins2))
        if not len(x) or not len(y):
            return None
        score, start, _, path = align.smith_waterman(align.profile_cells(x, y, odds))
        return r.a, r.b, score, start[0] + 1, start[1] + 1, path

    return _over(joined(pairs, profiles, key, ["bins"]), one, f"a {kind}, b {kind}, score double, start_a int, start_b int, path string")


def dali_pairs(pairs: DataFrame, chains: DataFrame, key: str = "label", radius: int = 3, kind: str = "string") -> DataFrame:
    """a, b, columns, score, z and band (the sum of the columns' means up to radius away) of pairs aligned by row_a and row_b: columns with upper case on both sides count."""
    rows = joined(pairs, chains, key, ["xs", "ys", "zs"]).join(pairs.select("a", "b", "row_a", "row_b"), ["a", "b"])

    def one(r):
        if r.row_a is None or r.row_b is None:
            return None
        i, j = np.array(list(r.row_a)), np.array(list(r.row_b))
        both = np.char.isupper(i) & np.char.isupper(j) if len(i) else np.zeros(0, bool)
        x, y = _xyz(r, "1")[(np.cumsum(i != "-") - 1)[both]], _xyz(r, "2")[(np.cumsum(j != "-") - 1)[both]]
        score = align.dali_score(x, y) if len(x) else 0.0
        return r.a, r.b, int(both.sum()), score, align.dali_z(score, len(r.xs1), len(r.xs2)), float(align.dali_band(x, y, radius).sum()) if len(x) else 0.0

    return _over(rows, one, f"a {kind}, b {kind}, columns int, score double, z double, band double")
