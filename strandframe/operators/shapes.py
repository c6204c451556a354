"""Shape profiles of chains: gaps and distances of the motifs, and 64 smoothed points along the chain.

Features are expressions of one row, exploded to (feature, value) rows; training is a grouped mean and deviation of 198
features, and the search joins that table, which is broadcast for its fixed size.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.geometry import canonical_frame
from strandframe.operators.features import smoothed
from strandframe.operators.structure import find_triangles

#: fixed values: points along a chain and the reach of the smoothing
POINTS, REACH = 64, 2
GAPS = ("LAB", "LAC", "LBC", "dAB", "dAC", "dBC")
FEATURES = (*GAPS, *(f"{x}{i:02d}" for x in "XYZ" for i in range(POINTS)))


def _place(p: str) -> Column:
    return F.array(*[F.get(c, F.col(p)).cast("double") for c in ("xs", "ys", "zs")])


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _points(chains: DataFrame, key: str, more: list) -> DataFrame:
    """key, more, i and the smoothed point p (x, y, z) of each of the 64 steps of chains that have places."""
    i = chains.filter(F.size("xs") > 0).select(key, *more, "xs", "ys", "zs", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i"))
    return i.select(key, *more, "i", F.array(*[smoothed(F.col(c), F.col("i"), POINTS, REACH) for c in ("xs", "ys", "zs")]).alias("p"))


def features(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, feature, value of chains that are in the motifs' frame, with pos_a, pos_b, pos_c (from 0); a motif outside the chain leaves the row out."""
    n = F.size("xs")
    good = chains.filter(" AND ".join(f"pos_{m} >= 0 AND pos_{m} < size(xs)" for m in "abc")).filter(n > 0)
    pairs = (("a", "b"), ("a", "c"), ("b", "c"))
    gap = [(F.col(f"pos_{q}") - F.col(f"pos_{p}") + 1).cast("double") for p, q in pairs]
    far = [F.sqrt(_dot(_less(_place(f"pos_{p}"), _place(f"pos_{q}")), _less(_place(f"pos_{p}"), _place(f"pos_{q}")))) for p, q in pairs]
    some = good.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("value")) for f, v in zip(GAPS, gap + far, strict=True)])).alias("f")).select(key, "f.*")
    axes = F.array(*[F.struct(F.format_string(f"{x}%02d", "i").alias("feature"), F.get("p", F.lit(k)).alias("value")) for k, x in enumerate("XYZ")])
    return some.unionByName(_points(good, key, []).select(key, F.explode(axes).alias("f")).select(key, "f.*"))


def train(values: DataFrame) -> DataFrame:
    """feature, mean, sd (population)."""
    return values.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def frame(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, xs, ys, zs, mid and the axes e1, e2, e3 of the motifs' triangle: b lies on the first axis, a in the first plane."""
    kind = chains.schema[key].dataType.simpleString()
    names = [key, "xs", "ys", "zs", "mid", "e1", "e2", "e3"]

    def run(frames):
        for f in frames:
            rows = []
            for k, a, b, c, *xyz in f.itertuples(index=False):
                p = np.array(xyz, float).T
                shift, axes = canonical_frame(p[int(a)], p[int(b)], p[int(c)])
                rows.append((k, *xyz, (-shift).tolist(), *axes.tolist()))
            yield pd.DataFrame(rows, columns=names)

    return chains.select(key, "pos_a", "pos_b", "pos_c", "xs", "ys", "zs").mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} array<double>" for c in names[1:]))


def score(chains: DataFrame, profile: DataFrame, key: str = "label") -> DataFrame:
    """key, score: the mean, over 64 points and three axes, of the normal ratio of the point in the motifs' frame to the profile (feature, mean, sd).

    A deviation of 0 gives 1 where the value is the mean and 0 elsewhere. Motifs outside the chain, or on one line, leave the row out."""
    good = chains.filter(" AND ".join(f"pos_{m} >= 0 AND pos_{m} < size(xs)" for m in "abc"))
    p = _points(frame(good, key), key, ["mid", "e1", "e2", "e3"])
    axes = F.array(*[F.struct(F.format_string(f"{x}%02d", "i").alias("feature"), _dot(_less(F.col("p"), F.col("mid")), F.col(e)).alias("value")) for x, e in zip("XYZ", ("e1", "e2", "e3"), strict=True)])
    v = p.select(key, F.explode(axes).alias("f")).select(key, "f.*").filter("value IS NOT NULL AND NOT isnan(value)").join(F.broadcast(profile), "feature")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    ratio = F.when(F.col("sd") > 0, F.exp(-0.5 * z * z)).otherwise((F.col("value") == F.col("mean")).cast("double"))
    return v.groupBy(key).agg(F.avg(ratio).alias("score"))


def search(chains: DataFrame, profile: DataFrame, stats: dict) -> DataFrame:
    """label, score of every chain (unique labels): by the profile at its best D, G, D triangle under the statistics `stats`, 0 where there is none."""
    at = find_triangles(chains, stats, dgd=True).select("label", *[(F.col(f"pos_{m}") - 1).alias(f"pos_{m}") for m in "abc"])
    got = score(chains.join(at, "label"), profile)
    return chains.select("label").join(got, "label", "left").select("label", F.coalesce("score", F.lit(0.0)).alias("score"))


def profile_lines(name: str, profile: DataFrame) -> list[str]:
    """The text format: a name, then a line a feature, in their order, four digits."""
    rows = {r["feature"]: r for r in profile.filter(F.col("feature").isin(*FEATURES)).collect()}
    return [f">{name}", *(f"{f}\t{rows[f]['mean']:.4g}\t{rows[f]['sd']:.4g}" for f in FEATURES)]


def read_profile(spark, lines) -> tuple[str, DataFrame]:
    """The name and (feature, mean, sd) of a profile's text; a broken one raises."""
    rows = [x.rstrip("\r\n").split("\t") for x in lines]
    if not rows or not rows[0][0].startswith(">") or [r[0] for r in rows[1 : 1 + len(FEATURES)]] != list(FEATURES) or any(len(r) != 3 for r in rows[1 : 1 + len(FEATURES)]):
        raise ValueError("not a shape profile, or one that ends early")
    return rows[0][0][1:], spark.createDataFrame([(f, float(m), float(s)) for f, m, s in rows[1 : 1 + len(FEATURES)]], "feature string, mean double, sd double")

