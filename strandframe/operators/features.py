"""Features of chains (key, xs, ys, zs) by place: angles, spans, smoothed coordinates and sketches; expressions of one row."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.structure import _gap, half_spheres

BINS = 8  # fixed value: of each feature


def angle(xs, ys, zs, a, b, c, d) -> Column:
    """Degrees between the way from a to b and the way from c to d (places from 0)."""
    u = [F.get(v, b).cast("double") - F.get(v, a).cast("double") for v in (xs, ys, zs)]
    w = [F.get(v, d).cast("double") - F.get(v, c).cast("double") for v in (xs, ys, zs)]
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    cos = dot(u, w) / F.sqrt(dot(u, u) * dot(w, w))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def scaled_bin(value: Column, least: float, high: float) -> Column:
    return F.least(F.lit(BINS - 1), F.floor((F.greatest(value, F.lit(least)) - least) * BINS / high)).cast("int")


def features(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, pos (from 1) and value and bin of six features; null where the chain ends too soon."""
    xs, ys, zs, p, n = F.col("xs"), F.col("ys"), F.col("zs"), F.col("p"), F.size("xs")
    at = chains.withColumn("p", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    turn = lambda k: F.when((p >= k) & (p + k < n), angle(xs, ys, zs, p - k, p, p, p + k))
    span = lambda a, b, ok: F.when(ok, _gap(xs, ys, zs, a, b))
    d = at.select(key, (p + 1).alias("pos"), turn(2).alias("ang_m2_p2"), turn(3).alias("ang_m3_p3"), span(p, p + 4, p + 4 < n).alias("ed_p4"), span(p - 4, p, p >= 4).alias("ed_m4"))
    d = d.join(half_spheres(chains, 12.0, key), [key, "pos"], "left").withColumn("nu", F.coalesce("up", F.lit(0))).withColumn("nd", F.coalesce("down", F.lit(0))).drop("up", "down")
    bins = {"ang_m2_p2": (1.0, 120.0), "ang_m3_p3": (1.0, 90.0), "ed_p4": (4.5, 10.0), "ed_m4": (4.5, 10.0)}
    cols = [scaled_bin(F.col(c), *v).alias(f"{c}_bin") for c, v in bins.items()]
    down = F.when(F.col("nd") > 10, F.col("nd") - 10).otherwise(F.col("nd"))
    return d.select("*", *cols, F.least(F.lit(BINS - 1), F.floor(F.col("nu") / 3)).cast("int").alias("nu_bin"), F.least(F.lit(BINS - 1), F.floor(down / 2)).cast("int").alias("nd_bin"))


def smoothed(coords: Column, i: Column, n: int, w: int) -> Column:
    """Coordinate of place i of n along a chain: the places from one before to w after it, weighted by w less their distance from the exact place."""
    size = F.size(coords)

    def at(k):
        exact = (i + k) * size / F.lit(float(n))
        near = (exact + 0.5).cast("int")
        ok = (near >= 0) & (near < size)
        weight = F.when(ok, F.lit(float(w)) - F.abs(exact - near)).otherwise(0.0)
        return F.struct((weight * F.when(ok, F.get(coords, near).cast("double")).otherwise(0.0)).alias("s"), weight.alias("w"))

    sums = F.aggregate(F.transform(F.sequence(F.lit(-1), F.lit(w)), at), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda x, y: F.struct((x["s"] + y["s"]).alias("s"), (x["w"] + y["w"]).alias("w")))
    return sums["s"] / sums["w"]


def sketch(ss: Column, n: int, majority: bool = False) -> Column:
    """n letters that stand for a chain's secondary structure, each for three places.

    Of the kinds h, s, t, ~ a later one that occurs replaces an earlier one whenever it has more than the one before
    that had, as readers of such sketches expect; with majority the most frequent kind is taken, the first of equals."""

    def symbol(i):
        k = 2 + F.floor(i * (F.length(ss) - 4) / n).cast("int")
        three = F.substring(ss, k + 1, F.lit(3))
        c = [F.length(three) - F.length(F.replace(three, F.lit(x))) for x in "hst~"]
        if majority:
            return F.when((c[0] >= c[1]) & (c[0] >= c[2]) & (c[0] >= c[3]), "h").when((c[1] >= c[2]) & (c[1] >= c[3]), "s").when(c[2] >= c[3], "t").otherwise("~")
        # the best so far and the number it must exceed, kind by kind
        state = F.struct(c[0].alias("must"), F.lit(0).alias("best"))
        counts = F.array(*c)
        last = F.aggregate(F.sequence(F.lit(1), F.lit(3)), state, lambda a, j: F.when(F.get(counts, j) > a["must"], F.struct(F.get(counts, a["best"]).alias("must"), j.alias("best"))).otherwise(a))
        return F.substring(F.lit("hst~"), last["best"] + 1, F.lit(1))

    return F.when(F.length(ss) >= 5, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), symbol), ""))
