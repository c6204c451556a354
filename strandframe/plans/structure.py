"""Chain measures on the driver tables: an embedding's 60 first values are the coordinates of a chain of 20 places."""
from pyspark.sql import functions as F

from strandframe.operators import aligned, densities, shapes, structure
from strandframe.operators.first_centroid import first_centroid_clusters

SCALE = 24.0


def chains(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    part = lambda k: F.transform(F.slice("embedding", k, 20), lambda x: x.cast("double") * SCALE)
    return e.select("vec_id", part(1).alias("xs"), part(21).alias("ys"), part(41).alias("zs"))


def distance_matrix(spark, d):
    return structure.distance_matrix(chains(spark, d), "vec_id").select("vec_id", "i", "j", F.round("dist", 4).alias("dist"))


def secondary_structure(spark, d):
    return chains(spark, d).select("vec_id", structure.secondary_structure(F.col("xs"), F.col("ys"), F.col("zs")).alias("ss"))


def half_spheres(spark, d):
    return structure.half_spheres(chains(spark, d), 12.0, "vec_id")


def _pairs(spark, d):
    """Each chain with the next one's number, and an alignment that leaves the ends out."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.lit("-" + "aB" + "C" * 17 + "D").alias("row_a"), F.lit("E" + "F" * 18 + "g-").alias("row_b"))


def dali_pairs(spark, d):
    out = aligned.dali_pairs(_pairs(spark, d), chains(spark, d), "vec_id", kind="long")
    return out.select("a", "b", "columns", *[F.round(c, 4).alias(c) for c in ("score", "z", "band")])


def frame_pairs(spark, d):
    out = aligned.frame_pairs(_pairs(spark, d), chains(spark, d), "vec_id", kind="long")
    return out.select("a", "b", F.round("tm", 6).alias("tm"), "path")


def _placed(spark, d):
    """Chains with motifs at places that go round with vec_id."""
    at = {"pos_a": 1, "pos_b": 8, "pos_c": 14}
    return chains(spark, d).select("*", *[(F.col("vec_id") % 3 + k).cast("int").alias(p) for p, k in at.items()])


def shape_profile(spark, d):
    """Mean and deviation of the 198 features over all chains."""
    return shapes.train(shapes.features(_placed(spark, d), "vec_id")).select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def shape_scores(spark, d):
    """How far every chain, in its motifs' frame, has the shape of all."""
    c = _placed(spark, d)
    return shapes.score(c, shapes.train(shapes.features(c, "vec_id")), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def side_spheres(spark, d):
    """Places in a sphere of radius 8 that touches each place of every chain on its side chain's side."""
    return densities.side_spheres(chains(spark, d), 8.0, "vec_id")


def cavity_numbers(spark, d):
    """Places between each place of every chain and the cavity of its motifs."""
    return densities.cavity_numbers(_placed(spark, d), "vec_id")


def first_centroids(spark, d):
    """Each embedding's centroid, all 64 values as points of three, by the order of vec_id."""
    out = first_centroid_clusters(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), 0.26, "vec_id", "embedding")
    return out.select("vec_id", "centroid", F.round("rms", 6).alias("rms"))


def tm_pairs(spark, d):
    """Each chain on the next one, both taken in frames of their own."""
    out = aligned.tm_pairs(_pairs(spark, d).select("a", "b"), chains(spark, d), "vec_id", kind="long")
    return out.select("a", "b", F.round("tm", 4).alias("tm"), "matched")


_P = f"SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) * {SCALE} AS x, CAST(embedding[i + 20] AS DOUBLE) * {SCALE} AS y, CAST(embedding[i + 40] AS DOUBLE) * {SCALE} AS z FROM embeddings, range(1, 21) r(i)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_SS = "abs(d13 - {0}) < {3} AND abs(d24 - {0}) < {3} AND abs(d35 - {0}) < {3} AND abs(d14 - {1}) < {3} AND abs(d25 - {1}) < {3} AND abs(d15 - {2}) < {3}"

QUERIES = {"distance_matrix": distance_matrix, "secondary_structure": secondary_structure, "half_spheres": half_spheres, "dali_pairs": dali_pairs, "frame_pairs": frame_pairs, "tm_pairs": tm_pairs, "first_centroids": first_centroids, "shape_profile": shape_profile, "shape_scores": shape_scores, "side_spheres": side_spheres, "cavity_numbers": cavity_numbers}
# smoothed points: steps -1 to 2 around (i + k) * 20 / 64, weighted by 2 less the distance from the exact place
_SHAPE = (
    f"p AS ({_P}), k AS (SELECT a.i, CAST(trunc((a.i + b.k) * 20 / 64.0 + 0.5) AS INTEGER) AS j, 2 - abs((a.i + b.k) * 20 / 64.0 - trunc((a.i + b.k) * 20 / 64.0 + 0.5)) AS w FROM range(0, 64) a(i), range(-1, 3) b(k)), "
    "s AS (SELECT vec_id, CAST(k.i AS INTEGER) AS i, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z FROM k JOIN p ON p.i = k.j + 1 GROUP BY vec_id, k.i), "
    "m AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) WHERE a.i = vec_id % 3 + 2 AND b.i = vec_id % 3 + 9 AND c.i = vec_id % 3 + 15), "
    "v AS (SELECT vec_id, format('{}{:02d}', ax, i) AS feature, v FROM (SELECT vec_id, i, unnest(['X', 'Y', 'Z']) AS ax, unnest([x, y, z]) AS v FROM s) "
    "UNION ALL SELECT vec_id, unnest(['LAB', 'LAC', 'LBC', 'dAB', 'dAC', 'dBC']), unnest([8.0, 14.0, 7.0, sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), sqrt((ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2), sqrt((bx - cx) ** 2 + (by_ - cy) ** 2 + (bz - cz) ** 2)]) FROM m), "
    "t AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS sd FROM v GROUP BY feature)"
)
SQL = {
    "side_spheres": f"WITH p AS ({_P}), d AS (SELECT *, 2 * x - lag(x) OVER w - lead(x) OVER w AS dx, 2 * y - lag(y) OVER w - lead(y) OVER w AS dy, 2 * z - lag(z) OVER w - lead(z) OVER w AS dz FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)), "
    "c AS (SELECT vec_id, i, x + 8 * dx / sqrt(dx * dx + dy * dy + dz * dz) AS cx, y + 8 * dy / sqrt(dx * dx + dy * dy + dz * dz) AS cy, z + 8 * dz / sqrt(dx * dx + dy * dy + dz * dz) AS cz FROM d) "
    "SELECT c.vec_id, c.i AS pos, count(p.i) AS n FROM c LEFT JOIN p ON p.vec_id = c.vec_id AND sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy) + (p.z - cz) * (p.z - cz)) <= 8 GROUP BY ALL",
    "cavity_numbers": f"WITH p AS ({_P}), m AS (SELECT a.vec_id, (a.x + b.x + c.x) / 3 AS mx, (a.y + b.y + c.y) / 3 AS my, (a.z + b.z + c.z) / 3 AS mz, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz "
    "FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) WHERE a.i = vec_id % 3 + 2 AND b.i = vec_id % 3 + 9 AND c.i = vec_id % 3 + 15), "
    "t AS (SELECT *, sqrt((bx - mx) ** 2 + (by_ - my) ** 2 + (bz - mz) ** 2) AS l FROM m), e AS (SELECT *, (bx - mx) / l AS ex, (by_ - my) / l AS ey, (bz - mz) / l AS ez FROM t), "
    "g AS (SELECT *, (ax - mx) * ex + (ay - my) * ey + (az - mz) * ez AS k FROM e), h AS (SELECT *, ax - mx - k * ex AS hx, ay - my - k * ey AS hy, az - mz - k * ez AS hz FROM g), "
    "o AS (SELECT vec_id, mx, my, mz, ex, ey, ez, hx / sqrt(hx * hx + hy * hy + hz * hz) AS nx, hy / sqrt(hx * hx + hy * hy + hz * hz) AS ny, hz / sqrt(hx * hx + hy * hy + hz * hz) AS nz FROM h), "
    "v AS (SELECT vec_id, mx + 3 * ex - 10 * (ey * nz - ez * ny) AS ox, my + 3 * ey - 10 * (ez * nx - ex * nz) AS oy, mz + 3 * ez - 10 * (ex * ny - ey * nx) AS oz FROM o), "
    "c AS (SELECT p.vec_id, p.i, (x + ox) / 2 AS cx, (y + oy) / 2 AS cy, (z + oz) / 2 AS cz, sqrt((x - ox) ** 2 + (y - oy) ** 2 + (z - oz) ** 2) / 4 AS r FROM p JOIN v USING (vec_id)) "
    "SELECT c.vec_id, c.i AS pos, count(p.i) AS n FROM c LEFT JOIN p ON p.vec_id = c.vec_id AND sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy) + (p.z - cz) * (p.z - cz)) <= r GROUP BY ALL",
    "shape_profile": f"WITH {_SHAPE} SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd FROM t",
    "shape_scores": f"WITH {_SHAPE}, c AS (SELECT *, (ax + bx + cx) / 3 AS mx, (ay + by_ + cy) / 3 AS my, (az + bz + cz) / 3 AS mz FROM m), "
    "e AS (SELECT *, (bx - mx) / sqrt((bx - mx) ** 2 + (by_ - my) ** 2 + (bz - mz) ** 2) AS e1x, (by_ - my) / sqrt((bx - mx) ** 2 + (by_ - my) ** 2 + (bz - mz) ** 2) AS e1y, (bz - mz) / sqrt((bx - mx) ** 2 + (by_ - my) ** 2 + (bz - mz) ** 2) AS e1z FROM c), "
    "g AS (SELECT *, (ax - mx) * e1x + (ay - my) * e1y + (az - mz) * e1z AS l FROM e), h AS (SELECT *, ax - mx - l * e1x AS hx, ay - my - l * e1y AS hy, az - mz - l * e1z AS hz FROM g), "
    "o AS (SELECT *, hx / sqrt(hx * hx + hy * hy + hz * hz) AS e2x, hy / sqrt(hx * hx + hy * hy + hz * hz) AS e2y, hz / sqrt(hx * hx + hy * hy + hz * hz) AS e2z FROM h), "
    "w AS (SELECT s.vec_id, format('{}{:02d}', unnest(['X', 'Y', 'Z']), s.i) AS feature, unnest([(x - mx) * e1x + (y - my) * e1y + (z - mz) * e1z, (x - mx) * e2x + (y - my) * e2y + (z - mz) * e2z, "
    "(x - mx) * (e1y * e2z - e1z * e2y) + (y - my) * (e1z * e2x - e1x * e2z) + (z - mz) * (e1x * e2y - e1y * e2x)]) AS v FROM s JOIN o USING (vec_id)) "
    "SELECT vec_id, round(avg(CASE WHEN sd > 0 THEN exp(-0.5 * ((v - mean) / sd) ** 2) ELSE CAST(v = mean AS DOUBLE) END), 6) AS score FROM w JOIN t USING (feature) GROUP BY vec_id",
    "distance_matrix": f"WITH p AS ({_P}) SELECT a.vec_id, a.i, b.i AS j, round({_D}, 4) AS dist FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i",
    "secondary_structure": f"WITH p AS ({_P}), q AS (SELECT a.vec_id, a.i, b.i AS j, {_D} AS d FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i BETWEEN a.i AND a.i + 4), "
    "s AS (SELECT m.vec_id, m.i, d13.d AS d13, d14.d AS d14, d15.d AS d15, d24.d AS d24, d25.d AS d25, d35.d AS d35 FROM p m "
    + " ".join(f"LEFT JOIN q {n} ON {n}.vec_id = m.vec_id AND {n}.i = m.i + {int(n[1]) - 3} AND {n}.j = m.i + {int(n[2]) - 3}" for n in ("d13", "d14", "d15", "d24", "d25", "d35"))
    + f"), c AS (SELECT vec_id, i, CASE WHEN d15 IS NULL THEN '~' WHEN {_SS.format(5.45, 5.18, 6.37, 2.1)} THEN 'h' WHEN {_SS.format(6.1, 10.4, 13.0, 1.42)} THEN 's' WHEN d15 < 8.2 THEN 't' ELSE '~' END AS c FROM s) "
    "SELECT vec_id, string_agg(c, '' ORDER BY i) AS ss FROM c GROUP BY vec_id",
    "half_spheres": f"WITH p AS ({_P}), s AS (SELECT a.vec_id, a.i, ((a.x - l.x) + (a.x - r.x)) * (b.x - a.x) + ((a.y - l.y) + (a.y - r.y)) * (b.y - a.y) + ((a.z - l.z) + (a.z - r.z)) * (b.z - a.z) AS side FROM p a "
    "JOIN p l ON l.vec_id = a.vec_id AND l.i = a.i - 1 JOIN p r ON r.vec_id = a.vec_id AND r.i = a.i + 1 "
    f"LEFT JOIN p b ON b.vec_id = a.vec_id AND b.i <> a.i AND {_D} <= 12.0) SELECT vec_id, i AS pos, CAST(count(*) FILTER (side > 0) AS INTEGER) AS up, CAST(count(*) FILTER (side <= 0) AS INTEGER) AS down FROM s GROUP BY vec_id, i",
    # columns 2 to 19 of row_a hold upper case (places 2 to 19 of a), on places 3 to 19 of b: those of both
    "dali_pairs": f"WITH p AS ({_P}), c AS (SELECT a.vec_id AS a, a.i, a.x, a.y, a.z, b.x AS x2, b.y AS y2, b.z AS z2 FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND b.i = a.i + 1 WHERE a.i BETWEEN 2 AND 18), "
    "q AS (SELECT a, i, j, CASE WHEN (u + v) / 2 = 0 THEN 0.2 WHEN (u + v) / 2 > 100 THEN 0 ELSE exp(-pow((u + v) / 40, 2)) * (0.2 - abs(u - v) / ((u + v) / 2)) END AS s FROM (SELECT l.a, l.i, r.i AS j, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)) AS u, sqrt(pow(l.x2 - r.x2, 2) + pow(l.y2 - r.y2, 2) + pow(l.z2 - r.z2, 2)) AS v FROM c l JOIN c r USING (a))), "
    "t AS (SELECT a, sum(s) AS score FROM q GROUP BY a), w AS (SELECT a, sum(m) AS band FROM (SELECT a, i, avg(s) AS m FROM q WHERE abs(i - j) <= 3 GROUP BY a, i) GROUP BY a), m AS (SELECT 7.9494 + 0.70852 * 20 + 2.5895e-4 * 400 - 1.9156e-6 * 8000 AS mean) "
    "SELECT a, a + 1 AS b, 17 AS columns, round(score, 4) AS score, round((score - mean) / greatest(1.0, 0.5 * mean), 4) AS z, round(band, 4) AS band FROM t JOIN w USING (a), m",
}
