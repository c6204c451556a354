import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import rolling_median as rm

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, us string, n int"
T0 = dt.datetime(2024, 3, 1)


def middle2(x):
    x = sorted(x)
    return x[(len(x) - 1) // 2] + x[len(x) // 2]


def brute(rows, minutes=60):
    """click_id: (kind, n, median2, mad4, far), straight from the definition."""
    once = {r[0]: r for r in rows if r[1] is not None}
    series = defaultdict(list)
    for r in once.values():
        ok = r[5] is not None and np.isfinite(r[5])
        series[r[4]].append((r[1], int(np.floor(100 * r[5] + 0.5)) if ok else None, r[0]))
    out = {}
    for kind, s in series.items():
        for ts, c, i in s:
            w = [x for t, x, _ in s if x is not None and ts - dt.timedelta(minutes=minutes) <= t <= ts]
            m = d = far = None
            if len(w) > 1:
                m = middle2(w)
                d = middle2([abs(2 * x - m) for x in w])
                far = None if c is None else 2 * abs(2 * c - m) > 3 * d
            out[i] = (kind, len(w), m, d, far)
    return out


def clicks(n, seed, minutes, kinds=("a", "b", None, "")):
    rng, out = random.Random(seed), []
    for i in range(n):
        ts = None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=rng.choice((0.000001, 1)) * rng.randrange(minutes * 60))
        value = rng.choice((None, 0.0, 1e-9, -5.005, rng.gauss(40, 30), rng.gauss(40, 30), 3e5, float("nan"), float("inf")))
        out.append((i * 7 - 50, ts, T0, 1, rng.choice(kinds), value, "{}", "x", 1))
    return out + [r for r in out if rng.random() < 0.1]


def got(spark, rows, **how):
    once = rm.clicks_once(spark.createDataFrame(rows, SCHEMA))
    points = once.groupBy("kind", "us", "cents").agg(F.count("cents").alias("n"))
    w = rm.rolling(points, **how).withColumnRenamed("kind", "k").withColumnRenamed("us", "u")
    j = once.join(w, F.col("kind").eqNullSafe(F.col("k")) & (F.col("us") == F.col("u"))).collect()
    return {r.click_id: (r.kind, r.n, r.median2, r.mad4, None if r.median2 is None or r.cents is None else 2 * abs(2 * r.cents - r.median2) > 3 * r.mad4) for r in j}


@pytest.mark.parametrize("seed, minutes, how", [(1, 4000, {}), (2, 90, {}), (3, 300, {"length": rm.WINDOW}), (4, 200, {"block": 40, "lane": 3}), (5, 70, {"length": 7 * rm.MINUTE, "block": 25, "lane": 1})])
def test_against_brute_force(spark, seed, minutes, how):
    rows = clicks(700, seed, minutes)
    assert got(spark, rows, **how) == brute(rows)


def test_one_moment_and_equal_values(spark):
    rows = [(i, T0, T0, 1, None, 2.0, "", "", 0) for i in range(300)] + [(1000 + i, T0 + dt.timedelta(minutes=60, microseconds=i), T0, 1, None, float(i), "", "", 0) for i in range(3)]
    assert got(spark, rows, block=50) == brute(rows)


def test_large_trees_take_few_lanes(spark, monkeypatch):
    monkeypatch.setattr(rm, "CELLS", 2000)
    rows = clicks(500, 9, 100, kinds=("a",))
    assert got(spark, rows) == brute(rows)


def test_query_and_edges(spark, tmp_path):
    rows = clicks(400, 6, 500) + [(None, T0, T0, 1, "a", 1.0, "", "", 0)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/clicks.parquet")
    want = brute(rows)
    assert {r.click_id: tuple(r)[1:] for r in rm.op12(spark, str(tmp_path)).collect()} == want
    assert rm.op12(spark, str(tmp_path)).columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    for name, some in (("none", []), ("no_ts", [(1, None, T0, 1, "a", 1.0, "", "", 0)])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{name}/clicks.parquet")
        assert rm.op12(spark, f"{tmp_path}/{name}").collect() == []


def test_rows_that_differ_under_one_id(spark):
    rows = [(1, T0, T0, 1, "a", 3.0, "", "", 0), (1, None, T0, 1, "a", 1.0, "", "", 0), (1, T0, T0, 1, "a", None, "", "", 0), (1, T0, T0, 1, None, 1.0, "", "", 0)]
    assert [tuple(r) for r in rm.clicks_once(spark.createDataFrame(rows, SCHEMA)).select("kind", "cents").collect()] == [("a", 300)]


def test_chunks_get_shorter_where_rows_are_dense(spark):
    few = spark.range(100).select((F.col("id") * rm.WINDOW).alias("us"))
    many = spark.range(100_000).select((F.col("id") * (rm.MINUTE // 100)).alias("us"))
    assert rm.chunk_length(few) == rm.LONGEST and rm.WINDOW < rm.chunk_length(many) < 16385 * (rm.MINUTE // 100) and rm.chunk_length(few.limit(0)) == rm.LONGEST
