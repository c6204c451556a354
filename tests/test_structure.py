import itertools

import duckdb
import numpy as np
import pytest

from strandframe.operators import structure as st
from strandframe.plans import structure as plans


def walk(seed, n=130):
    steps = np.random.default_rng(seed).normal(size=(n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], 0)


def frame(spark, rows):
    return spark.createDataFrame([(k, "A" * len(p), *map(list, p.T.tolist() if len(p) else ([], [], []))) for k, p in rows], "label string, seq string, xs array<double>, ys array<double>, zs array<double>")


def test_triangle_search_finds_a_moved_reference(spark):
    p = walk(1)
    ref = st.Reference("r", p, 5, 50, 100)
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))[0]
    moved = p @ (turn * np.linalg.det(turn)) + 7
    got = {r.label: r for r in st.triangle_search(frame(spark, [("same", moved), ("empty", np.zeros((0, 3))), ("other", walk(9))]), [ref]).collect()}
    assert (got["same"].pos_a, got["same"].pos_b, got["same"].pos_c) == (6, 51, 101) and got["same"].rmsd < 1e-6
    assert "empty" not in got


def test_triangles_equal_brute_force():
    p, lim = walk(3), st.Limits(side=6.0, squares=60.0, rmsd=50.0)
    ref = st.Reference("r", walk(4), 2, 40, 90)
    q = [np.linalg.norm(ref.points[i] - ref.points[j]) for i, j in ((2, 40), (40, 90), (2, 90))]
    best = None
    for a, b, c in itertools.combinations(range(len(p)), 3):
        if b - a < 10 or not 10 <= c - b <= 80 or not 80 <= c - a <= 200 or c + 8 > len(p):
            continue
        d = [np.linalg.norm(p[i] - p[j]) - x for (i, j), x in zip(((a, b), (b, c), (a, c)), q, strict=True)]
        if max(map(abs, d)) <= 6 and sum(x * x for x in d) < 60:
            r = st.motif_rmsd(st.motif_points(p, a, b, c), ref.motifs())
            if r < 50 and (best is None or r < best[0]):
                best = (r, a, b, c)
    got = st.match_triangle(p, ref, lim)
    assert (got is None) == (best is None) and (best is None or got[1:] == best[1:])


def test_find_triangles(spark):
    p = walk(5)
    d = lambda i, j: float(np.linalg.norm(p[i] - p[j]))
    stats = {"ab": (45, 2.0, d(5, 50), 0.5), "bc": (50, 2.0, d(50, 100), 0.5), "ac": (95, 2.0, d(5, 100), 0.5)}
    r = st.find_triangles(frame(spark, [("x", p)]), stats).first()
    assert (r.pos_a, r.pos_b, r.pos_c) == (6, 51, 101) and r.score == pytest.approx(1)


def test_contact_maps(spark):
    p = walk(6)
    rows = frame(spark, [("x", p)]).selectExpr("*", "6 AS pos_a", "51 AS pos_b", "101 AS pos_c")
    got = {(r.i, r.j): r.value for r in st.contact_maps(rows).collect()}
    assert len(got) == 34 * 33 // 2 and got[13, 1] == pytest.approx(np.linalg.norm(p[50] - p[5]))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = plans.QUERIES[name](spark, d)
    want = db.execute(plans.SQL[name]).df()[sorted(got.columns)]
    got = got.select(sorted(got.columns)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got)
    if name == "secondary_structure":
        assert set("".join(got.ss)) >= {"~", "t"}
