import numpy as np

from strandframe.functions.geometry import canonical_frame
from strandframe.operators import densities


def walk(seed, n):
    return np.cumsum(np.random.default_rng(seed).normal(size=(n, 3)) * 2, 0)


def test_counts_by_all_pairs(spark):
    rows = {"a": walk(1, 60), "b": walk(2, 35), "two": walk(3, 2), "line": np.arange(5)[:, None] * np.array([[1.0, 0, 0]]), "none": np.zeros((0, 3))}
    d = spark.createDataFrame([(k, *map(list, p.T.tolist() if len(p) else ([], [], [])), 3, 14, 27) for k, p in rows.items()], "label string, xs array<double>, ys array<double>, zs array<double>, pos_a int, pos_b int, pos_c int")
    got = {(r.label, r.pos): r.n for r in densities.side_spheres(d, 4.0).collect()}
    want = {}
    for k, p in rows.items():
        for i in range(len(p)):
            v = 2 * p[i] - p[i - 1] - p[i + 1] if 0 < i < len(p) - 1 else np.zeros(3)
            w = np.linalg.norm(v)
            want[k, i + 1] = int((np.linalg.norm(p - (p[i] + 4 * v / w), axis=1) <= 4).sum()) if w > 1e-12 else 0
    assert got == want and max(got.values()) > 1
    got = {(r.label, r.pos): r.n for r in densities.cavity_numbers(d).collect()}
    want = {}
    for k in "ab":
        p = rows[k]
        shift, axes = canonical_frame(p[3], p[14], p[27])
        o = -shift + 3 * axes[0] - 10 * axes[2]
        for i in range(len(p)):
            c = (p[i] + o) / 2
            want[k, i + 1] = int((np.linalg.norm(p - c, axis=1) <= np.linalg.norm(p[i] - c) / 2).sum())
    assert got == want and max(got.values()) > 0
    assert densities.side_spheres(d.limit(0), 4.0).collect() == []


def test_long_chains_by_all_pairs(monkeypatch):
    monkeypatch.setattr(densities, "PAIRS", 500)
    p = walk(5, 700)
    c, r = p[::3] + 1.5, np.random.default_rng(6).uniform(0.01, 9, 234)
    c[4], r[7] = np.nan, np.nan
    want = [int((np.linalg.norm(p - x, axis=1) <= v).sum()) if v == v and (x == x).all() else 0 for x, v in zip(c, r, strict=True)]
    assert densities.sphere_counts(p, c, r).tolist() == want and max(want) > 20
    for some in (1, 500):
        monkeypatch.setattr(densities, "PAIRS", some)
        assert densities.sphere_counts(p[:40], c[:3], r[:3]).tolist() == [int((np.linalg.norm(p[:40] - x, axis=1) <= v).sum()) for x, v in zip(c[:3], r[:3], strict=True)]


def test_plan_stays_small(spark):
    """Centres written out for each of 27 cells made a plan that filled the driver."""
    d = spark.createDataFrame([("a", [1.0], [1.0], [1.0])], "label string, xs array<double>, ys array<double>, zs array<double>")
    assert len(densities.side_spheres(d, 4.0)._jdf.queryExecution().optimizedPlan().toString()) < 5_000
