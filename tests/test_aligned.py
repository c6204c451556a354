import numpy as np
import pytest

from strandframe.functions import align
from strandframe.operators import aligned


def brute_global(s, go, ge, eo):
    la, lb = s.shape
    best = {}

    def f(r, c, state):  # best score of the first r and c places that ends in state
        if (r, c, state) in best:
            return best[r, c, state]
        out = -np.inf
        if (r, c) == (0, 0):
            out = 0.0 if state == "M" else -np.inf
        elif state == "M" and r and c:
            out = max(f(r - 1, c - 1, x) for x in "MDI") + s[r - 1, c - 1]
        elif state == "D" and r:
            out = max(f(r - 1, c, "M") + (eo if c in (0, lb) else go), f(r - 1, c, "D") + ge)
        elif state == "I" and c:
            out = max(f(r, c - 1, "M") + (eo if r in (0, la) else go), f(r, c - 1, "I") + ge)
        best[r, c, state] = out
        return out

    return max(f(la, lb, x) for x in "MDI")


def priced(s, path, go, ge, eo):
    la, lb = s.shape
    r = c = 0
    total, before = 0.0, "M"
    for x in path:
        if x == "M":
            total += s[r, c]
            r, c = r + 1, c + 1
        elif x == "D":
            total += ge if before == "D" else eo if c in (0, lb) else go
            r += 1
        else:
            total += ge if before == "I" else eo if r in (0, la) else go
            c += 1
        before = x
    assert (r, c) == (la, lb)
    return total


@pytest.mark.parametrize("seed", range(12))
def test_global_path_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=(rng.integers(1, 9), rng.integers(1, 9)))
    score, path = align.global_path(s)
    assert abs(score - brute_global(s, -2.0, -0.5, -0.5)) < 1e-9 and abs(priced(s, path, -2.0, -0.5, -0.5) - score) < 1e-9


@pytest.mark.parametrize("seed", range(8))
def test_local_score_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=(rng.integers(1, 9), rng.integers(1, 9))) * 4
    m, d, i = (np.full((s.shape[0] + 1, s.shape[1] + 1), v) for v in (0.0, -np.inf, -np.inf))
    for r in range(1, s.shape[0] + 1):
        for c in range(1, s.shape[1] + 1):
            m[r, c] = max(0, max(0, m[r - 1, c - 1], d[r - 1, c - 1], i[r - 1, c - 1]) + s[r - 1, c - 1] - 0.5)
            d[r, c] = max(m[r - 1, c] - 5, d[r - 1, c] - 0.5)
            i[r, c] = max(m[r, c - 1] - 5, i[r, c - 1] - 0.5)
    assert abs(align.smith_waterman(s)[0] - m.max()) < 1e-9


def test_pairs(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 3)).cumsum(0) * 3
    b = np.r_[a[:10], a[14:]] + 0.01  # four places less
    rows = [("a", *a.T.tolist()), ("b", *b.T.tolist()), ("c", [], [], []), ("d", None, None, None)]
    chains = spark.createDataFrame(rows, "label string, xs array<double>, ys array<double>, zs array<double>")
    pairs = spark.createDataFrame([(x, y) for x in "abcd" for y in "abcde"], "a string, b string")
    got = {(r.a, r.b): r for r in aligned.frame_pairs(pairs, chains).collect()}
    assert set(got) == {(x, y) for x in "ab" for y in "ab"} and got["a", "a"].path == "M" * 30 and abs(got["a", "a"].tm - 1) < 1e-9
    assert got["a", "b"].path == "M" * 10 + "DDDD" + "M" * 16 and got["b", "a"].path == "M" * 10 + "IIII" + "M" * 16
    best = {r.label: r.ref for r in aligned.frame_search(chains, [("x", a), ("y", b)]).collect()}
    assert best == {"a": "x", "b": "y"}
    assert align.rows("MDIM", "xyz", "uvw") == ("xy-z", "u-vw")
    vecs = spark.createDataFrame([("a", [[0.0, 1.0], [0.5, 0.5], [9.0, 9.0]]), ("b", [[0.0, 1.0], [9.0, 9.0]])], "label string, vecs array<array<double>>")
    one = aligned.vector_pairs(spark.createDataFrame([("a", "b")], "a string, b string"), vecs).first()
    assert one.path in ("MDM", "MMD", "DMM") and abs(one.score - max(0.0, one.score)) < 1e-9
    odds = np.zeros((2, 8, 8))
    odds[:, range(8), range(8)] = 6.0
    bins = spark.createDataFrame([("a", [[1, 2], [3, None], [4, 4], [5, 5]]), ("b", [[4, 4], [5, 5]])], "label string, bins array<array<int>>")
    two = aligned.profile_pairs(spark.createDataFrame([("a", "b")], "a string, b string"), bins, odds).first()
    assert (two.start_a, two.start_b, two.path, two.score) == (3, 1, "MM", 11.0)


def test_dali():
    a = np.random.default_rng(2).normal(size=(9, 3)) * 5
    b = a + 0.3
    s = align.dali_pair(align.distances(a, a), align.distances(b, b))
    assert abs(align.dali_score(a, b) - s.sum()) < 1e-9
    band = [np.mean([s[k, j] for j in range(9) if abs(j - k) <= 2]) for k in range(9)]
    assert np.allclose(align.dali_band(a, b, 2), band)
    assert align.dali_z(1000.0, 500, 500) < align.dali_z(1000.0, 400, 400)


def test_frame_pairs_query(spark):
    from strandframe.plans import structure as plans

    d = "/root/testdata/sf0.001"
    at = {r.vec_id: np.array([r.xs, r.ys, r.zs]).T for r in plans.chains(spark, d).collect()}
    got = plans.frame_pairs(spark, d).collect()
    assert {(r.a, r.b) for r in got} == {(k, k + 1) for k in at if k + 1 in at}
    for r in got[:5]:
        s = align.frame_similarity(align.distances(at[r.a], at[r.b]))
        assert abs(priced(s, r.path, -2.0, -0.5, -0.5) - brute_global(s, -2.0, -0.5, -0.5)) < 1e-6
        i, j = align.columns(r.path)
        close = [x for x in s[i, j] if x >= align.frame_similarity(12.0)]
        assert abs(r.tm - (np.mean(close) if close else 0.0)) < 1e-6
