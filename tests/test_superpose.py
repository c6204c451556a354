import itertools

import numpy as np
import pytest

from strandframe.functions import superpose as sp
from strandframe.operators import aligned


def walk(seed, n):
    steps = np.random.default_rng(seed).normal(size=(n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], 0)


def turned(p, seed, shift=9.0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0]
    return p @ (q * np.linalg.det(q)) + shift


def test_superposition_is_the_closest_and_no_mirror():
    rng = np.random.default_rng(1)
    x = walk(2, 30)
    y = turned(x, 3) + rng.normal(size=x.shape) * 0.5
    on = np.stack([np.ones(30, bool), np.arange(30) < 8])
    turn, shift = sp.superpose(x, y, on)
    np.testing.assert_allclose(turn @ turn.transpose(0, 2, 1), np.eye(3)[None].repeat(2, 0), atol=1e-12)
    np.testing.assert_allclose(np.linalg.det(turn), 1)
    for k in range(2):
        off = lambda t, s, k=k: ((x[on[k]] @ t.T + s - y[on[k]]) ** 2).sum()
        least = off(turn[k], shift[k])
        for _ in range(300):
            tilt = np.linalg.qr(np.eye(3) + rng.normal(size=(3, 3)) * 0.02)[0]
            tilt *= np.sign(np.diag(tilt))[None, :]
            assert off(tilt @ turn[k], shift[k] + rng.normal(size=3) * 0.01) >= least - 1e-9
    mirror = x * [1, 1, -1]
    turn, shift = sp.superpose(x, mirror, np.ones((1, 30), bool))
    assert np.linalg.det(turn[0]) > 0 and ((sp.moved(x, turn, shift)[0] - mirror) ** 2).sum() > 1


def slow_match(s, price):
    n, m = s.shape
    val, hit = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), bool)
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        d, u, v = val[i - 1, j - 1] + s[i - 1, j - 1], val[i - 1, j] + price * hit[i - 1, j], val[i, j - 1] + price * hit[i, j - 1]
        hit[i, j] = d >= u and d >= v
        val[i, j] = max(d, u, v)
    return val[n, m]


@pytest.mark.parametrize("price", [0.0, -0.6])
def test_matches_by_diagonals_equal_loops(price):
    rng = np.random.default_rng(4)
    s = rng.uniform(0, 1, (5, 9, 12)) ** 3
    to = sp.match(s, price)
    for k in range(5):
        at = np.flatnonzero(to[k] >= 0)
        assert (np.diff(to[k][at]) > 0).all()
        if price == 0:
            assert s[k][at, to[k][at]].sum() == pytest.approx(slow_match(s[k], 0.0))
        else:
            assert s[k][at, to[k][at]].sum() >= slow_match(s[k], price) - 1e-9


def test_known_turns_come_back():
    x = walk(5, 80)
    tm, rmsd, n, path = sp.tm_align(x, turned(x, 6))
    assert tm == pytest.approx(1) and rmsd < 1e-6 and n == 80 and path == "M" * 80
    y = np.concatenate([turned(x, 7), walk(8, 40) + 60])
    there, back = sp.tm_align(x, y), sp.tm_align(y, x)
    assert there[0] == pytest.approx(80 / 120, abs=0.02) and back[0] == pytest.approx(1, abs=0.02)  # a share of the second one's length
    cut = np.concatenate([x[:35], x[45:]])  # a gap of ten
    tm, rmsd, n, path = sp.tm_align(cut, turned(x, 9))
    assert tm > 0.84 and path.count("M") == n >= 68 and "IIIII" in path
    noisy = turned(x, 10) + np.random.default_rng(11).normal(size=x.shape) * 0.4
    assert 0.9 < sp.tm_align(x, noisy)[0] < 1 and sp.tm_align(x, walk(12, 80))[0] < 0.5


def test_score_search_beats_every_seed():
    x, y = walk(13, 40), turned(walk(13, 40), 14)
    y[20:] = turned(y[20:], 15)  # two halves that fit one at a time
    best, turn, shift = sp.best_superposition(x, y, 3.0, 40, 1)
    assert best >= 0.5
    d2 = ((sp.moved(x, turn[None], shift[None])[0] - y) ** 2).sum(-1)
    assert (1 / (1 + d2 / 9)).sum() / 40 == pytest.approx(best)
    for a in range(0, 37):
        t, s = sp.superpose(x, y, ((np.arange(40) >= a) & (np.arange(40) < a + 4))[None])
        assert (1 / (1 + ((sp.moved(x, t, s)[0] - y) ** 2).sum(-1) / 9)).sum() / 40 <= best + 1e-12


def test_pairs_are_rows(spark):
    x = walk(16, 60)
    rows = [("x", x), ("y", turned(x, 17)), ("part", turned(x[:40], 18)), ("two", x[:2]), ("nan", x * np.nan), ("none", x[:0])]
    chains = spark.createDataFrame([(k, *map(list, p.T.tolist()), 1) for k, p in rows] + [("null", None, None, None, 1)], "label string, xs array<double>, ys array<double>, zs array<double>, tm int")
    pairs = aligned.tm_grid(chains, chains.filter("label IN ('x', 'part')"))
    assert pairs.count() == 2 * 7 * 2 - 4
    got = {(r.a, r.b): r for r in aligned.tm_pairs(pairs, chains).collect()}
    assert set(got) == {(a, b) for a in ("x", "y", "part") for b in ("x", "y", "part") if {a, b} & {"x", "part"}}
    assert got["x", "part"].tm == pytest.approx(1, abs=1e-6) and got["part", "x"].tm == pytest.approx(2 / 3, abs=0.02)
    for (a, b), r in got.items():
        assert sp.tm_align(dict(rows)[a], dict(rows)[b])[0] == pytest.approx(r.tm)
        assert r.path.count("M") == r.matched and len(r.path.replace("I", "")) == len(dict(rows)[a]) and len(r.path.replace("D", "")) == len(dict(rows)[b])


def test_rotations_equal_singular_values():
    rng = np.random.default_rng(19)
    u, s, vt = np.linalg.svd(rng.normal(size=(400, 3, 3)))
    s *= np.repeat([[1, 1, 1], [1, 1, 0], [1, 1e-4, 1e-5], [1e9, 1e9, 1e9]], 100, 0)  # any, flat, thin, far out
    cov = (u * s[:, None, :]) @ vt
    u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
    got = sp._rotations(cov.transpose(1, 2, 0)).transpose(2, 0, 1)
    np.testing.assert_allclose(got, (u @ vt).transpose(0, 2, 1), atol=1e-8)
    line = sp._rotations(np.stack([np.zeros((3, 3)), np.outer([1.0, 2, 3], [3.0, 1, 2])], 2)).transpose(2, 0, 1)
    np.testing.assert_allclose(line @ line.transpose(0, 2, 1), np.eye(3)[None].repeat(2, 0), atol=1e-12)


def test_near_points_widen_by_halves():
    d2 = np.array([[1.0, 30.3, 1e14], [2, 9, 0], [50, 40, 1e12], [40, 90, 4]])
    for column in d2.T:
        wide = 3.0
        while wide < 50 and (column <= wide * wide).sum() < 3:
            wide += 0.5
        if wide < 50:
            assert (sp._near(column[:, None], 3.0)[:, 0] == (column <= wide * wide)).all()
    assert sp._near(d2, 3.0)[:, 2].tolist() == [False, True, True, True]  # a million steps of a half


def test_pairs_of_equal_lengths_go_together(monkeypatch):
    calls = []
    fill = sp._match
    monkeypatch.setattr(sp, "_match", lambda *a: calls.append(1) or fill(*a))
    x = np.stack([walk(100 + k, 20) for k in range(40)])
    y = np.stack([turned(walk(100 + k // 2 * 2, 23), k) if k % 3 else walk(300 + k, 23) for k in range(40)])
    x[7], y[7] = x[7] * 0, y[7] * 0 + 1e3  # all in one place
    alone = []
    for k in range(40):
        calls.clear()
        alone.append(sp.tm_align(x[k], y[k]))
    each = len(calls)
    calls.clear()
    together = sp.tm_aligns(x, y)
    assert len(calls) == each  # as many tables for forty pairs as for one
    monkeypatch.setattr(sp, "BLOCK", 5000)  # a pair's seeds lie in several portions
    parts = sp.tm_aligns(x, y)
    for one, many, part in zip(alone, together, parts, strict=True):
        assert one[2:] == many[2:] == part[2:] and many[:2] == pytest.approx(one[:2]) and part[:2] == pytest.approx(one[:2])
    assert len({t[2] for t in together}) > 3 and max(t[0] for t in together) > 0.8
