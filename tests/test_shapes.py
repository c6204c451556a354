import numpy as np
import pytest

from strandframe.functions.geometry import canonical_frame
from strandframe.operators import shapes


def walk(seed, n=130):
    steps = np.random.default_rng(seed).normal(size=(n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], 0)


def smooth(c, i):
    n, s, w = len(c), 0.0, 0.0
    for k in range(-1, 3):
        exact = (i + k) * n / 64
        near = int(exact + 0.5)
        if 0 <= near < n:
            s, w = s + (2 - abs(exact - near)) * c[near], w + 2 - abs(exact - near)
    return s / w


def frame(spark, rows):
    return spark.createDataFrame([(k, seq, *map(list, p.T.tolist() if len(p) else ([], [], [])), a, b, c) for k, seq, p, (a, b, c) in rows], "label string, seq string, xs array<double>, ys array<double>, zs array<double>, pos_a int, pos_b int, pos_c int")


AT = (10, 50, 100)


def letters(n=130):
    s = list("A" * n)
    for a, (x, o) in zip(AT, (("D", 3), ("G", 1), ("D", 3)), strict=True):
        s[a + o] = x
    return "".join(s)


def test_features_and_scores_by_hand(spark, tmp_path):
    base = walk(1)
    rows = []
    for k in range(5):
        p = base + np.random.default_rng(10 + k).normal(size=base.shape) * 0.3
        t, r = canonical_frame(*(p[a] for a in AT))
        rows.append((f"c{k}", letters(), (p + t) @ r.T, AT))
    d = frame(spark, rows)
    got = {(r.label, r.feature): r.value for r in shapes.features(d).collect()}
    assert len(got) == 5 * 198 and {f for _, f in got} == set(shapes.FEATURES)
    for k, _, p, (a, b, c) in rows:
        assert [got[k, f] for f in shapes.GAPS] == pytest.approx([b - a + 1, c - a + 1, c - b + 1, *(np.linalg.norm(p[i] - p[j]) for i, j in ((a, b), (a, c), (b, c)))])
        for x, axis in enumerate("XYZ"):
            assert [got[k, f"{axis}{i:02d}"] for i in range(64)] == pytest.approx([smooth(p[:, x], i) for i in range(64)])
    prof = shapes.train(shapes.features(d))
    stat = {r.feature: (r.mean, r.sd) for r in prof.collect()}
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    turned = rows[0][2] @ (q * np.linalg.det(q)) + 40
    other = walk(2)
    t = frame(spark, [rows[0], ("turned", letters(), turned, AT), ("other", letters(), other, AT), ("out", letters(), other, (10, 50, 130)), ("none", "", base[:0], AT)])
    score = {r.label: r.score for r in shapes.score(t, prof).collect()}
    assert set(score) == {"c0", "turned", "other"} and score["turned"] == pytest.approx(score["c0"]) and score["other"] < 0.5 < score["c0"]
    s, r = canonical_frame(*(other[a] for a in AT))
    pts = (np.array([[smooth(other[:, x], i) for x in range(3)] for i in range(64)]) + s) @ r.T
    want = np.mean([np.exp(-0.5 * ((pts[i, x] - stat[f"{a}{i:02d}"][0]) / stat[f"{a}{i:02d}"][1]) ** 2) for x, a in enumerate("XYZ") for i in range(64)])
    assert score["other"] == pytest.approx(want)
    lines = shapes.profile_lines("all", prof)
    name, back = shapes.read_profile(spark, lines)
    assert name == "all" and shapes.profile_lines(name, back) == lines and len(lines) == 199 and lines[1].startswith("LAB\t41\t0")
    with pytest.raises(ValueError):
        shapes.read_profile(spark, lines[:-1])
    with pytest.raises(ValueError):
        shapes.read_profile(spark, [lines[0], *lines[2:], lines[1]])
    # the search finds the triangle by itself, and wants its letters
    dist = {m: np.linalg.norm(rows[0][2][i] - rows[0][2][j]) for m, i, j in (("ab", 10, 50), ("bc", 50, 100), ("ac", 10, 100))}
    stats = {m: (g, 2.0, dist[m], 0.5) for m, g in (("ab", 40), ("bc", 50), ("ac", 90))}
    found = frame(spark, [rows[0], ("plain", "A" * 130, rows[0][2], AT)]).drop("pos_a", "pos_b", "pos_c")
    got = {r.label: r.score for r in shapes.search(found, prof, stats).collect()}
    assert got["plain"] == 0 and got["c0"] == pytest.approx(score["c0"])
