import numpy as np
import pytest

from strandframe.operators import cores


def walk(seed, n):
    steps = np.random.default_rng(seed).normal(size=(n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], 0)


def frame(spark, rows):
    return spark.createDataFrame([(k, s, a, b, c, *map(list, p.T.tolist())) for k, s, p, (a, b, c) in rows], "label string, seq string, pos_a int, pos_b int, pos_c int, xs array<double>, ys array<double>, zs array<double>")


def test_cores_are_rigid_and_in_their_frame(spark, tmp_path):
    seq = "".join(np.random.default_rng(1).choice(list("ACDEFG"), 120))
    p = walk(2, 120)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    turned = p @ (q * np.linalg.det(q)) - 30
    d = frame(spark, [("one", seq, p, (10, 40, 90)), ("turned", seq, turned, (10, 40, 90))])
    got = {r.label: r for r in cores.cores(d).collect()}
    for r in got.values():
        x = np.array([r.xs, r.ys, r.zs]).T
        assert r.seq == seq[10:98] and (r.pos_a, r.pos_b, r.pos_c) == (0, 30, 80) and len(x) == 88
        np.testing.assert_allclose(np.linalg.norm(x[:, None] - x[None], axis=-1), np.linalg.norm(p[10:98][:, None] - p[10:98][None], axis=-1), atol=1e-9)
        tri = x[[0, 30, 80]]
        np.testing.assert_allclose(tri.mean(0), 0, atol=1e-9)
        np.testing.assert_allclose([tri[1, 1], tri[1, 2], tri[0, 2]], 0, atol=1e-9)
        assert tri[1, 0] > 0 and tri[0, 1] > 0
    np.testing.assert_allclose(got["one"].xs, got["turned"].xs, atol=1e-9)
    whole = {r.label: r for r in cores.in_frame(d).collect()}
    np.testing.assert_allclose(whole["one"].zs[10:98], got["one"].zs, atol=1e-12)
    assert len(whole["one"].xs) == 120 and whole["one"].pos_b == 40
    c = cores.cores(d)
    cores.core_text(c).write.text(f"{tmp_path}/ppc")
    head = [r.value for r in spark.read.text(f"{tmp_path}/ppc").collect() if r.value.startswith(">one")]
    assert head == [f">one A:1:{seq[10:22]} B:31:{seq[40:54]} C:81:{seq[90:98]}"]
    back = {r.label: r for r in cores.read_cores(spark, f"{tmp_path}/ppc").collect()}
    for k, r in got.items():
        assert (back[k].seq, back[k].pos_a, back[k].pos_b, back[k].pos_c) == (r.seq, 0, 30, 80)
        np.testing.assert_allclose(back[k].ys, r.ys, atol=6e-4)
    assert cores.faults(c, core=True).count() == 0 and {r.fault for r in cores.faults(d, core=True).collect()} == {"A is not first"}
    cores.core_text(d).write.text(f"{tmp_path}/whole")
    with pytest.raises(Exception, match="not a core"):
        cores.read_cores(spark, f"{tmp_path}/whole").collect()
    assert cores.read_cores(spark, f"{tmp_path}/whole", strict=False).count() == 2


def test_faults(spark):
    p, s = walk(5, 60), "A" * 60
    rows = [("none", s, p, (None, 20, 40)), ("ab", s, p, (10, 22, 45)), ("bc", s, p, (0, 20, 34)), ("end", s, p, (0, 20, 53)), ("short", s, p[:50], (0, 20, 40)), ("minus", s, p, (-1, 20, 40)), ("ok", s, p, (0, 20, 40))]
    d = frame(spark, rows)
    assert {r.label: r.fault for r in cores.faults(d).collect()} == {"none": "no motifs", "ab": "A meets B", "bc": "B meets C", "end": "C leaves the chain", "short": "places and letters differ", "minus": "no motifs"}
    assert [r.label for r in cores.cores(d).collect()] == ["ok"] and cores.cores(d.limit(0)).collect() == []
    assert {r.label: r.fault for r in cores.faults(d.filter("label = 'ok'"), core=True).collect()} == {"ok": "C is not last"}
