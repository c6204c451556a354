import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import contacts
from strandframe.operators import six_motifs as six
from strandframe.sources import readers

N, SIZES = 190, (7, 12, 14, 10, 7, 7)
AT = (4, 40, 80, 115, 140, 160)


def chain(seed, shift=0):
    rng = np.random.default_rng(seed)
    p = np.cumsum(np.random.default_rng(0).normal(size=(N, 3)) * 2 + [0.7, 0, 0], 0) + rng.normal(size=(N, 3)) * 0.7
    seq = rng.choice(list("ADGRK"), N)
    for (letter, off), a in zip(six.ANCHORS, AT, strict=True):
        if letter != "x":
            seq[a + off] = letter
    return "".join(seq), np.roll(p, shift, 0)


def frame(spark, rows):
    cols = [c for m in six.MOTIFS for c in (f"pos_{m} int", f"seq_{m} string")]
    at = lambda s: [v for a, n in zip(AT, SIZES, strict=True) for v in (a + 1, s[a : a + n])]
    return spark.createDataFrame([(k, s, *map(list, p.T.tolist()), *at(s)) for k, (s, p) in rows.items()], "label string, seq string, xs array<double>, ys array<double>, zs array<double>, " + ", ".join(cols))


def slow(seq, p, prof):
    """The stepwise search by loops over places, one block at a time."""
    off = np.cumsum((0, *SIZES))

    def block(k, m, s, t):
        v = []
        for i in range(SIZES[k]):
            for j in range(i if k == m else SIZES[m]):
                mu, w = prof.mean[off[k] + i, off[m] + j], (1.5 if k == m else 2) * prof.sd[off[k] + i, off[m] + j]
                v.append(math.exp(-0.5 * ((math.dist(p[s + i], p[t + j]) - mu) / w) ** 2))
        return sum(v) / len(v)

    total = lambda at: sum(block(k, m, at[k], at[m]) for k in at for m in at) / len(at) ** 2
    n, hits, last = len(seq), [], None
    good = lambda k, a: six.ANCHORS[k][0] in ("x", seq[a + six.ANCHORS[k][1]]) and block(k, k, a, a) >= six.LEAST_SCORE[k]
    for k in (1, 2, 3):
        end = n - sum(six.LEAST_WAY[i] + 1 for i in range(k, 6))
        lo, hi = (0, end) if last is None else (last[0] + six.LEAST_WAY[k - 1], min(last[1] + six.MOST_WAY[k - 1], end))
        kept = []
        for a in range(lo, hi + 1):
            if good(k, a):
                x = block(k, k, a, a)
                if kept and a - kept[-1][0] < 10:
                    if x > kept[-1][1]:
                        kept[-1] = (a, x)
                else:
                    kept.append((a, x))
        if not kept:
            return None
        hits.append([a for a, _ in kept])
        last = kept[0][0], kept[-1][0]
    best = (0, None)
    for c, b, a in itertools.product(*hits[::-1]):
        if (t := total({1: a, 2: b, 3: c})) > best[0] + 1e-12:
            best = (t, {1: a, 2: b, 3: c})
    at = best[1]
    for k, lo, hi in ((0, 0, at[1] - 30), (4, at[3] + 10, at[3] + 70), (5, None, None)):
        if k == 5:
            lo, hi = at[4] + 4, at[4] + 70
        if k:
            hi = min(hi, n - SIZES[k] - 1)
        top = (0, None)
        for a in range(lo, hi + 1):
            if good(k, a) and (t := total(at | {k: a})) > top[0] + 1e-12:
                top = (t, a)
        if top[1] is None:
            return None
        at[k] = top[1]
    return top[0], *(at[k] for k in range(6))


def test_search_equals_loops(spark):
    rows = {f"c{k}": chain(k) for k in range(8)} | {"moved": chain(20, 9), "tail": (chain(21)[0][:150], chain(21)[1][:150]), "short": (chain(22)[0][:60], chain(22)[1][:60])}
    d = frame(spark, {k: v for k, v in rows.items() if k[0] == "c"})
    p = six.Profile.of(contacts.train(six.cells(d)))
    got = {r.label: r for r in six.search(frame(spark, rows), p, 0.0).collect()}
    want = {k: w for k, (s, x) in rows.items() if (w := slow(s, x, p))}
    assert got.keys() == want.keys() and len(got) >= 8
    for k, w in want.items():
        r = got[k]
        assert [r[f"pos_{m}"] - 1 for m in six.MOTIFS] == list(w[1:]) and r.score == pytest.approx(w[0], abs=1e-9)
        assert r.seq_a == rows[k][0][w[2] : w[2] + 12] and r.gate == r.seq_a[8] and r.final_score == pytest.approx(r.score * r.p_rdrp)
    assert {r.label for r in six.search(frame(spark, rows), p, 0.05).collect()} == {k for k, r in got.items() if r.final_score >= 0.05}


def test_training_reader_and_format(spark, tmp_path):
    rows = {f"c{k}": chain(30 + k) for k in range(4)}
    d = frame(spark, rows)
    lines = []
    for k, (s, _) in rows.items():
        f = [v for a, n in zip(AT, SIZES, strict=True) for v in (str(a + 1), s[a : a + n])]
        lines.append("\t".join([k, *(f[:10] + [".", "."] if k == "c3" else f)]))
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    coords = readers.six_motif_coords(spark, str(tmp_path / "m.tsv"))
    assert coords.filter("label = 'c0'").first()["seq_b"] == rows["c0"][0][80:94] and coords.filter("pos_e IS NULL AND seq_e IS NULL").count() == 1
    t = d.select("label", "seq", "xs", "ys", "zs").join(coords, "label")
    assert six.faults(t).count() == 0 and [r.motifs for r in six.faults(t.withColumn("seq_b", F.lit("X")).limit(1)).collect()] == ["b"]
    p = six.Profile.of(contacts.train(six.cells(t)))
    at = [a + i for a, n in zip(AT, SIZES, strict=True) for i in range(n)]
    each = [np.sqrt(((x[at][:, None] - x[at][None]) ** 2).sum(-1)) for _, x in rows.values()]
    np.testing.assert_allclose(p.mean[:50, :50], np.mean(each, 0)[:50, :50], atol=1e-9)
    np.testing.assert_allclose(p.mean[50:, 1], np.mean(each[:3], 0)[50:, 1], atol=1e-9)
    np.testing.assert_allclose(p.sd[50:, 1], np.std(each[:3], 0)[50:, 1], atol=1e-9)
    assert {r.motif: (r.least, r.most) for r in six.ways(t).collect()} == {m: (b - a, b - a) for m, a, b in zip(six.MOTIFS, AT, AT[1:], strict=False)}
    text = six.profile_lines(p)
    assert text[0] == "cdinfo\t6" and text[1] == "0\t7\tF2" and text[7] == "cddata\tavg\t57" and text[8].startswith("F2\t1\tF2\t0\t")
    back = six.read_profile(text)
    np.testing.assert_allclose(back.mean, p.mean, rtol=6e-4)
    assert six.profile_lines(back) == text
    for bad in (text[1:], text[:-1], text[:9] + text[10:] + text[9:10]):
        with pytest.raises(ValueError):
            six.read_profile(bad)
    with pytest.raises(ValueError):
        six.Profile.of(contacts.train(six.cells(t.filter("pos_e IS NULL"))))


def test_few_triples_are_scored(monkeypatch):
    """All pairs with C and all triples were scored, which a long text does not end; equal to all triples here."""
    from strandframe.plans.contacts import walk

    rng = np.random.default_rng(11)
    s = "".join(rng.choice(list("ADGKRSTV"), 1500))
    p = np.stack(walk(s), 1)
    at = np.concatenate([np.arange(x, x + n) for x, n in zip((11, 61, 131, 181, 221, 251), six.SIZES, strict=True)])
    mean = np.sqrt(((p[at][:, None] - p[at][None]) ** 2).sum(-1))
    chain = six._Chain(s, p, six.Profile(mean, np.full(mean.shape, 2.0)))
    met = []
    one = chain.s.cross
    monkeypatch.setattr(chain.s, "cross", lambda k, m, x, y: met.append((m, len(x))) or one(k, m, x, y))
    got = chain.triple()
    few = sum(n for m, n in met if m == 3)
    # the same thinned candidates, and every triple of them
    end = [chain.n - sum(w + 1 for w in six.LEAST_WAY[k:]) for k in (1, 2, 3)]
    a, xa = chain.thin(1, 0, end[0])
    b, xb = chain.thin(2, int(a[0]) + six.LEAST_WAY[1], min(int(a[-1]) + six.MOST_WAY[1], end[1]))
    c, xc = chain.thin(3, int(b[0]) + six.LEAST_WAY[2], min(int(b[-1]) + six.MOST_WAY[2], end[2]))
    ab, bc, ac = chain.grid(1, 2, a, b).T, chain.grid(2, 3, b, c), chain.grid(1, 3, a, c)
    total = (xb[:, None] + xa[None] + 2 * ab)[None] + xc[:, None, None] + 2 * (bc.T[:, :, None] + ac.T[:, None, :])
    k, j, i = np.unravel_index(int(total.argmax()), total.shape)
    assert got == {1: a[i], 2: b[j], 3: c[k]} and 0 < few < (len(a) + len(b)) * len(c)


@pytest.mark.parametrize("limits", [{}, {"COARSE": 0.0}, {"BINS": 0.1, "COARSE": 1.0, "CELLS": 1 << 10, "TILE": 20, "MET": 50, "FEW": 3}])
def test_tables_leave_few_pairs(monkeypatch, limits):
    """All pairs of A and B were scored exactly, which 1 GB of texts does not end; equal to all triples here, with coarse and without tables too."""
    from strandframe.plans.contacts import walk

    for k, v in limits.items():
        monkeypatch.setattr(six if hasattr(six, k) else contacts, k, v)
    rng = np.random.default_rng(12)
    rows = []
    for k, n in enumerate((1500, 300, 900, 40, 700)):
        s = "".join(rng.choice(list("ADGKRSTV"), n))
        rows.append((k, s, np.stack(walk(s), 1)))
    p = rows[0][2]
    at = np.concatenate([np.arange(x, x + n) for x, n in zip((11, 61, 131, 181, 221, 251), six.SIZES, strict=True)])
    mean = np.sqrt(((p[at][:, None] - p[at][None]) ** 2).sum(-1))
    prof = six.Profile(mean, np.full(mean.shape, 2.0))
    met, one = [], contacts._Scores.cross
    for k, s, p in rows:
        chain = six._Chain(s, p, prof)
        found = chain.thinned()
        if found is None:
            assert chain.triple() is None
            continue
        (a, xa), (b, xb), (c, xc) = found
        ab, bc, ac = chain.grid(1, 2, a, b), chain.grid(2, 3, b, c), chain.grid(1, 3, a, c)
        for got, (x, y, w, z) in ((ab, (1, 2, a, b)), (bc, (2, 3, b, c)), (ac, (1, 3, a, c))):
            near, off = chain.s.near(x, y, w, z)
            assert abs(near - got).max() <= off
        total = (xb[:, None] + xa[None] + 2 * ab.T)[None] + xc[:, None, None] + 2 * (bc.T[:, :, None] + ac.T[:, None, :])
        z, j, i = np.unravel_index(int(total.argmax()), total.shape)
        monkeypatch.setattr(contacts._Scores, "cross", lambda self, *x: met.append((x[:2], len(x[2]))) or one(self, *x))
        assert chain.triple() == {1: a[i], 2: b[j], 3: c[z]}
        monkeypatch.setattr(contacts._Scores, "cross", one)
        few = sum(n for x, n in met if x == (1, 2))
        assert few and (limits or few < len(a) * len(b) / 4 or len(a) * len(b) < 100)
        met.clear()
    each = [list(six._search([r], prof)) for r in rows]
    assert [x for y in each for x in y] == list(six._search(rows, prof)) and sum(map(len, each)) > 1
