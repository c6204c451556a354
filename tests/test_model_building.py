import math
import random
from collections import Counter

import pytest

from strandframe.functions.sequence import AMINO
from strandframe.operators import model_building as mb
from strandframe.operators.motif_scan import Model, search
from strandframe.sources import readers


def sample(seed, n):
    rng = random.Random(seed)
    core = {m: [rng.choice(AMINO) for _ in range(k)] for m, k in (("A", 12), ("B", 14), ("C", 8))}
    return [(f"g{seed}", m, "".join(a if rng.random() < 0.6 else rng.choice(AMINO + "X-") for a in core[m])) for _ in range(n) for m in "ABC"]


def pair_counts(seed=1):
    rng = random.Random(seed)
    return [(a, b, rng.randrange(1, 50) + 300 * (a == b)) for i, a in enumerate(AMINO) for b in AMINO[i:]]


def slow(rows, pairs, pseudo=0.1):
    n = Counter()
    for a, b, k in pairs:
        n[a, b] += k
        n[b, a] += k
    tot = {a: sum(n[a, b] for b in AMINO) for a in AMINO}
    bg = {a: tot[a] / sum(tot.values()) for a in AMINO}
    out = {}
    for g, m in {r[:2] for r in rows}:
        some = [r[2] for r in rows if r[:2] == (g, m)]
        for c in range(len(some[0])):
            k = Counter(x[c].upper() for x in some if x[c].upper() in AMINO) or Counter(AMINO)
            f = {a: k[a] / sum(k.values()) for a in AMINO}
            q = {a: f[a] + pseudo * sum(f[b] * n[b, a] / tot[b] for b in AMINO) for a in AMINO}
            s = {a: math.log(q[a] / sum(q.values()) / bg[a]) for a in AMINO}
            top = max(AMINO, key=lambda a: (f[a], -ord(a)))
            for a in AMINO:
                out[g, m, c + 1, a] = (s[a], min(0, sum(bg[b] * s[b] for b in AMINO)), top if f[top] >= 0.5 else top.lower())
    return out


def built(spark, rows):
    given, bg = mb.conditional(spark.createDataFrame(pair_counts(), "a string, b string, n long"))
    return mb.motif_profiles(spark.createDataFrame(rows, "group string, motif string, row string"), given, bg)


def test_profiles_by_hand_and_a_column_of_x(spark):
    rows = sample(3, 30) + [(g, m, "X" + r[1:]) for g, m, r in sample(4, 5)]
    got = {(r.group, r.motif, r.col, r.aa): (r.score, r.wildcard, r.consensus) for r in built(spark, rows).collect()}
    want = slow(rows, pair_counts())
    assert got.keys() == want.keys() and len(got) == 2 * 34 * 20
    for k, w in want.items():
        assert got[k][0] == pytest.approx(w[0]) and got[k][1] == pytest.approx(w[1]) and got[k][2] == w[2]


def test_model_file_comes_back_and_finds_its_motifs(spark, tmp_path):
    groups, letters = mb.to_model(built(spark, sample(5, 40) + sample(6, 40)))
    lines = mb.palmprint_model_lines(groups, letters)
    assert lines[:4] == ["palmprint_model", "groups\t2", "group\t0\tg5", "group\t1\tg6"] and lines[4] == "pssm\tg5\tA" and lines[5] == "PSSM aa 12" and lines[-1] == "."
    back, cons = readers.read_model(lines)
    assert {g: [[list(r) for r in t] for t in ts] for g, ts in back.items()} == {g: [[list(r) for r in t] for t in ts] for g, ts in groups.items()} and cons == letters
    for bad in (lines[:-1], lines[:40], [x for x in lines if not x.startswith("group\t1")][:70]):
        with pytest.raises(ValueError):
            readers.read_model(bad)
    (tmp_path / "m").write_text("\n".join(lines))
    a, b, c = (x.upper() for x in letters["g6"])
    seq = "K" * 20 + a + "K" * 60 + b + "K" * 20 + c + "K" * 30
    hit = search(spark.createDataFrame([(1, seq)], "seq_idx long, seq string"), Model(readers.model(spark, str(tmp_path / "m")))).first()
    assert (hit["group"], hit.pos_a, hit.pos_b, hit.pos_c) == ("g6", 21, 93, 127)
    with pytest.raises(ValueError):
        mb.to_model(built(spark, [r for r in sample(5, 4) if r[1] != "B"]))


def test_stockholm_to_rows(spark, tmp_path):
    marks = "." * 3 + "A" * 12 + ".." + "B" * 14 + "C" * 8 + "."
    rng = random.Random(7)
    seqs = ["".join(rng.choice(AMINO + "-") for _ in marks) for _ in range(3)]
    head = ["# STOCKHOLM 1.0", ""]
    block = lambda lo, hi: [*(f"s{k} {s[lo:hi]}" for k, s in enumerate(seqs)), f"#=GC ABC {marks[lo:hi]}"]
    (tmp_path / "fam.v1.sto").write_text("\n".join([*head, *block(0, 20), "", *block(20, 60), "//", ""]))
    path = str(tmp_path / "fam.v1.sto")
    got = {tuple(r) for r in mb.stockholm_motifs(readers.stockholm(spark, path), readers.stockholm_features(spark, path)).collect()}
    assert got == {("fam", m, s[lo : lo + n]) for s in seqs for m, lo, n in (("A", 3, 12), ("B", 17, 14), ("C", 31, 8))}
    (tmp_path / "bad.sto").write_text("\n".join([*head, *block(0, 20), f"#=GC ABC {marks[20:59]}A", "//"]))
    path = str(tmp_path / "bad.sto")
    with pytest.raises(Exception, match="no single run"):
        mb.stockholm_motifs(readers.stockholm(spark, path), readers.stockholm_features(spark, path)).collect()
    rows = spark.createDataFrame([("g", "A", "ACDEFGHIKLMN"), ("g", "A", "AC"), ("g", "B", "A" * 13), ("g", "C", "A" * 8)], "group string, motif string, row string")
    assert {(r.motif, r.least, r.most) for r in mb.row_faults(rows).collect()} == {("A", 2, 12), ("B", 13, 13)}


def test_profiles_of_texts_scan_them_once(spark, tmp_path):
    from strandframe.plans import motif

    text = "acdefghiklmnpqrstvwy" * 4
    spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "de" * 40, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = motif.motif_profiles(spark, str(tmp_path))
    assert "documents" not in "".join(out.inputFiles())
    got = {(r["group"], r.motif, r.col): r.consensus for r in out.collect()}
    blocks = [(text * 2).upper()[34 * k : 34 * k + 34] for k in range(2)]
    assert [got["x", m, c].upper() for m, n in (("A", 12), ("B", 14), ("C", 8)) for c in range(1, n + 1)] == [min(p) for p in zip(*blocks, strict=True)]
