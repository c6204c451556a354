import random
from collections import defaultdict

import pytest

from strandframe.operators import linkage


def slow(edges, threshold):
    d, labels = {}, sorted({x for e in edges for x in e[:2] if x is not None})
    for a, b, w in edges:
        if w is not None:
            d[a, b] = max(w, d.get((a, b), w))
    full = defaultdict(dict)
    for a, b in list(d):
        if a != b:
            full[a][b] = full[b][a] = (d[a, b] + d.get((b, a), d[a, b])) / 2
    out, of = {}, {}
    for s in labels:
        if s in of:
            continue
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = s
                todo += [y for y, w in full[x].items() if w >= threshold]
    for c in set(of.values()):
        m = sorted(x for x in of if of[x] == c)
        best, top = c, 0
        for x in m if len(m) > 2 else []:
            t = sum(full[x].get(y, 0) for y in m)
            if t > top:
                best, top = x, t
        v = sorted(full[best][y] for y in m if y in full[best]) if len(m) > 2 else []
        out[c] = (len(m), best, *((v[0], sum(v) / len(v), v[len(v) // 2], v[-1]) if v else (0, 0, 0, 0)))
    return of, out


def test_against_a_matrix(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.randrange(-40, 101) / 10) for _ in range(110)] + [("x", "y", 9.0), ("y", "x", 5.0), ("lone", "n1", 0.5), ("self", "self", 9.0), ("n3", "n4", None)]
    d = spark.createDataFrame(edges, "src string, dst string, w double")
    members = linkage.clusters(d, 7.5)
    of, want = slow(edges, 7.5)
    assert {r.label: r.cluster for r in members.collect()} == of
    tops = linkage.representatives(d, members)
    got = {r.cluster: tuple(r)[1:] for r in tops.collect()}
    assert got.keys() == want.keys() and max(v[0] for v in want.values()) > 3
    for c, w in want.items():
        assert got[c][:2] == w[:2] and got[c][2:] == pytest.approx(w[2:])
    lines = linkage.cluster_lines(tops, members).collect()
    assert sum(r.tag == "C" for r in lines) == len(want) and sum(r.tag == "M" for r in lines) == len(of)
    assert [r.line for r in lines if r.line.startswith("M\tself\t")] == ["M\tself\tself"] and all(len(r.line.split("\t")) == (8 if r.tag == "C" else 3) for r in lines)


def test_no_edges(spark):
    d = spark.createDataFrame([], "src string, dst string, w double")
    assert linkage.clusters(d, 1.0).collect() == []


def test_edges_are_joined_once(spark, tmp_path):
    """Each step read the joins anew from the edges."""
    spark.createDataFrame([(1, 2, 9.0), (2, 3, 9.0), (1, 3, 1.0)], "src long, dst long, w double").write.parquet(f"{tmp_path}/edges.parquet")
    e = spark.read.parquet(f"{tmp_path}/edges.parquet")
    out = linkage.representatives(e, linkage.clusters(e, 5.0))
    assert "edges.parquet" not in "".join(out.inputFiles())
    assert [tuple(r) for r in out.collect()] == [(1, 3, 2, 9.0, 9.0, 9.0, 9.0)]
