import duckdb
import pytest
from pyspark.sql import functions as F

from strandframe.operators import evaluation, features, merge, reports
from strandframe.operators.motif_scan import A, B, C, search
from strandframe.plans import evidence
from strandframe.plans.motif import toy_model
from strandframe.sources import readers

AA = "ACDEFGHIKLMNPQRSTVWY"


def motif(n, shift):
    return "".join(AA[(7 * c + shift) % 20] for c in range(n))


def test_report_rows(spark):
    seq = "G" * 40 + motif(A, 0) + "G" * 40 + motif(B, 3) + "G" * 40 + motif(C, 5) + "G" * 30
    cab = "G" * 20 + motif(C, 5) + "G" * 30 + motif(A, 0) + "G" * 60 + motif(B, 3) + "G" * 9
    seqs = spark.createDataFrame([(1, seq), (2, cab), (3, None), (4, "")], "seq_idx long, seq string")
    hits = search(seqs, toy_model()).cache()
    text = {r.seq_idx: r.report.split("\n") for r in reports.reports(hits, toy_model()).collect()}
    assert text[1][1] == ">1" and text[1][2] == "   A:41-52(19.2)      B:93-106(22.4)      C:147-154(12.8)"
    assert text[1][3].split() == [motif(A, 0), "<64>", motif(B, 3), "<68>", motif(C, 5), "[114]"]
    assert text[1][4].split() == ["|" * A, "|" * B, "|" * C] and " permuted, g1" in text[2][6]
    joined = hits.join(seqs, "seq_idx")
    assert reports.flanks(joined, True).filter("seq_idx = 1").first().flank == "G" * 40
    assert reports.flanks(joined, False).filter("seq_idx = 2").first().flank == "G" * 9
    assert reports.flanks(joined, False, least=10).count() == 1
    assert reports.cores(joined).filter("seq_idx = 1").first().core == seq and reports.cores(joined, least_flank=100).filter("abc IS NOT NULL").count() == 0
    assert reports.prints(joined).filter("seq_idx = 2").first().print == cab[20:-9]
    assert reports.exclude(joined, ["g1"]).count() == 0 and reports.gate(joined, 100).count() == 0


def test_merge_rules(spark):
    rows = [("AAAA", "BBBB", "BBBB"), ("AAAA", "BBBB", "CCCC"), ("", None, "CCCC"), ("AAAA", "BBBB", "AAAA"), (None, None, None)]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(merge.motif_vote([F.col(x) for x in "abc"]).alias("v")).collect()
    assert [r.v for r in got] == ["BBBB", "AAAA", "CCCC", "AAAA", ""]
    d = spark.createDataFrame([("ABCD", "xxABCDxx"), ("ABCD", "ABCDABCD"), ("AAAA", "AAAAA"), ("ABC", "ABC"), ("ZZZZ", "ABC"), ("", "A")], "m string, s string")
    assert [r.p for r in d.select(merge.motif_position(F.col("m"), F.col("s")).alias("p")).collect()] == [3, None, None, None, None, None]


def test_model_files():
    rows = [f"{k} " + " ".join(["1.25"] * 21) for k in range(1, 3)]
    one = lambda m, n=2: [f"PSSM\t1\t{m}\tg", f"PSSM aa {n}", "consseq\tab", *rows]
    profiles, letters = readers.read_model(["PSSMs\t3", *one("A"), *one("B"), *one("C")])
    assert profiles["g"][0] == [[125] * 21] * 2 and letters["g"] == ("ab", "ab", "ab")
    for broken in (["PSSMs\t4", *one("A"), *one("B"), *one("C")], [*one("A", 3), *one("B"), *one("C")], [*one("A"), *one("B")], ["PSSM\t1\tA\tg", "PSSM nt 2", *rows]):
        with pytest.raises(ValueError):
            readers.read_model(broken)


def test_sketch_is_brute_force(spark):
    ss = ["~~hhhhssssttt~~hsth~~", "hhsst", "hst~~sth~hs~", "~~~~"]
    got = spark.createDataFrame([(s,) for s in ss], "s string").select("s", features.sketch(F.col("s"), 5).alias("a"), features.sketch(F.col("s"), 5, True).alias("b")).collect()
    for r in got:
        if len(r.s) < 5:
            assert r.a is None
            continue
        three = [r.s[2 + i * (len(r.s) - 4) // 5 :][:3] for i in range(5)]
        assert (r.a, r.b) == tuple("".join(evidence._symbol(t, usual) for t in three) for usual in (False, True))


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, xs array<double>, ys array<double>, zs array<double>")
    assert features.features(empty, "vec_id").count() == 0
    none = spark.createDataFrame([(1, [], [], []), (2, None, None, None), (3, [1.0], [1.0], [1.0])], empty.schema)
    assert [r.pos for r in features.features(none, "vec_id").collect()] == [1]
    s = spark.createDataFrame([(True, 1.0, 999.0, "GDD", "DGD"), (False, 4.0, 4.2, "KDD", None), (True, 1.0, 2.0, "ADD", "DGD")], "p boolean, t double, s double, g string, m string")
    got = [r[0] for r in s.select(evaluation.class_score(F.col("p"), F.col("t"), F.col("s"), F.col("g"), F.col("m"))).collect()]
    assert [round(x, 6) for x in got] == [0.9375, round((1 - 4.2 / 8) * 0.5 * 0.75, 6), 0.0]


def test_evidence_queries_agree_with_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    from strandframe.plans import registry

    for name in ("merge_records", "hit_cores", "c_filter", "gumbel_fit", "chain_sketches"):
        df = registry.queries()[name](spark, d)
        q = con.execute(registry.oracle_sql()[name])
        cols = [c[0] for c in q.description]
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, q.fetchall())), name


def test_c_filter_ends_a_group_at_a_known_place():
    import numpy as np

    from strandframe.operators.reports import merge_c_hits

    scores = np.array([[0, 5, 0, 9, 0, 0], [7, 0, 0, 8, 9, 0], [0, 6, 0, 0, 0, 9]])
    assert merge_c_hits(scores, 4) == {1: (6, 2), 3: (9, 0), 0: (7, 1)}  # the second group ends at 3, the third at 1, which it takes
    assert merge_c_hits(scores[:1], 5) == {3: (9, 0)}
