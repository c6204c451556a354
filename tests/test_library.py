import numpy as np
from pyspark.sql import functions as F

from strandframe.functions import align
from strandframe.functions.sequence import reverse_complement, translate_frame, wrap
from strandframe.operators import merge, training
from strandframe.operators.graph import connected_components
from strandframe.operators.motif_scan import SHORTEST, Model, fold, hits, window_scores
from strandframe.plans.motif import toy_model
from strandframe.sources import readers, sinks


def test_translation(spark):
    d = spark.createDataFrame([("ATGGCCTAA",)], "s string").select(translate_frame("s", 1).alias("a"), translate_frame("s", -1).alias("b"), reverse_complement("s").alias("c")).first()
    assert d == ("MA*", "LGH", "TTAGGCCAT")


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 more\nACD-EF\nGH\n>s2\n\n>s3\nK*L\n")
    d = readers.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, d.collect())) == [("s1", "ACDEFGH"), ("s3", "K*L")]
    sinks.write_fasta(d, str(tmp_path / "out"))
    assert readers.fasta(spark, str(tmp_path / "out")).count() == 2
    assert spark.createDataFrame([("a" * 81,)], "s string").select(wrap("s")).first()[0] == "a" * 80 + "\na"


def test_window_scores_are_brute_force():
    rng = np.random.default_rng(1)
    profile, codes = rng.integers(-300, 300, (8, 22)), rng.integers(0, 22, 50)
    assert window_scores(codes, profile).tolist() == [sum(profile[c][codes[p + c]] for c in range(8)) for p in range(43)]


def test_fold_keeps_the_demoted_group():
    found = [(10, 0, 0, 0, 0, False), (12, 0, 0, 0, 1, False), (11, 1, 0, 0, 2, False)]
    top, second = fold(found)
    assert (top[0], second[0], second[1]) == (12, 11, 1)
    assert fold(found[:2])[1][1] == 0 and fold(found[:2], True)[1] is None


def test_short_sequences_have_no_hits():
    assert list(hits(np.zeros(SHORTEST - 1, np.uint8), toy_model())) == [] and isinstance(toy_model(), Model)


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    par = {x: x for p in e for x in p}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = top(a), top(b)
        par[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {x: top(x) for a, b in e if a != b for x in (a, b)}


def test_fev(spark):
    d = merge.parse_fev(spark.createDataFrame([("x\ta=1\tb=2=3\ta=4",), ("y",)], "line string"))
    assert {r[0]: r[1] for r in d.collect()} == {"x": {"a": "4", "b": "2=3"}, "y": {}}


def test_quartiles(spark):
    d = training.quartiles(spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").alias("v")), "g", "v").first()
    assert d == ("g", 10, 3, 6, 8)


def test_smith_waterman():
    s = np.full((4, 5), -3.0)
    for i in range(4):
        s[i, i + 1] = 4.0
    best, start, end, path = align.smith_waterman(s)
    assert (best, start, end, path) == (14.0, (0, 1), (4, 5), "MMMM")
    assert align.global_align(np.array([[1.0]])) == 1.0


def test_letters_of_whole_texts(spark, tmp_path):
    import collections

    import duckdb

    from strandframe.plans import registry

    texts = [("a", "Acd-x " * 50), ("a", "k" * 34), ("a", "w" * 33), ("b", "Y1b\ny"), ("b", ""), (None, "M" * 69), ("b", None)]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for lang, text in texts:
        for i, aa in enumerate(x for x in (text or "").upper() if x in "ACDEFGHIKLMNPQRSTVWY"):
            want[lang, i % 34 + 1, aa] += 1
    got = registry.queries()["letters_by_block"](spark, str(tmp_path)).collect()
    assert {tuple(r)[:3]: r.n for r in got} == want and len(got) == len(want)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[:3]: r[3] for r in db.sql(registry.oracle_sql()["letters_by_block"]).fetchall()} == want


def test_linkage_of_many_and_long_components(spark, tmp_path):
    import duckdb

    from strandframe.plans import registry

    pairs = [(c, c + k) for c in range(0, 90, 3) for k in (0, 1)] + [(c, c - 1) for c in range(3, 30, 3)] + [(200 + k, 300 + k + j) for k in range(40) for j in (0, 1)]
    spark.createDataFrame(pairs, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(tuple, registry.queries()["order_linkage"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(db.sql(registry.oracle_sql()["order_linkage"]).fetchall()) and len({c for _, c in got}) > 20


def test_frames_agree(spark):
    from strandframe.operators import translate

    rows = [(1, "ATGGCCTAA"), (2, "acgtNACGTTTGA"), (3, ""), (4, None), (5, "AC"), (6, "ATGé0ATG")]
    d = spark.createDataFrame(rows, "k long, s string")
    got = {(r.k, r.frame): r.aa for r in translate.six_frames(d, "k", "s").collect()}
    for r in d.filter("s IS NOT NULL").select("k", *[translate_frame("s", f).alias(str(f)) for f in (1, 2, 3, -1, -2, -3)]).collect():
        assert {f: got[r.k, f] for f in (1, 2, 3, -1, -2, -3)} == {f: r[str(f)] for f in (1, 2, 3, -1, -2, -3)}
    assert not any(k == 4 for k, _ in got)
