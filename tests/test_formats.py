import math
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import evaluation, training
from strandframe.operators.motif_scan import Model
from strandframe.plans.motif import toy_model
from strandframe.sources import readers, sinks


def chains(spark):
    return spark.createDataFrame([("x", "ACDW", [1.5, 2.0, -3.25, 100.125], [0.0] * 4, [9.0, 8.0, 7.0, 6.5])], "label string, seq string, xs array<double>, ys array<double>, zs array<double>")


def test_cal_and_pdb_round_trip(spark, tmp_path):
    d = chains(spark)
    sinks.write_cal(d, str(tmp_path / "cal"))
    assert readers.cal(spark, str(tmp_path / "cal")).select(*d.columns).collect() == d.collect()
    sinks.write_pdb(d, str(tmp_path / "pdb"))
    one = readers.pdb(spark, str(tmp_path / "pdb")).first()
    assert (one.seq, one.xs, one.zs, one.res_nrs) == ("ACDW", [1.5, 2.0, -3.25, 100.125], [9.0, 8.0, 7.0, 6.5], [1, 2, 3, 4]) and one.label.endswith("_A")


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@@\n")
    assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / "a.fq")).collect())) == [("r1 x", "ACGT", "IIII"), ("r2", "GG", "@@")]


def test_stockholm(spark, tmp_path):
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n#=GF ID t\n\ns1 AC-D\ns2 ACED\n#=GC SS ....\n\ns1 GG\ns2 G-\n//\n")
    rows = readers.stockholm(spark, str(tmp_path / "a.sto"))
    assert {r.label: r.row for r in rows.collect()} == {"s1": "AC-DGG", "s2": "ACEDG-"}
    sinks.write_stockholm_fasta(rows, str(tmp_path / "fa"))
    assert {r.label: r.seq for r in readers.fasta(spark, str(tmp_path / "fa"), strip_gaps=False).collect()} == {"s1": "AC-DGG", "s2": "ACEDG-"}


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "l.files").write_text("a.pdb\n\n b.pdb \n")
    assert readers.file_list(spark, str(tmp_path / "l.files")) == ["a.pdb", "b.pdb"]
    (tmp_path / "p.tsv").write_text("a\tb\tAC-D\tACED\na\tc\tA\tAC\n")
    assert [tuple(r) for r in readers.aligned_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("a", "b", "AC-D", "ACED")]


def test_model_round_trip():
    model = toy_model()
    groups, letters = readers.read_model(sinks.model_lines(model))
    again = Model(groups)
    assert again.names == model.names and all((a[:, :20] == b[:, :20]).all() for x, y in zip(again.tables, model.tables, strict=True) for a, b in zip(x, y, strict=True))
    assert [len(x) for x in letters["g1"]] == [12, 14, 8]


def test_cluster_rows(spark):
    d = spark.createDataFrame([(7, "a", 1.0), (7, "b", 3.0), (9, "c", 2.0)], "cluster long, label string, score double")
    assert sorted(r.line for r in sinks.cluster_rows(d).collect()) == ["C\t0\t2\tb\t2.0000", "C\t1\t1\tc\t2.0000", "M\t0\ta\t1.0000", "M\t0\tb\t3.0000", "M\t1\tc\t2.0000"]


def test_log_odds_is_brute_force(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(200)]
    both = pairs + [(j, i) for i, j in pairs]
    got = {(r.i, r.j): r.score for r in training.log_odds(spark.createDataFrame(pairs, "i long, j long"), 5).collect()}
    one = lambda k: (sum(i == k for i, _ in both) + 1) / len(both)
    for (i, j), score in got.items():
        r = sum(p == (i, j) for p in both) / len(both) / (one(i) * one(j))
        assert score == pytest.approx(-3.0 if r < 0.001 else 3.0 if r > 100 else 10 * math.log10(r))
    assert len(got) == 25


def test_evaluation_tables(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (True, True)], "truth boolean, call boolean")
    assert tuple(evaluation.confusion(d).first()) == (2, 1, 1, 1)
    p = spark.createDataFrame([("q", "r1", True, 2.0), ("q", "r2", False, 4.0), ("q", "r3", True, 1.0), ("z", "r1", True, 9.0)], "query string, label string, positive boolean, rmsd double")
    assert {r.query: (r.top, r.score, r.other, r.other_rmsd) for r in evaluation.classify_rmsd(p).collect()} == {"q": ("r3", 0.875, "r2", 4.0), "z": ("r1", 0.0, None, 999.0)}
    a, b = evaluation.split_train_test(spark.range(1000).withColumnRenamed("id", "k"), "k", 30)
    assert a.count() + b.count() == 1000 and 200 < a.count() < 400
    assert evaluation.subsample(spark.range(50).withColumnRenamed("id", "k"), "k", 5).select(F.count("*")).first()[0] == 5


def test_streamed_scan(spark, tmp_path):
    from strandframe.operators.motif_scan import search
    from strandframe.streaming import scan

    rows = [(k, "".join("ACDEFGHIKLMNPQRSTVWY"[(7 * c + k) % 20] for c in range(400))) for k in range(12)]
    d = spark.createDataFrame(rows, "seq_idx long, seq string")
    d.write.parquet(str(tmp_path / "in"))
    out = scan.stream_search(spark, str(tmp_path / "in"), toy_model())
    q = out.writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("scanned").collect())) == sorted(map(str, search(d, toy_model()).collect()))
