"""Replay of shipped searches, where a model file and a folder with data/ and results/ are named (MOTIF_MODEL, MOTIF_RUNS); skipped elsewhere."""
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandframe.operators import motif_scan, reports
from strandframe.sources import readers, sinks

MODEL, RUNS = os.environ.get("MOTIF_MODEL"), os.environ.get("MOTIF_RUNS")


@pytest.mark.skipif(not MODEL or not RUNS, reason="no model or runs named")
def test_replay(spark):
    groups, letters = readers.read_model(Path(MODEL).read_text().splitlines())
    model = motif_scan.Model(groups)
    model.consensus = letters
    records = lambda path: sorted((Path(RUNS) / "results" / path).read_text().strip("\n").split("\n>"))
    for fasta in sorted((Path(RUNS) / "data").glob("*.fa")):
        shown = set(re.findall(r"pssm_group=(\S+)", (Path(RUNS) / "results" / f"{fasta.stem}.fev").read_text()))
        if not shown <= set(groups):  # made with another model
            continue
        seqs = readers.fasta(spark, str(fasta)).withColumn("seq_idx", F.monotonically_increasing_id()).withColumn("seq", F.upper("seq")).cache()
        hits = motif_scan.search(seqs, model).join(seqs, "seq_idx").cache()
        line = lambda d, c: sorted(r[0] for r in d.select(c).collect())
        results = Path(RUNS) / "results"
        assert line(reports.evidence(hits, "label"), "line") == sorted((results / f"{fasta.stem}.fev").read_text().splitlines())
        if (tsv := results / f"{fasta.stem}.tsv").exists():
            assert sorted("\t".join(r) for r in sinks.hits_table(hits, "label").collect()) == sorted(tsv.read_text().splitlines()[1:])
        wrap = lambda d, c: sorted(r[0].lstrip(">") for r in d.filter(F.col(c).isNotNull()).join(seqs.select("seq_idx", "label"), "seq_idx").select(sinks.fasta_record(F.concat("label", "suffix"), F.col(c))).collect())
        assert wrap(reports.prints(hits), "print") == sorted(x.lstrip(">") for x in records(f"{fasta.stem}.pp.fasta"))
        assert wrap(reports.cores(hits), "core") == sorted(x.lstrip(">") for x in records(f"{fasta.stem}.core.fasta"))
        if (text := results / f"{fasta.stem}.report.txt").exists():
            assert line(reports.reports(hits, model, "label"), "report") == sorted("\n" + x.strip("\n") for x in text.read_text().split("\n\n"))
