"""DataFrames to text formats."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import wrap

HITS = ("Label", "Score", "Group", "Group2", "Diff2", "ABC", "QL", "Lo", "Hi", "PPL", "Suff", "PosA", "SeqA", "PosB", "SeqB", "PosC", "SeqC")


def fasta_record(label: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), label, F.lit("\n"), wrap(seq, width))


def write_fasta(df: DataFrame, path: str, label: str = "label", seq: str = "seq") -> None:
    df.filter(F.length(seq) > 0).select(fasta_record(F.col(label), F.col(seq)).alias("value")).write.text(path)


def hits_table(hits: DataFrame, label: str = "seq_idx") -> DataFrame:
    """The 17 columns of the hits table as text: one decimal, signed difference, a point for no second group."""
    one = lambda c, form: F.col(f"{c}_text") if f"{c}_text" in hits.columns else F.format_string(form, F.col(c) / 100)
    cols = [F.col(label).cast("string"), one("score", "%.1f"), F.col("group"), F.coalesce("group2", F.lit(".")), one("diff2", "%+.1f")]
    cols += [F.col(c).cast("string") for c in "abc ql lo hi ppl suff pos_a seq_a pos_b seq_b pos_c seq_c".split()]
    return hits.select(*[c.alias(n) for c, n in zip(cols, HITS, strict=True)])


def write_hits(hits: DataFrame, path: str) -> None:
    hits_table(hits).write.csv(path, sep="\t", header=True)


def write_cal(chains: DataFrame, path: str) -> None:
    rows = F.transform(F.arrays_zip(F.split("seq", "").alias("a"), "xs", "ys", "zs"), lambda r: F.format_string("%s\t%.3f\t%.3f\t%.3f", r["a"], r["xs"], r["ys"], r["zs"]))
    chains.select(F.concat(F.lit(">"), "label", F.lit("\n"), F.concat_ws("\n", rows)).alias("value")).write.text(path)


def write_pdb(chains: DataFrame, path: str) -> None:
    """One text of CA atoms a chain (label, seq, xs, ys, zs); letters without a residue name are UNK."""
    from strandframe.sources.readers import THREE

    names = F.create_map(*[F.lit(x) for three, one in THREE.items() if three != "MSE" for x in (one, three)])
    atoms = F.transform(F.arrays_zip(F.split("seq", "").alias("a"), "xs", "ys", "zs"), lambda r, i: F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", (i + 1) % 100000, F.coalesce(F.try_element_at(names, r["a"]), F.lit("UNK")), (i + 1) % 10000, r["xs"], r["ys"], r["zs"]))
    chains.select(F.concat_ws("\n", F.concat(F.lit("REMARK "), "label"), F.concat_ws("\n", atoms), F.lit("TER")).alias("value")).write.text(path)


def write_stockholm_fasta(rows: DataFrame, path: str) -> None:
    """Aligned rows (label, row) as FASTA, with their gaps."""
    write_fasta(rows, path, "label", "row")


def model_lines(model) -> list[str]:
    """A motif model as text, as `readers.read_model` takes it."""
    from strandframe.functions.sequence import AMINO

    out = ["rdrp_model", "motifs\t3\tA\tB\tC", "\t".join(["groups", str(len(model.names)), *model.names]), f"PSSMs\t{3 * len(model.names)}"]
    for g, name in enumerate(model.names):
        for k, table in enumerate(model.tables[g]):
            best = model.consensus[name][k] if model.consensus else "".join(AMINO[int(max(range(20), key=lambda a, r=r: r[a]))] for r in table)
            out += [f"PSSM\t{3 * g + k + 1}\t{'ABC'[k]}\t{name}", f"PSSM aa {len(table)}", f"consseq\t{best}"]
            out += [f"{c + 1:3d} " + " ".join(f"{row[a] / 100:5.2f}" for a in (*range(20), 21)) for c, row in enumerate(table)]
    return out


def cluster_rows(members: DataFrame) -> DataFrame:
    """Tagged lines of (cluster, label, score): a C row with size, label of the best and mean score, and an M row each; largest clusters first by `rank`.

    Ranks come from cluster sizes alone, so no cluster is gathered."""
    from pyspark.sql import Window

    per = members.groupBy("cluster").agg(F.count("*").alias("size"), F.max_by("label", F.struct("score", "label")).alias("top"), F.avg("score").alias("mean"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1)
    c = per.select("rank", F.lit("C").alias("tag"), F.concat_ws("\t", F.lit("C"), "rank", "size", "top", F.format_string("%.4f", "mean")).alias("line"))
    m = members.join(per.select("cluster", "rank"), "cluster").select("rank", F.lit("M").alias("tag"), F.concat_ws("\t", F.lit("M"), "rank", "label", F.format_string("%.4f", "score")).alias("line"))
    return c.unionByName(m)
