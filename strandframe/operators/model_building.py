"""From aligned rows to a motif model that the scan reads.

Counting is grouped sums over (group, motif, column, letter); a finished model is a few numbers a group, which the caller
takes to the driver as the scan broadcasts it anyway.
"""
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import AMINO
from strandframe.operators.first_centroid import _Tables
from strandframe.operators.structure import SIZES

MOTIFS = "ABC"
#: letters under this share of a column are shown in lower case
SURE = 0.5
KEY = ("group", "motif", "col")


def conditional(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(given, aa, p) and (aa, bg) of counts (a, b, n) of letters that stand for each other, in whichever order."""
    both = pairs.filter(F.col("a").isin(*AMINO) & F.col("b").isin(*AMINO)).select("a", "b", "n")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    row = both.groupBy("a").agg(F.sum("n").alias("m"))  # 20 rows, and 400 above
    p = both.join(row, "a").select(F.col("a").alias("given"), F.col("b").alias("aa"), (F.col("n") / F.col("m")).alias("p"))
    total = row.agg(F.sum("m").alias("t"))
    return p, row.join(F.broadcast(total)).select(F.col("a").alias("aa"), (F.col("m") / F.col("t")).alias("bg"))


def stockholm_motifs(rows: DataFrame, features: DataFrame, feature: str = "ABC") -> DataFrame:
    """group (the file's name to its first point), motif, row: columns of the alignment over which the feature row says A, B and C.

    Each letter has to stand in one run of the motif's length; a file where it does not raises."""
    marks = features.filter(F.col("feature") == feature).select("file", F.col("row").alias("marks"))
    name = F.regexp_extract("file", r"([^/.]*)[^/]*$", 1)
    parts = []
    for m, n in zip(MOTIFS, SIZES, strict=True):
        at = F.locate(m * n, F.col("marks"))
        ok = (at > 0) & (F.length(F.regexp_replace("marks", f"[^{m}]", "")) == n)
        parts.append(F.struct(F.lit(m).alias("motif"), F.when(ok, F.substring("row", at, F.lit(n))).otherwise(F.raise_error(F.concat(F.lit(f"no single run of {n} {m} in "), "file"))).alias("row")))
    return rows.join(marks, "file").select(name.alias("group"), F.explode(F.array(*parts)).alias("r")).select("group", "r.motif", "r.row")


def row_faults(rows: DataFrame) -> DataFrame:
    """group, motif, least, most: motifs whose rows are of several lengths, or of another than the motif has."""
    want = F.element_at(F.create_map(*[F.lit(x) for kv in zip(MOTIFS, SIZES, strict=True) for x in kv]), F.col("motif"))
    n = rows.groupBy("group", "motif").agg(F.min(F.length("row")).alias("least"), F.max(F.length("row")).alias("most"))
    return n.filter((F.col("least") != F.col("most")) | (F.col("least") != want))


def column_letters(rows: DataFrame) -> DataFrame:
    """group, motif, col (from 1), aa, n; letters beyond the twenty count in no column, and a column of only such has one of each."""
    at = rows.select("group", "motif", F.posexplode(F.split(F.upper("row"), "")).alias("p", "aa")).filter("aa <> ''")
    seen = at.groupBy("group", "motif", (F.col("p") + 1).alias("col"), F.when(F.col("aa").isin(*AMINO), F.col("aa")).alias("aa")).agg(F.count("*").alias("n"))
    bare = seen.groupBy(*KEY).agg(F.count("aa").alias("k")).filter("k = 0").select(*KEY, F.explode(F.array(*map(F.lit, AMINO))).alias("aa"), F.lit(1).cast("long").alias("n"))
    return seen.filter("aa IS NOT NULL").unionByName(bare)


def motif_profiles(rows: DataFrame, given: DataFrame, background: DataFrame, pseudo: float = 0.1) -> DataFrame:
    """group, motif, col, aa, score, wildcard, consensus of rows (group, motif, row): 20 letters a column.

    score is the log of the letter's share, mixed with `pseudo` parts of what its column's letters stand for, over its
    background; the wild card is the background's mean score, 0 at most; the consensus letter is the commonest, the first
    of equals, in lower case under SURE."""
    return profiles_of_letters(column_letters(rows), given, background, pseudo)


def profiles_of_letters(n: DataFrame, given: DataFrame, background: DataFrame, pseudo: float = 0.1) -> DataFrame:
    """motif_profiles of counted letters (group, motif, col, aa, n). They are written out first, as they are few and read thrice."""
    n = _Tables(n.sparkSession).keep(n, "letters")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("aa")) for a in AMINO]))
    per = n.groupBy(*KEY).agg(F.sum("n").alias("total"), F.max_by("aa", F.struct("n", -F.ascii("aa"))).alias("top"), F.max("n").alias("most"))
    raw = n.join(per, list(KEY)).select(*KEY, F.col("aa").alias("given"), (F.col("n") / F.col("total")).alias("f"))
    stand = raw.join(F.broadcast(given), "given").groupBy(*KEY, "aa").agg(F.sum(F.col("f") * F.col("p")).alias("ps"))
    q = per.select(*KEY, each.alias("e")).select(*KEY, "e.aa").join(raw.withColumnRenamed("given", "aa"), [*KEY, "aa"], "left").join(stand, [*KEY, "aa"], "left")
    q = q.withColumn("q", F.coalesce("f", F.lit(0.0)) + pseudo * F.coalesce("ps", F.lit(0.0))).join(F.broadcast(background), "aa")
    column = Window.partitionBy(*KEY)  # twenty rows each
    s = q.withColumn("score", F.log(F.col("q") / F.sum("q").over(column) / F.col("bg")))
    s = s.withColumn("wildcard", F.least(F.lit(0.0), F.sum(F.col("bg") * F.col("score")).over(column)))
    sure = F.when(F.col("most") < SURE * F.col("total"), F.lower("top")).otherwise(F.col("top"))
    return s.join(per.select(*KEY, sure.alias("consensus")), list(KEY)).select(*KEY, "aa", "score", "wildcard", "consensus")


def to_model(profiles: DataFrame) -> tuple[dict, dict]:
    """group -> three tables in hundredths, and group -> three consensus rows; a group without its three motifs of the right lengths raises."""
    tables: dict = {}
    letters: dict = {}
    cells = profiles.groupBy("group", "motif", "col").agg(F.map_from_entries(F.collect_list(F.struct("aa", "score"))).alias("by"), F.first("wildcard").alias("w"), F.first("consensus").alias("c"))
    for (group, motif), rows in itertools.groupby(cells.orderBy("group", "motif", "col").toLocalIterator(), lambda r: (r["group"], r["motif"])):
        got = list(rows)
        tables.setdefault(group, []).append([[round(100 * r["by"][a]) for a in AMINO] + [round(100 * r["w"])] for r in got])
        letters.setdefault(group, []).append("".join(r["c"] for r in got))
    for group, t in tables.items():
        if tuple(map(len, t)) != SIZES:
            raise ValueError(f"{group} has no profiles of {SIZES} columns")
    return {g: tuple(t) for g, t in tables.items()}, {g: tuple(x) for g, x in letters.items()}


def palmprint_model_lines(groups: dict, consensus: dict | None = None) -> list[str]:
    """A model in the format with a palmprint_model head: groups by number, then each motif's profile with its positive letters, and a point."""
    out = ["palmprint_model", f"groups\t{len(groups)}", *(f"group\t{k}\t{g}" for k, g in enumerate(groups))]
    for g, tables in groups.items():
        for k, (motif, table) in enumerate(zip(MOTIFS, tables, strict=True)):
            best = "".join(AMINO[max(range(20), key=row.__getitem__)] for row in table)
            out += [f"pssm\t{g}\t{motif}", f"PSSM aa {len(table)}", f"consseq\t{consensus[g][k] if consensus else best}", "Col" + "".join(f"     {a}" for a in AMINO + "X")]
            for c, row in enumerate(table, 1):
                above = sorted((a for a in range(20) if row[a] > 0), key=lambda a, row=row: -row[a])
                out.append(f"{c:3d} " + " ".join(f"{x / 100:5.2f}" for x in row[:21]) + "".join(f" {AMINO[a]}({row[a] / 100:.2f})" for a in above))
            out.append("//")
    return [*out, "."]
