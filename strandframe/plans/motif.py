"""The motif-scan query: windows against integer profiles, chaining A-B-C, best and second group per sequence."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.sequence import AMINO, clean, clean_text
from strandframe.operators.first_centroid import _Tables
from strandframe.operators.motif_scan import Model, search
from strandframe.operators import model_building
from strandframe.operators.structure import SIZES
from strandframe.operators.translate import top_window


def toy_model() -> Model:
    """Two groups of profiles made from a rule: column c likes the letter at (7 * c + shift) % 20, hundredths."""
    def motif(n, shift):
        return [[(160 if k == (7 * c + shift) % 20 else 40 if k == (7 * c + shift + 3) % 20 else -35) for k in range(20)] for c in range(n)]

    return Model({"g1": (motif(12, 0), motif(14, 3), motif(8, 5)), "g2": (motif(12, 9), motif(14, 4), motif(8, 11))}, min_c=300, min_ab=200, min_total=1000)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq_idx"), clean("text").alias("seq")).filter(F.length("seq") > 0)


def motif_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(sequences(spark, sf_dir), toy_model())


def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("aa")).filter("aa <> ''").groupBy("aa").agg(F.count("*").alias("n"))


def top_motif_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost best window of a three-column integer profile."""
    column = lambda good: [300 if a == good else 50 if a in "AEI" else -100 for a in AMINO] + [-100, -100]
    return top_window(sequences(spark, sf_dir), np.array([column(g) for g in "GDD"], np.int32))


def _block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, col (0 to 33), a, b, n of every whole block of 34 letters of the texts: n letters a in a column, and in col -1 blocks that begin with a, b."""
    size, place = sum(SIZES), np.zeros(128, np.int64)
    place[[ord(a) for a in AMINO]] = range(len(AMINO))

    def run(frames):
        for f in frames:
            for lang, texts in f.groupby("lang", dropna=False)["text"]:
                letters, firsts = np.zeros(size * 20, np.int64), np.zeros(400, np.int64)
                for t in texts:
                    s = place[np.frombuffer(clean_text(t).encode(), np.uint8)]
                    s = s[: len(s) // size * size].reshape(-1, size)
                    letters += np.bincount((s + np.arange(size) * 20).ravel(), minlength=size * 20)
                    firsts += np.bincount(s[:, 0] * 20 + s[:, 1], minlength=400)
                i, k = np.flatnonzero(letters), np.flatnonzero(firsts)
                names = np.array(list(AMINO), object)
                yield pd.DataFrame({
                    "group": None if pd.isna(lang) else lang, "col": np.concatenate([i // 20, np.full(len(k), -1)]), "a": names[np.concatenate([i % 20, k // 20])],
                    "b": np.concatenate([np.full(len(i), None), names[k % 20]]), "n": np.concatenate([letters[i], firsts[k]]),
                })

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").filter("text IS NOT NULL")
    return docs.mapInPandas(run, "group string, col int, a string, b string, n long").groupBy("group", "col", "a", "b").agg(F.sum("n").alias("n"))


def motif_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by language from every whole block of 34 letters of the texts, cut into the three motifs; the first two letters of the blocks tell which stand for each other."""
    counts = _Tables(spark).keep(_block_counts(spark, sf_dir), "blocks")  # one pass over the texts
    every = spark.createDataFrame([(a, b, 1) for a in AMINO for b in AMINO], "a string, b string, n long")
    pairs = counts.filter("col = -1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    given, background = model_building.conditional(pairs.unionByName(every))
    motif = F.when(F.col("col") < SIZES[0], "A").when(F.col("col") < SIZES[0] + SIZES[1], "B").otherwise("C")
    col = F.col("col") + 1 - F.when(motif == "A", 0).when(motif == "B", SIZES[0]).otherwise(SIZES[0] + SIZES[1])
    out = model_building.profiles_of_letters(counts.filter("col >= 0").select("group", motif.alias("motif"), col.alias("col"), F.col("a").alias("aa"), "n"), given, background)
    return out.select("group", "motif", F.col("col").cast("long").alias("col"), "aa", F.round("score", 6).alias("score"), F.round("wildcard", 6).alias("wildcard"), "consensus")


_SEQ = "SELECT doc_id AS seq_idx, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM documents"
_V = "CASE WHEN substr(seq, CAST(pos + {k} AS BIGINT), 1) = '{g}' THEN 300 WHEN substr(seq, CAST(pos + {k} AS BIGINT), 1) IN ('A','E','I') THEN 50 ELSE -100 END"
QUERIES = {"motif_search": motif_search, "letter_counts": letter_counts, "top_motif_c": top_motif_c, "motif_profiles": motif_profiles}
_PROFILES = f"""
WITH s AS ({_SEQ.replace("doc_id AS seq_idx", "lang AS grp")}), b AS (SELECT grp, substr(seq, k * 34 + 1, 34) AS b FROM (SELECT grp, seq, unnest(range(length(seq) // 34)) AS k FROM s)),
l AS (SELECT unnest(string_split('{AMINO}', '')) AS aa), pr AS (SELECT substr(b, 1, 1) AS a, substr(b, 2, 1) AS b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT x.aa, y.aa, 1 FROM l x, l y),
j AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr) GROUP BY a, b), m AS (SELECT a, sum(n) AS m FROM j GROUP BY a),
g AS (SELECT j.a AS given, j.b AS aa, n / m AS p FROM j JOIN m USING (a)), bg AS (SELECT a AS aa, m / (SELECT sum(m) FROM m) AS bg FROM m),
c AS (SELECT grp, i, substr(b, CAST(i AS BIGINT), 1) AS aa, count(*) AS n FROM (SELECT grp, b, unnest(range(1, 35)) AS i FROM b) GROUP BY ALL),
t AS (SELECT grp, i, sum(n) AS total, max(n) AS most, arg_max(aa, (n, -ascii(aa))) AS top FROM c GROUP BY grp, i),
f AS (SELECT c.grp, c.i, c.aa, c.n / t.total AS f FROM c JOIN t USING (grp, i)), ps AS (SELECT grp, i, g.aa, sum(f * p) AS ps FROM f JOIN g ON g.given = f.aa GROUP BY ALL),
q AS (SELECT t.grp, t.i, l.aa, coalesce(f.f, 0) + 0.1 * ps.ps AS q FROM t CROSS JOIN l LEFT JOIN f USING (grp, i, aa) JOIN ps USING (grp, i, aa)),
z AS (SELECT grp, i, aa, bg, ln(q / sum(q) OVER (PARTITION BY grp, i) / bg) AS score FROM q JOIN bg USING (aa)), w AS (SELECT *, least(0, sum(bg * score) OVER (PARTITION BY grp, i)) AS wildcard FROM z)
SELECT grp AS "group", CASE WHEN i <= 12 THEN 'A' WHEN i <= 26 THEN 'B' ELSE 'C' END AS motif, CAST(CASE WHEN i <= 12 THEN i WHEN i <= 26 THEN i - 12 ELSE i - 26 END AS BIGINT) AS col, aa, round(score, 6) AS score, round(wildcard, 6) AS wildcard,
    CASE WHEN most < 0.5 * total THEN lower(top) ELSE top END AS consensus FROM w JOIN t USING (grp, i)
"""
SQL = {
    "motif_profiles": _PROFILES,
    "letter_counts": f"WITH s AS ({_SEQ}) SELECT aa, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS aa FROM s WHERE length(seq) > 0) WHERE aa <> '' GROUP BY aa",
    "top_motif_c": f"WITH s AS ({_SEQ}), w AS (SELECT seq_idx, seq, unnest(range(1, length(seq) - 1)) AS pos FROM s WHERE length(seq) >= 3), v AS (SELECT seq_idx, pos, {_V.format(k=0, g='G')} + {_V.format(k=1, g='D')} + {_V.format(k=2, g='D')} AS score FROM w) SELECT seq_idx, CAST(score AS INTEGER) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY score DESC, pos) AS r FROM v) WHERE r = 1",
}
