"""Relational operators on the driver tables, each with its SQL."""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import accession, annotation, reverse_complement
from strandframe.operators import evaluation, linkage, merge, training, translate
from strandframe.operators.graph import connected_components


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_dupes(spark, d):
    """First row of each exact text: a min per text, no window over whole groups."""
    return _t(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


def get_labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n"))


def get_unlabelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


def accessions(spark, d):
    return _t(spark, d, "documents").select("doc_id", accession("text").alias("acc"))


def _nt(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("nt"))


def six_frames(spark, d):
    return translate.six_frames(_nt(spark, d), "doc_id", "nt").select("doc_id", "frame", F.length("aa").alias("n"), F.md5("aa").alias("aa_md5")).filter("n >= 20")


def reverse_complements(spark, d):
    return _nt(spark, d).select("doc_id", F.md5(reverse_complement("nt")).alias("rc_md5"))


def fev_roundtrip(spark, d):
    lines = _t(spark, d, "events").select(F.concat_ws("\t", F.concat(F.lit("e"), "event_id"), F.concat(F.lit("type="), "event_type"), F.concat(F.lit("user="), "user_id")).alias("line"))
    return merge.parse_fev(lines).groupBy(F.col("fields")["type"].alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.col("fields")["user"].cast("long")).alias("users"))


def score_bins(spark, d):
    return evaluation.score_bins(_t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "N").alias("tp")), 1000.0, 100)


def first_fp(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("line"), (F.col("event_type") == "click").alias("tp"))
    return evaluation.first_false_positive(e)


def quartiles(spark, d):
    return training.quartiles(_t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("v")), "l_returnflag", "v")


def gumbel_moments(spark, d):
    h = _t(spark, d, "lineitem").groupBy(F.floor("l_quantity").alias("bin")).agg(F.count("*").alias("n"))
    return h.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("bin") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode"))


def calibrate(spark, d):
    x = _t(spark, d, "lineitem").select("l_suppkey", F.least(F.floor(F.col("l_quantity") / 5), F.lit(50)).alias("bin"))
    return x.groupBy("l_suppkey", "bin").agg(F.count("*").alias("n"))


def letters_by_column(spark, d):
    """Letters by column over every column of the whole texts, which begin in the same one."""
    s = _t(spark, d, "documents").select("lang", F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("row"))
    return training.column_counts(s, "lang", "row")


def letters_by_block(spark, d):
    """Letters by column over every block of 34 letters of the whole texts; a last or only block that is shorter counts in the columns it has."""
    s = _t(spark, d, "documents").select("lang", F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s"))
    return training.column_counts(s.select("lang", F.explode(F.regexp_extract_all("s", F.lit("(.{1,34})"), F.lit(1))).alias("row")), "lang", "row")


def correlation(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def _xyz(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", "label", *[(F.round(e[k].cast("double") * 1000)).cast("long").alias(x) for k, x in enumerate("xyz")])


def neighbour_counts(spark, d):
    """Points of the same label within a radius: an equi join on grid cells of the radius, not a cross join."""
    p, r = _xyz(spark, d), 250
    cell = lambda c: F.floor(F.col(c) / r)
    a = p.select("vec_id", "label", "x", "y", "z", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    near = a
    for c in ("cx", "cy", "cz"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
    b = near.select(F.col("vec_id").alias("v2"), F.col("label"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), "cx", "cy", "cz")
    j = a.join(b, ["label", "cx", "cy", "cz"]).filter("vec_id <> v2 AND (x-x2)*(x-x2)+(y-y2)*(y-y2)+(z-z2)*(z-z2) <= 62500")
    n = j.groupBy("vec_id").agg(F.count("*").alias("n"))
    return p.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"))


def chain_steps(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    s = _xyz(spark, d).select("vec_id", "label", *[(F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in "xyz"])
    return s.select("vec_id", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).alias("d2"))


def hse_pivot(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0).select("l_linenumber", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def hierarchy_rollup(spark, d):
    p = _t(spark, d, "part").select(F.split("p_type", " ").alias("t"))
    return p.select(F.col("t")[0].alias("a"), F.coalesce(F.get("t", F.lit(1)), F.lit("")).alias("b")).rollup("a", "b").agg(F.count("*").alias("n"))


def single_linkage(spark, d):
    e = _t(spark, d, "orders").select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") % 997 * 2 + 1).alias("v"))
    return connected_components(e).withColumnRenamed("id", "node")


def order_linkage(spark, d):
    """Components of customers and their orders by the real keys: many, where single_linkage has one."""
    e = _t(spark, d, "orders").select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") * 2 + 1).alias("v"))
    return connected_components(e).withColumnRenamed("id", "node")


def _quantities(spark, d):
    """Parts and suppliers by number in one space, joined by the quantity of their lines."""
    return _t(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("w"))


def linkage_clusters(spark, d):
    """Single linkage at the greatest quantity, each cluster with its representative and the spread around it."""
    e = _quantities(spark, d)
    out = linkage.representatives(e, linkage.clusters(e, 50.0))
    return out.select("cluster", "size", "centroid", *[F.round(c, 6).alias(c) for c in ("least", "mean", "median", "greatest")])


def top_k(spark, d):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return _t(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("l_returnflag", "l_orderkey", "l_linenumber", "r")


def annotate_scores(spark, d):
    return _t(spark, d, "lineitem").select(annotation(F.col("l_discount") * 20).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))


def evidence_scores(spark, d):
    e = _t(spark, d, "events").select("event_id", merge.evalue_score(F.pow(F.lit(10.0), -F.floor(F.abs("value") % 120))).alias("score"))
    return e.groupBy(F.round("score").cast("long").alias("score")).agg(F.count("*").alias("n"))


_TX = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
_NT = "SELECT doc_id, translate(regexp_replace(text, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS nt FROM documents"
_XYZ = "SELECT vec_id, label, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS x, CAST(round(CAST(embedding[2] AS DOUBLE) * 1000) AS BIGINT) AS y, CAST(round(CAST(embedding[3] AS DOUBLE) * 1000) AS BIGINT) AS z FROM embeddings"
QUERIES = {f.__name__: f for f in (remove_dupes, get_labelled, get_unlabelled, accessions, six_frames, reverse_complements, fev_roundtrip, score_bins, first_fp, quartiles, gumbel_moments, calibrate, letters_by_column, letters_by_block, correlation, neighbour_counts, chain_steps, hse_pivot, hierarchy_rollup, single_linkage, order_linkage, linkage_clusters, top_k, annotate_scores, evidence_scores)}
SQL = {
    "remove_dupes": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text",
    "get_labelled": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "get_unlabelled": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "accessions": "SELECT doc_id, split_part(text, ' ', 1) AS acc FROM documents",
    "reverse_complements": f"SELECT doc_id, md5(reverse(translate(nt, 'ACGT', 'TGCA'))) AS rc_md5 FROM ({_NT})",
    "six_frames": f"WITH s AS ({_NT}), b AS (SELECT doc_id, 1 AS st, nt AS q FROM s UNION ALL SELECT doc_id, -1, reverse(translate(nt, 'ACGT', 'TGCA')) FROM s), f AS (SELECT doc_id, st * k AS frame, k, q FROM b, (VALUES (1), (2), (3)) AS v(k)), a AS (SELECT doc_id, frame, list_transform(range(k, length(q) - 1, 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (instr('TCAG', substr(q, i, 1)) - 1) * 16 + (instr('TCAG', substr(q, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(q, i + 2, 1)), 1)) AS aa FROM f) SELECT doc_id, CAST(frame AS INTEGER) AS frame, CAST(len(aa) AS INTEGER) AS n, md5(array_to_string(aa, '')) AS aa_md5 FROM a WHERE len(aa) >= 20",
    "fev_roundtrip": "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type",
    "score_bins": "SELECT least(CAST(floor(l_extendedprice / 1000) AS BIGINT), 100) AS bin, count(*) FILTER (l_returnflag = 'N') AS tps, count(*) FILTER (l_returnflag <> 'N') AS fps FROM lineitem GROUP BY 1",
    "first_fp": "WITH e AS (SELECT user_id AS query, event_id AS line, event_type = 'click' AS tp FROM events), m AS (SELECT query, min(line) FILTER (NOT tp) AS fp FROM e GROUP BY query) SELECT query, count(*) FILTER (tp AND (fp IS NULL OR line < fp)) AS tps_before, count(*) FILTER (NOT tp) AS fps FROM e JOIN m USING (query) GROUP BY query",
    "quartiles": "WITH s AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(n) AS n, max(v) FILTER (r = n // 4) AS q1, max(v) FILTER (r = n // 2) AS q2, max(v) FILTER (r = 3 * n // 4) AS q3 FROM s GROUP BY l_returnflag",
    "gumbel_moments": "WITH h AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(bin * n) / sum(n), 6) AS mean, (SELECT bin FROM h ORDER BY n DESC, bin LIMIT 1) AS mode FROM h",
    "calibrate": "SELECT l_suppkey, least(CAST(floor(l_quantity / 5) AS BIGINT), 50) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "letters_by_column": f"WITH s AS (SELECT lang, {_TX} AS w FROM documents), p AS (SELECT lang, unnest(string_split(w, '')) AS aa, unnest(range(1, len(w) + 1)) AS col FROM s WHERE w <> '') SELECT lang, CAST(col AS INTEGER) AS col, aa, count(*) AS n FROM p GROUP BY ALL",
    "letters_by_block": f"WITH s AS (SELECT lang, {_TX} AS w FROM documents), p AS (SELECT lang, unnest(string_split(w, '')) AS aa, unnest(range(len(w))) AS i FROM s WHERE w <> '') SELECT lang, CAST(i % 34 + 1 AS INTEGER) AS col, aa, count(*) AS n FROM p GROUP BY ALL",
    "correlation": "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "neighbour_counts": f"WITH p AS ({_XYZ}) SELECT a.vec_id, count(b.vec_id) AS n FROM p a LEFT JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 62500 GROUP BY 1",
    "chain_steps": f"WITH p AS ({_XYZ}), s AS (SELECT vec_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, dx*dx + dy*dy + dz*dz AS d2 FROM s",
    "hse_pivot": "SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
    "hierarchy_rollup": "SELECT split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', 2) AS b, count(*) AS n FROM part GROUP BY ROLLUP (1, 2)",
    "top_k": "SELECT l_returnflag, l_orderkey, l_linenumber, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10",
    "annotate_scores": "SELECT CASE WHEN l_discount * 20 >= 1 THEN '|' WHEN l_discount * 20 >= 0.5 THEN '+' WHEN l_discount * 20 > 0 THEN '.' ELSE ' ' END AS mark, count(*) AS n FROM lineitem GROUP BY 1",
    "single_linkage": "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS u, o_orderkey % 997 * 2 + 1 AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, lab) AS (SELECT (SELECT min(u) FROM b), (SELECT min(u) FROM b) UNION SELECT b.v, r.lab FROM r JOIN b ON b.u = r.node) SELECT node, lab AS component FROM r",
    "linkage_clusters": "WITH RECURSIVE q AS (SELECT l_partkey AS src, l_suppkey AS dst, max(CAST(l_quantity AS DOUBLE)) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2), "
    "s AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, avg(w) AS w FROM q GROUP BY 1, 2), b AS (SELECT u, v FROM s WHERE w >= 50 UNION SELECT v, u FROM s WHERE w >= 50), "
    "l AS (SELECT l_partkey AS label FROM lineitem UNION SELECT l_suppkey FROM lineitem), r(label, lab) AS (SELECT label, label FROM l UNION SELECT b.v, least(r.lab, b.v) FROM r JOIN b ON b.u = r.label WHERE r.lab < b.v), "
    "c AS (SELECT label, min(lab) AS cluster FROM r GROUP BY label), n AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster), "
    "e AS (SELECT x.cluster, s.u, s.v, s.w FROM s JOIN c x ON x.label = s.u JOIN c y ON y.label = s.v WHERE x.cluster = y.cluster), f AS (SELECT cluster, u AS label, w FROM e UNION ALL SELECT cluster, v, w FROM e), "
    "t AS (SELECT cluster, label, sum(w) AS t FROM f GROUP BY ALL), m AS (SELECT n.cluster, size, CASE WHEN size > 2 THEN coalesce((SELECT arg_max(label, (t, -label)) FROM t WHERE t.cluster = n.cluster AND t > 0), n.cluster) ELSE n.cluster END AS centroid FROM n), "
    "o AS (SELECT f.cluster, list_sort(list(f.w)) AS l FROM f JOIN m ON m.cluster = f.cluster AND m.centroid = f.label AND m.size > 2 GROUP BY f.cluster) "
    "SELECT m.cluster, m.size, m.centroid, round(coalesce(l[1], 0), 6) AS least, round(coalesce(list_avg(l), 0), 6) AS mean, round(coalesce(l[len(l) // 2 + 1], 0), 6) AS median, round(coalesce(l[len(l)], 0), 6) AS greatest FROM m LEFT JOIN o USING (cluster)",
    "order_linkage": "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS u, o_orderkey * 2 + 1 AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, lab) AS (SELECT u, u FROM b UNION SELECT b.v, r.lab FROM r JOIN b ON b.u = r.node) SELECT node, min(lab) AS component FROM r GROUP BY node",
}
