"""Reports, record merge, classification and chain features on the driver tables, each with its SQL.

Hits are set by a rule on texts cleaned to amino letters (260 at least): A, B, C at 31, 81, 141 for even ids, C, A, B
for odd ones. Chains are those of plans.structure."""
from pyspark.sql import functions as F

from strandframe.operators import evaluation, features, merge, reports, structure
from strandframe.plans.motif import _SEQ, sequences, toy_model
from strandframe.plans.structure import _P, SCALE, chains

_AT = {"a": (31, 81, 12), "b": (81, 141, 14), "c": (141, 31, 8)}  # place in even and odd rows, length


def hits(spark, d):
    even = F.col("seq_idx") % 2 == 0
    s = sequences(spark, d).filter(F.length("seq") >= 260)
    for x, (a, b, n) in _AT.items():
        s = s.withColumn(f"pos_{x}", F.when(even, a).otherwise(b)).withColumn(f"seq_{x}", F.substring("seq", F.col(f"pos_{x}"), F.lit(n)))
    s = s.withColumn("abc", F.when(even, "ABC").otherwise("CAB")).withColumn("ql", F.length("seq")).withColumn("lo", F.lit(31)).withColumn("hi", F.when(even, 148).otherwise(154))
    s = s.withColumn("score", (1500 + F.col("seq_idx") % 10 * 100).cast("int")).withColumn("group", F.when(F.col("seq_idx") % 3 == 0, "g1").otherwise("g2"))
    return s.withColumn("group2", F.when(F.col("seq_idx") % 4 != 0, "g1")).withColumn("diff2", (F.col("seq_idx") % 7 * 10).cast("int"))


_HITS = f"""s AS ({_SEQ}), h AS (SELECT *, CASE WHEN seq_idx % 2 = 0 THEN 'ABC' ELSE 'CAB' END AS abc, length(seq) AS ql, 31 AS lo, CASE WHEN seq_idx % 2 = 0 THEN 148 ELSE 154 END AS hi,
CASE WHEN seq_idx % 2 = 0 THEN 31 ELSE 81 END AS pos_a, CASE WHEN seq_idx % 2 = 0 THEN 81 ELSE 141 END AS pos_b, CASE WHEN seq_idx % 2 = 0 THEN 141 ELSE 31 END AS pos_c,
1500 + seq_idx % 10 * 100 AS score, CASE WHEN seq_idx % 3 = 0 THEN 'g1' ELSE 'g2' END AS "group", CASE WHEN seq_idx % 4 <> 0 THEN 'g1' END AS group2, seq_idx % 7 * 10 AS diff2 FROM s WHERE length(seq) >= 260),
m AS (SELECT *, substr(seq, pos_a, 12) AS seq_a, substr(seq, pos_b, 14) AS seq_b, substr(seq, pos_c, 8) AS seq_c FROM h)"""


def left_flanks(spark, d):
    return reports.flanks(hits(spark, d), True)


def right_flanks(spark, d):
    return reports.flanks(hits(spark, d), False, least=20)


def hit_cores(spark, d):
    return reports.cores(hits(spark, d), least_flank=10)


def hit_motifs(spark, d):
    return reports.motif_records(reports.exclude(hits(spark, d), ["g1"]))


def hit_prints(spark, d):
    return reports.prints(reports.gate(hits(spark, d), 16.0))


def hit_evidence(spark, d):
    return reports.evidence(hits(spark, d))


def c_filter(spark, d):
    return reports.c_filter(sequences(spark, d), toy_model(), 400)


def merge_records(spark, d):
    """Three callers' motifs by place of the text; positions, trim, print and span of each record."""
    s = sequences(spark, d)
    sub = lambda p, n: F.substring("seq", p, n)
    odd = F.col("seq_idx") % 2 == 1
    vote = lambda k, n: merge.motif_vote([F.when(F.col("seq_idx") % 5 != k, sub(20 * k, n)), F.when(odd, sub(20 * k, n)).otherwise(sub(20 * k + 1, n)), sub(20 * k + 1, n)])
    s = s.select("seq_idx", "seq", vote(1, 6).alias("ma"), vote(2, 3).alias("mb0"), vote(3, 5).alias("mc"))
    s = s.withColumn("mb", F.when(F.col("seq_idx") % 3 == 0, F.substring("seq", 90, 5)).otherwise(F.col("mb0")))
    s = s.select("seq_idx", F.length("seq").alias("n"), "ma", "mb", "mc", *[merge.motif_position(F.col(f"m{x}"), F.col("seq")).alias(x) for x in "abc"])
    lo, hi = merge.alignment_span([F.when(F.col("seq_idx") % 7 != 0, F.lit(5)), F.lit(9)], [F.lit(200), F.when(F.col("seq_idx") % 2 == 0, F.lit(100))])
    s = s.withColumn("t", merge.full_trim(F.col("a"), F.col("b"), F.col("c"), F.col("n"), lo, hi)).withColumn("p", merge.print_span(F.col("a"), F.col("b"), F.col("c")))
    return s.select("seq_idx", "ma", "mb", "mc", "a", "b", "c", F.col("t.lo").alias("trim_lo"), F.col("t.hi").alias("trim_hi"), "t.method", F.col("p.lo").alias("print_lo"), F.col("p.hi").alias("print_hi"))


def evidence_classes(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(merge.evalue_score(F.pow(F.lit(10.0), -F.col("l_quantity"))).alias("p"), merge.evalue_score(F.pow(F.lit(10.0), -F.col("l_linenumber") * 7 + 10)).alias("m"), (F.col("l_returnflag") == "A").alias("w"))
    return merge.class_counts(e.select(F.round(merge.evidence_class(F.round("p", 6), F.round("m", 6), F.col("w")), 4).alias("score")))


def _triples(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    kinds = F.array(*map(F.lit, ("GDD", "SDD", "ADD", "XDD", "LDD", "GDN", "KDD")))
    gdd = F.get(kinds, (F.col("l_partkey") % 7).cast("int"))
    return l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("top"), F.when(F.col("l_suppkey") % 4 == 0, 999.0).otherwise(F.col("l_quantity") / 5 + F.col("l_discount") * 10).alias("second"), (F.col("l_returnflag") != "N").alias("pos"), gdd.alias("gdd"), F.when(F.col("l_linestatus") == "O", "DGD").otherwise("DGX").alias("motifs"), F.substring(F.lit("DNSGTCEFYW"), F.col("l_suppkey").cast("int") % 10 + 1, F.lit(1)).alias("gate"))


def class_scores(spark, d):
    return _triples(spark, d).select("l_orderkey", "l_linenumber", F.round(evaluation.class_score(F.col("pos"), F.col("top"), F.col("second"), F.col("gdd"), F.col("motifs")), 6).alias("score"), F.round(evaluation.hit_confidence(F.col("top")), 6).alias("confidence"))


def class_probabilities(spark, d):
    return _triples(spark, d).groupBy("gate", "gdd", evaluation.class_probability(F.col("gate"), F.col("gdd")).alias("p")).agg(F.count("*").alias("n"))


def calibration(spark, d):
    x = evaluation.calibrate(spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", (F.col("l_extendedprice") / 300).alias("score")), "l_returnflag")
    return x.withColumn("freq", F.round("freq", 9))


def gumbel_fit(spark, d):
    h = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("bin")).agg(F.count("*").cast("double").alias("freq"))
    g = evaluation.gumbel(h)
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


def score_levels(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("query"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_returnflag") == "N").alias("tp"))
    x = evaluation.score_levels(e, (5.0, 50.0, 200.0))
    return x.withColumn("sensitivity", F.round("sensitivity", 9))


def chain_features(spark, d):
    f = features.features(chains(spark, d), "vec_id")
    return f.select("vec_id", "pos", *[F.round(c, 4).alias(c) for c in ("ang_m2_p2", "ang_m3_p3", "ed_p4", "ed_m4")], "nu", "nd", "nu_bin", "nd_bin")


def smoothed_chains(spark, d):
    i = F.col("i")
    return chains(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("vec_id", "i", *[F.round(features.smoothed(F.col(f"{x}s"), i, 10, 3), 4).alias(x) for x in "xyz"])


def chain_sketches(spark, d):
    ss = structure.secondary_structure(F.col("xs"), F.col("ys"), F.col("zs"))
    return chains(spark, d).withColumn("ss", ss).select("vec_id", features.sketch(F.col("ss"), 8).alias("sketch"), features.sketch(F.col("ss"), 8, True).alias("usual"))


_LBL = "' A:' || (pos_a - {0} + 1) || ':' || seq_a || ' B:' || (pos_b - {0} + 1) || ':' || seq_b || ' C:' || (pos_c - {0} + 1) || ':' || seq_c || ' PSSM:' || \"group\""
_LO = _LBL.format("lo")
_F = "CASE WHEN abc = 'CAB' THEN pos_c ELSE pos_a END"
_R = "CASE WHEN abc = 'CAB' THEN pos_b + 14 ELSE pos_c + 8 END"
_C = " + ".join(f"CASE WHEN w[p + {c}] = '{{0[{c}]}}' THEN 160 WHEN w[p + {c}] = '{{1[{c}]}}' THEN 40 ELSE -35 END" for c in range(8))
_AA = "ACDEFGHIKLMNPQRSTVWY"
_OF = lambda shift, more: [_AA[(7 * c + shift + more) % 20] for c in range(8)]
_V3 = "CASE WHEN {0} <> '' AND ({0} = {1} OR {0} = {2}) THEN {0} WHEN {1} <> '' AND {1} = {2} THEN {1} WHEN {0} <> '' THEN {0} WHEN {1} <> '' THEN {1} ELSE coalesce({2}, '') END"
_MOTIF = lambda k, n: _V3.format(f"coalesce(CASE WHEN seq_idx % 5 <> {k} THEN substr(seq, {20 * k}, {n}) END, '')", f"(CASE WHEN seq_idx % 2 = 1 THEN substr(seq, {20 * k}, {n}) ELSE substr(seq, {20 * k + 1}, {n}) END)", f"substr(seq, {20 * k + 1}, {n})")
_POS = "CASE WHEN length(m{0}) >= 4 AND instr(seq, m{0}) > 0 AND instr(substr(seq, instr(seq, m{0}) + 1), m{0}) = 0 THEN CAST(instr(seq, m{0}) AS INTEGER) END AS {0}"
_LIN = "SELECT l_orderkey, l_linenumber, l_quantity / 5 AS top, CASE WHEN l_suppkey % 4 = 0 THEN 999.0 ELSE l_quantity / 5 + l_discount * 10 END AS second, l_returnflag <> 'N' AS pos, (['GDD','SDD','ADD','XDD','LDD','GDN','KDD'])[l_partkey % 7 + 1] AS gdd, CASE WHEN l_linestatus = 'O' THEN 'DGD' ELSE 'DGX' END AS motifs, substr('DNSGTCEFYW', CAST(l_suppkey % 10 + 1 AS BIGINT), 1) AS gate FROM lineitem"
_RS = "greatest(0.0, least(1.0, 1 - {} / 8))"
_LE = "CASE WHEN {0} > 0.1 THEN 0.0 WHEN {0} <= 1e-100 THEN 100.0 ELSE -log10({0}) END"


def _case(kinds, of):
    return " ".join(f"WHEN {of} = '{k}' THEN {v}" for k, v in kinds.items())


def _angle(k):
    u = [f"(m.{x} - l{k}.{x})" for x in "xyz"]
    w = [f"(r{k}.{x} - m.{x})" for x in "xyz"]
    dot = lambda a, b: " + ".join(f"{i} * {j}" for i, j in zip(a, b, strict=True))
    return f"CASE WHEN l{k}.x IS NOT NULL AND r{k}.x IS NOT NULL THEN round(degrees(acos(greatest(-1.0, least(1.0, ({dot(u, w)}) / sqrt(({dot(u, u)}) * ({dot(w, w)})))))), 4) END"


def _symbol(three: str, usual: bool) -> str:
    c = [three.count(x) for x in "hst~"]
    if usual:
        return "hst~"[c.index(max(c))]
    best, must = 0, c[0]
    for j in (1, 2, 3):
        if c[j] > must:
            best, must = j, c[best]
    return "hst~"[best]


def _sketch_sql(usual: bool) -> str:
    kinds = {a + b + c: _symbol(a + b + c, usual) for a in "hst~" for b in "hst~" for c in "hst~"}
    part = lambda i: "CASE " + _case({k: f"'{v}'" for k, v in kinds.items()}, f"substr(ss, {2 + i * 16 // 8} + 1, 3)") + " END"
    return " || ".join(part(i) for i in range(8))


QUERIES = {f.__name__: f for f in (left_flanks, right_flanks, hit_cores, hit_motifs, hit_prints, hit_evidence, c_filter, merge_records, evidence_classes, class_scores, class_probabilities, calibration, gumbel_fit, score_levels, chain_features, smoothed_chains, chain_sketches)}
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def sql(half_spheres: str, secondary_structure: str) -> dict:
    return {
        "left_flanks": f"WITH {_HITS} SELECT seq_idx, abc, 'group=' || \"group\" AS suffix, substr(seq, greatest(1, {_F} - 149), least({_F} - 1, 149)) AS flank FROM m WHERE score >= 2000",
        "right_flanks": f"WITH {_HITS} SELECT seq_idx, abc, 'group=' || \"group\" AS suffix, substr(seq, {_R}, least(150, length(seq) - ({_R}) + 1)) AS flank FROM m WHERE score >= 2000 AND {_R} < length(seq) AND least(150, length(seq) - ({_R}) + 1) >= 20",
        "hit_cores": f"WITH {_HITS}, c AS (SELECT *, least({_F} - 1, 149) AS lf, least(length(seq) - (CASE WHEN abc = 'CAB' THEN pos_a ELSE pos_c END), 150) AS rf, {_F} - least({_F} - 1, 149) AS k, CASE WHEN abc = 'CAB' THEN pos_a ELSE pos_c END AS z FROM m), "
        f"o AS (SELECT *, score >= 2000 AND lf >= 10 AND rf >= 10 AS ok FROM c) SELECT seq_idx, CASE WHEN ok THEN abc END AS abc, CASE WHEN ok THEN {_LBL.format('k')} END AS suffix, CASE WHEN ok THEN substr(seq, k, z + rf - k + 1) END AS core FROM o",
        "hit_motifs": f"WITH {_HITS} SELECT seq_idx, abc, seq_a || seq_b || seq_c AS motifs FROM m WHERE \"group\" <> 'g1'",
        "hit_prints": f"WITH {_HITS} SELECT seq_idx, abc, {_LO} AS suffix, substr(seq, lo, hi - lo + 1) AS print FROM m WHERE score > 1600",
        "hit_evidence": f"WITH {_HITS} SELECT concat_ws(chr(9), CAST(seq_idx AS VARCHAR), 'pssm_score=' || printf('%.1f', score / 100), 'pssm_group=' || \"group\", 'pssm_group2=' || coalesce(group2, '.'), 'pssm_diff2=' || printf('%+.1f', diff2 / 100), 'pssm_ABC=' || abc, 'pssm_seqA=' || seq_a, 'pssm_posA=' || pos_a, 'pssm_seqB=' || seq_b, 'pssm_posB=' || pos_b, 'pssm_seqC=' || seq_c, 'pssm_posC=' || pos_c) AS line FROM m",
        "c_filter": f"WITH s AS ({_SEQ}), t AS (SELECT seq_idx, string_split(seq, '') AS w, length(seq) AS n FROM s WHERE length(seq) >= 8), v AS (SELECT seq_idx, n, p, array_to_string(w[p : p + 7], '') AS seq_c, {_C.format(_OF(5, 0), _OF(5, 3))} AS s1, {_C.format(_OF(11, 0), _OF(11, 3))} AS s2 FROM (SELECT *, unnest(range(1, n - 6)) AS p FROM t)) "
        ", h AS (SELECT *, s1 > 300 AS h1, s2 > 300 AS h2 FROM v WHERE s1 > 300 OR s2 > 300), k AS (SELECT *, min(p) FILTER (h1 AND h2) OVER (PARTITION BY seq_idx) AS d FROM h), "
        "x AS (SELECT *, NOT h1 OR coalesce(p = d AND s2 > s1, false) AS second FROM k WHERE h1 OR d IS NULL OR p < d), y AS (SELECT *, CASE WHEN second THEN s2 ELSE s1 END AS score FROM x) "
        "SELECT seq_idx, CAST(p AS INTEGER) AS pos, CAST(score AS INTEGER) AS score, CASE WHEN second THEN 'g2' ELSE 'g1' END AS \"group\", CAST(greatest(0, p - 151) + 1 AS INTEGER) AS lo, CAST(least(n - 1, p - 1 + 158) + 1 AS INTEGER) AS hi, "
        f"seq_c, CASE WHEN second THEN '{''.join(_OF(11, 0))}' ELSE '{''.join(_OF(5, 0))}' END AS consensus FROM y WHERE score >= 400",
        "merge_records": f"WITH s AS (SELECT * FROM ({_SEQ}) WHERE length(seq) > 0), v AS (SELECT seq_idx, seq, {_MOTIF(1, 6)} AS ma, CASE WHEN seq_idx % 3 = 0 THEN substr(seq, 90, 5) ELSE {_MOTIF(2, 3)} END AS mb, {_MOTIF(3, 5)} AS mc FROM s), q AS (SELECT *, CAST(length(seq) AS INTEGER) AS n, {_POS.format('a')}, {_POS.format('b')}, {_POS.format('c')} FROM v), "
        "r AS (SELECT *, CASE WHEN a < c THEN '150AC150' WHEN c < b THEN '150CB150' WHEN b IS NOT NULL THEN '200B200' WHEN c IS NOT NULL THEN '250C150' WHEN a IS NOT NULL THEN '150A250' ELSE 'aln' END AS method FROM q) "
        "SELECT seq_idx, ma, mb, mc, a, b, c, CAST(CASE method WHEN '150AC150' THEN greatest(1, a - 150) WHEN '150CB150' THEN greatest(1, c - 150) WHEN '200B200' THEN greatest(1, b - 200) WHEN '250C150' THEN greatest(1, c - 250) WHEN '150A250' THEN greatest(1, a - 150) ELSE CASE WHEN seq_idx % 7 <> 0 THEN 5 ELSE 9 END END AS INTEGER) AS trim_lo, "
        "CAST(CASE method WHEN '150AC150' THEN least(n, c + 150) WHEN '150CB150' THEN least(n, b + 150) WHEN '200B200' THEN least(n, b + 200) WHEN '250C150' THEN least(n, c + 150) WHEN '150A250' THEN least(n, a + 250) ELSE CASE WHEN seq_idx % 2 = 0 THEN 100 ELSE 200 END END AS INTEGER) AS trim_hi, method, "
        "CASE WHEN b IS NOT NULL AND a < c THEN a WHEN c < b THEN c END AS print_lo, CASE WHEN b IS NOT NULL AND a < c THEN c + 7 WHEN c < b THEN b + 13 END AS print_hi FROM r",
        "evidence_classes": f"WITH e AS (SELECT round({_LE.format('pow(10.0, -l_quantity)')}, 6) AS p, round({_LE.format('pow(10.0, -l_linenumber * 7 + 10)')}, 6) AS m, l_returnflag = 'A' AS w FROM lineitem), "
        "s AS (SELECT round(CASE WHEN w OR p = 0 THEN 0.0 WHEN m = 0 THEN CASE WHEN p >= 10 THEN 100.0 ELSE 50 + p * 5 END WHEN m - p > 1 THEN 0.0 WHEN m > p THEN 50.0 WHEN p - m > 10 THEN 100.0 ELSE 50 + 5 * (p - m) END, 4) AS score FROM e) "
        "SELECT count(*) AS records, count(*) FILTER (score = 100) AS n100, count(*) FILTER (score >= 90 AND score < 100) AS n90, count(*) FILTER (score >= 50 AND score < 90) AS n50, count(*) FILTER (score >= 1 AND score < 50) AS n1, count(*) FILTER (score < 1) AS n0 FROM s",
        "class_scores": f"WITH t AS ({_LIN}), s AS (SELECT *, CASE WHEN pos THEN {_RS.format('top')} WHEN second - top <= 0.5 THEN {_RS.format('second')} * 0.5 * (1 - {_RS.format('top')} / 2) ELSE 0.0 END AS raw FROM t) "
        "SELECT l_orderkey, l_linenumber, round(CASE WHEN gdd IN ('ADD', 'LDD', 'VDD') THEN 0.0 WHEN gdd IN ('GDD', 'SDD', 'GDN') AND motifs = 'DGD' THEN raw + (1 - raw) * 0.5 ELSE raw END, 6) AS score, round((1 + exp(pow(top / 2, 2))) / (2 * exp(pow(top / 2, 2))), 6) AS confidence FROM s",
        "class_probabilities": f"SELECT gate, gdd, least(CASE {_case(evaluation.GATE, 'gate')} ELSE 0.5 END, CASE WHEN contains(gdd, 'X') THEN 0.5 {_case(evaluation.TRIPLE, 'gdd')} ELSE 0.1 END)::DOUBLE AS p, count(*) AS n FROM ({_LIN}) GROUP BY ALL",
        "calibration": "WITH x AS (SELECT l_returnflag, CAST(floor(least(1.0, l_extendedprice / 300 / 250) * 50) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT l_returnflag, sum(n) AS t FROM x GROUP BY 1), e AS (SELECT l_returnflag, t, unnest(range(0, 51)) AS bin FROM k) SELECT l_returnflag, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 9) AS freq FROM e LEFT JOIN x USING (l_returnflag, bin)",
        "gumbel_fit": "WITH h AS (SELECT floor(l_extendedprice / 5000) * 5.0 AS s, CAST(count(*) AS DOUBLE) AS f FROM lineitem GROUP BY 1), c AS (SELECT *, sum(f) OVER (ORDER BY s) AS upto, sum(f) OVER () AS t FROM h), g AS (SELECT sum(f * s) / sum(f) AS mean, min(s) FILTER (upto >= t / 2) AS median, (SELECT s FROM h ORDER BY f DESC, s LIMIT 1) AS mode FROM c) "
        "SELECT round(mean, 6) AS mean, median, mode, mode AS mu, round((mode - median) / -0.36651292058166435, 6) AS beta, round((mean - mode) / 0.5772156649, 6) AS beta2 FROM g",
        "score_levels": "WITH e AS (SELECT l_suppkey AS query, CAST(l_quantity AS DOUBLE) AS score, l_returnflag = 'N' AS tp FROM lineitem), p AS (SELECT score, count(*) FILTER (tp) AS tps, count(*) FILTER (NOT tp) AS fps FROM e GROUP BY score), r AS (SELECT score, sum(tps) OVER w AS tps, sum(fps) OVER w AS fps FROM p WINDOW w AS (ORDER BY score DESC)), n AS (SELECT count(DISTINCT query) AS n, count(*) FILTER (tp) AS t FROM e) "
        "SELECT CAST(rate AS DOUBLE) AS rate, min(score) AS score, round(max(tps) / max(t), 9) AS sensitivity FROM r, n, (VALUES (5), (50), (200)) v(rate) WHERE fps <= rate * n GROUP BY 1",
        "chain_features": f"WITH p AS ({_P}), hs AS ({half_spheres}) SELECT m.vec_id, m.i AS pos, {_angle(2)} AS ang_m2_p2, {_angle(3)} AS ang_m3_p3, "
        + ", ".join(f"round(sqrt((m.x - {t}.x) * (m.x - {t}.x) + (m.y - {t}.y) * (m.y - {t}.y) + (m.z - {t}.z) * (m.z - {t}.z)), 4) AS {n}" for t, n in (("r4", "ed_p4"), ("l4", "ed_m4")))
        + ", coalesce(up, 0) AS nu, coalesce(down, 0) AS nd, CAST(least(7, coalesce(up, 0) // 3) AS INTEGER) AS nu_bin, CAST(least(7, (CASE WHEN coalesce(down, 0) > 10 THEN down - 10 ELSE coalesce(down, 0) END) // 2) AS INTEGER) AS nd_bin FROM p m "
        + " ".join(f"LEFT JOIN p {s}{k} ON {s}{k}.vec_id = m.vec_id AND {s}{k}.i = m.i {'-' if s == 'l' else '+'} {k}" for k in (2, 3, 4) for s in "lr")
        + " LEFT JOIN hs ON hs.vec_id = m.vec_id AND hs.pos = m.i",
        "smoothed_chains": f"WITH p AS ({_P}), k AS (SELECT i, CAST(floor((i + k) * 20 / 10.0 + 0.5) AS INTEGER) AS j, 3 - abs((i + k) * 20 / 10.0 - floor((i + k) * 20 / 10.0 + 0.5)) AS w FROM range(0, 10) a(i), range(-1, 4) b(k)) SELECT vec_id, CAST(k.i AS INTEGER) AS i, round(sum(w * x) / sum(w), 4) AS x, round(sum(w * y) / sum(w), 4) AS y, round(sum(w * z) / sum(w), 4) AS z FROM k JOIN p ON p.i = k.j + 1 GROUP BY vec_id, k.i",
        "chain_sketches": f"SELECT vec_id, {_sketch_sql(False)} AS sketch, {_sketch_sql(True)} AS usual FROM ({secondary_structure})",
    }
