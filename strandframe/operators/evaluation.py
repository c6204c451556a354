"""True and false positives over scores."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_bins(hits: DataFrame, width: float, top: int) -> DataFrame:
    """bin, tps, fps of (score, tp)."""
    return hits.groupBy(F.least(F.floor(F.col("score") / width), F.lit(top)).alias("bin")).agg(F.count_if("tp").alias("tps"), F.count_if(~F.col("tp")).alias("fps"))


def first_false_positive(hits: DataFrame) -> DataFrame:
    """query, tps_before its first false positive in the order of line, fps. Two grouped passes: no window over a hot query."""
    first = hits.groupBy("query").agg(F.min(F.when(~F.col("tp"), F.col("line"))).alias("fp"))
    j = hits.join(first, "query")
    return j.groupBy("query").agg(F.count_if(F.col("tp") & (F.col("fp").isNull() | (F.col("line") < F.col("fp")))).alias("tps_before"), F.count_if(~F.col("tp")).alias("fps"))


def confusion(calls: DataFrame) -> DataFrame:
    """tp, fp, tn, fn of (truth, call)."""
    t, c = F.col("truth"), F.col("call")
    return calls.agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(~t & ~c).alias("tn"), F.count_if(t & ~c).alias("fn"))


def split_train_test(df: DataFrame, key: str, percent: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """By a hash of the key, so that reruns agree."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < percent
    return df.filter(h), df.filter(~h)


def subsample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def classify_rmsd(pairs: DataFrame) -> DataFrame:
    """Per query of (query, label, positive, rmsd): the best reference, its score 1 - rmsd / 8 in 0..1, the best of the other class."""
    best = pairs.groupBy("query").agg(F.min(F.struct("rmsd", "label", "positive")).alias("t"))
    other = pairs.join(best, "query").filter(F.col("positive") != F.col("t.positive")).groupBy("query").agg(F.min(F.struct("rmsd", "label")).alias("o"))
    return best.join(other, "query", "left").select("query", F.col("t.label").alias("top"), F.col("t.positive").alias("positive"), F.col("t.rmsd").alias("rmsd"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("t.rmsd") / 8)).alias("score"), F.col("o.label").alias("other"), F.coalesce("o.rmsd", F.lit(999.0)).alias("other_rmsd"))


def rmsd_score(rmsd: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rmsd / 8))


def boost(score: Column, share: Column | float) -> Column:
    return F.least(F.lit(1.0), score + (1 - score) * share)


def damp(score: Column, share: Column | float) -> Column:
    return score * (1 - share)


def class_score(top_positive: Column, top: Column, second: Column, gdd: Column, motifs: Column) -> Column:
    """Score of the positive class from the best rmsd and the other class's best (999 for none), the catalytic triple and the super-motif.

    A positive top is not damped by the second; a negative one counts for the positive class if that is at most 0.5 behind."""
    weak = damp(damp(rmsd_score(second), 0.5), rmsd_score(top) / 2)
    score = F.when(top_positive, rmsd_score(top)).when(second - top <= 0.5, weak).otherwise(0.0)
    return F.when(gdd.isin("ADD", "LDD", "VDD"), 0.0).when(gdd.isin("GDD", "SDD", "GDN") & (motifs == "DGD"), boost(score, 0.5)).otherwise(score)


def hit_confidence(rmsd: Column) -> Column:
    r = F.pow(rmsd / 2, 2)
    return (1 + F.exp(r)) / (2 * F.exp(r))


#: fixed values: probability of the positive class by the gate residue and by the catalytic triple
GATE = {"D": 0.9790, "N": 0.6124, "S": 0.8850, "G": 0.9020, "T": 0.9193, "C": 0.8583, "E": 0.7296, "F": 0.0043, "Y": 0.0059}
TRIPLE = {"GDD": 0.9826, "SDD": 0.9440, "GDN": 0.9626, "ADD": 0.0047, "VDD": 0.0107, "IDD": 0.0422, "MDD": 0.1039, "TDD": 0.1221}


def class_probability(gate: Column, triple: Column) -> Column:
    """The smaller of both probabilities; an unknown gate and a triple with X or of another length say nothing (0.5), another triple 0.1."""
    of = lambda kinds: F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    by_gate = F.coalesce(F.try_element_at(of(GATE), gate), F.lit(0.5))
    by_triple = F.when((F.length(triple) != 3) | triple.contains("X"), 0.5).otherwise(F.coalesce(F.try_element_at(of(TRIPLE), triple), F.lit(0.1)))
    return F.least(by_gate, by_triple)


def calibrate(scores: DataFrame, key: str, top: float = 250.0, bins: int = 50) -> DataFrame:
    """key, bin, n, freq: every bin of each key's scores, empty ones too."""
    x = scores.groupBy(key, F.floor(F.least(F.lit(1.0), F.col("score") / top) * bins).alias("bin")).agg(F.count("*").alias("n"))
    total = x.groupBy(key).agg(F.sum("n").alias("total"))
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))))
    return every.join(x, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("freq"))


def gumbel(bins: DataFrame, width: float = 5.0) -> DataFrame:
    """mean, median, mode and mu, beta (from the median) and beta2 (from the mean) of (bin, freq); the first of equal modes. One row a bin."""
    b = bins.withColumn("score", F.col("bin") * width)
    upto = F.sum("freq").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("freq").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = b.withColumn("upto", upto).withColumn("total", total).agg((F.sum(F.col("freq") * F.col("score")) / F.sum("freq")).alias("mean"), F.min(F.when(F.col("upto") >= F.col("total") / 2, F.col("score"))).alias("median"), F.max_by("score", F.struct("freq", -F.col("score"))).alias("mode"))
    # fixed values: ln(ln 2) and Euler's constant
    return s.select("mean", "median", "mode", F.col("mode").alias("mu"), ((F.col("mode") - F.col("median")) / -0.36651292058166435).alias("beta"), ((F.col("mean") - F.col("mode")) / 0.5772156649).alias("beta2"))


def score_levels(hits: DataFrame, rates: tuple = (0.1, 1.0, 10.0), queries: int | None = None) -> DataFrame:
    """errors per query, sensitivity and score where the false positives of (query, score, tp), best first, first exceed each rate a query."""
    n = queries or hits.select("query").distinct().count()
    per = hits.groupBy("score").agg(F.count_if("tp").alias("tps"), F.count_if(~F.col("tp")).alias("fps"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.select("score", F.sum("tps").over(w).alias("tps"), F.sum("fps").over(w).alias("fps"))
    total = per.agg(F.sum("tps").alias("all"))
    levels = hits.sparkSession.createDataFrame([(float(r),) for r in rates], "rate double")
    at = run.join(F.broadcast(levels), F.col("fps") <= F.col("rate") * n).groupBy("rate").agg(F.max("tps").alias("tps"), F.min("score").alias("score"))
    return at.join(F.broadcast(total)).select("rate", "score", (F.col("tps") / F.col("all")).alias("sensitivity"))
