"""Profiles and statistics from aligned rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_counts(rows: DataFrame, group: str, row: str) -> DataFrame:
    """group, col (from 1), aa, n over aligned rows; counted before the shuffle."""
    return rows.select(group, F.posexplode(F.split(row, "")).alias("p", "aa")).filter("aa <> ''").groupBy(group, (F.col("p") + 1).alias("col"), "aa").agg(F.count("*").alias("n"))


def profile(counts: DataFrame, group: str, background: DataFrame, conditional: DataFrame, pseudo: float = 0.1) -> DataFrame:
    """group, col, aa, score = ln(freq / bg), wildcard: counts to frequencies, mixed with substitution pseudo-counts.

    background: aa, bg. conditional: given, aa, p (20 x 20)."""
    total = counts.join(background, "aa", "left_semi").groupBy(group, "col").agg(F.sum("n").alias("total"))
    raw = counts.join(total, [group, "col"]).select(group, "col", F.col("aa").alias("given"), (F.col("n") / F.col("total")).alias("f"))
    ps = raw.join(F.broadcast(conditional), "given").groupBy(group, "col", "aa").agg(F.sum(F.col("f") * F.col("p")).alias("ps"))
    mixed = ps.join(raw.withColumnRenamed("given", "aa"), [group, "col", "aa"], "left").withColumn("q", F.coalesce("f", F.lit(0.0)) + pseudo * F.col("ps"))
    norm = mixed.groupBy(group, "col").agg(F.sum("q").alias("qs"))
    s = mixed.join(norm, [group, "col"]).join(F.broadcast(background), "aa").withColumn("score", F.log(F.col("q") / F.col("qs") / F.col("bg")))
    wild = s.groupBy(group, "col").agg(F.least(F.lit(0.0), F.sum(F.col("bg") * F.col("score"))).alias("wildcard"))
    return s.join(wild, [group, "col"]).select(group, "col", "aa", "score", "wildcard")


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values at the sorted places n / 4, n / 2 and 3 n / 4, from counts of distinct values: no group is gathered."""
    from pyspark.sql import Window

    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    c = c.withColumn("hi", F.sum("c").over(Window.partitionBy(group).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda p: F.max(F.when((F.expr(p) >= F.col("hi") - F.col("c")) & (F.expr(p) < F.col("hi")), F.col(value)))
    return c.groupBy(group).agg(F.max("n").alias("n"), at("n div 4").alias("q1"), at("n div 2").alias("q2"), at("3 * n div 4").alias("q3"))


def log_odds(pairs: DataFrame, bins: int = 8) -> DataFrame:
    """i, j, score of joint bins: symmetrised counts, one pseudo-count, 10 log10 of the ratio, -3 and 3 beyond its ends."""
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    spark = pairs.sparkSession
    cells = spark.range(bins * bins).select((F.col("id") % bins).alias("i"), F.floor(F.col("id") / bins).alias("j"))
    joint = both.groupBy("i", "j").agg(F.count("*").alias("n"))
    one = both.groupBy("i").agg(F.count("*").alias("m"))
    total = both.agg(F.count("*").alias("t"))
    p = cells.join(joint, ["i", "j"], "left").join(one, "i", "left").join(one.select(F.col("i").alias("j"), F.col("m").alias("k")), "j", "left").join(F.broadcast(total))
    r = (F.coalesce("n", F.lit(0)) / F.col("t")) / (((F.coalesce("m", F.lit(0)) + 1) / F.col("t")) * ((F.coalesce("k", F.lit(0)) + 1) / F.col("t")))
    return p.select("i", "j", F.when(r < 0.001, -3.0).when(r > 100, 3.0).otherwise(10 * F.log10(r)).alias("score"))


def mean_matrix(cells: DataFrame) -> DataFrame:
    """i, j, mean and population deviation of (i, j, value)."""
    return cells.groupBy("i", "j").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
