"""Single linkage over a table of similarities, with each cluster's representative and the spread around it.

Only the edge table is joined and summed: no matrix is held and no cluster is gathered. What several steps read is a table
in the shared folder, which the result reads too.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.first_centroid import _Tables
from strandframe.operators.graph import connected_components
from strandframe.operators.training import quartiles


def symmetric(edges: DataFrame) -> DataFrame:
    """u, v, w with u < v of (src, dst, w): the mean of both directions, or the one there is. Of repeated rows the greatest counts; loops and nulls are left out."""
    one = edges.filter("src <> dst AND w IS NOT NULL").groupBy("src", "dst").agg(F.max("w").alias("w"))
    return one.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.avg("w").alias("w"))


def clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """label, cluster (its least label) for every label of the edges; similarities of at least the threshold join."""
    labels = edges.select(F.col("src").alias("label")).union(edges.select("dst")).filter("label IS NOT NULL").distinct()
    near = connected_components(symmetric(edges).filter(F.col("w") >= threshold))
    return labels.join(near.select(F.col("id").alias("label"), "component"), "label", "left").select("label", F.coalesce("component", "label").alias("cluster"))


def representatives(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, size, centroid, least, mean, median, greatest: the member whose similarities to its cluster add up to most, and what they are.

    Under three members, or where no sum is above 0, the least label leads; of equal sums too. Under three members the spread is 0.
    All known similarities within the cluster count, those under the threshold too; median is the value at place n / 2 from 0."""
    tables = _Tables(edges.sparkSession)
    members = tables.keep(members.select("label", "cluster"), "members")
    s = symmetric(edges)
    a = members.select(F.col("label").alias("u"), F.col("cluster").alias("cu"))
    b = members.select(F.col("label").alias("v"), F.col("cluster").alias("cv"))
    within = s.join(a, "u").join(b, "v").filter("cu = cv")
    # read four times below, so the joins are made once
    within = tables.keep(within.select(F.col("cu").alias("cluster"), "u", "v", "w"), "within")
    both = within.select("cluster", F.col("u").alias("label"), "w").unionByName(within.select("cluster", F.col("v").alias("label"), "w"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    total = tables.keep(both.groupBy("cluster", "label").agg(F.sum("w").alias("t")).filter("t > 0"), "total")
    best = total.groupBy("cluster").agg(F.max("t").alias("t"))
    lead = total.join(best, ["cluster", "t"]).groupBy("cluster").agg(F.min("label").alias("lead"))
    lead = size.join(lead, "cluster", "left").select("cluster", "size", F.when(F.col("size") > 2, F.coalesce("lead", "cluster")).otherwise(F.col("cluster")).alias("centroid"))
    lead = tables.keep(lead, "lead")
    own = tables.keep(both.join(lead.filter("size > 2").select("cluster", F.col("centroid").alias("label")), ["cluster", "label"]), "own")
    spread = own.groupBy("cluster").agg(F.min("w").alias("least"), F.avg("w").alias("mean"), F.max("w").alias("greatest"))
    middle = quartiles(own, "cluster", "w").select("cluster", F.col("q2").alias("median"))
    out = lead.join(spread, "cluster", "left").join(middle, "cluster", "left")
    return out.select("cluster", "size", "centroid", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("least", "mean", "median", "greatest")])


def cluster_lines(tops: DataFrame, members: DataFrame) -> DataFrame:
    """tag, size, line: a C line a cluster (its least label, size, centroid, least, mean, median and greatest value) and an M line a label; sort by tag, size descending to write."""
    four = [F.format_string("%.4g", c) for c in ("least", "mean", "median", "greatest")]
    c = tops.select(F.lit("C").alias("tag"), "size", F.concat_ws("\t", F.lit("C"), "cluster", "size", "centroid", *four).alias("line"))
    m = members.select(F.lit("M").alias("tag"), F.lit(0).cast("long").alias("size"), F.concat_ws("\t", F.lit("M"), "label", "cluster").alias("line"))
    return c.unionByName(m)
