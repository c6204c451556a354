"""Operator 3: mixing sources to target weights, by DataFrame functions only.

Golden-ratio points fall into the sources' cumulative shares; a slot's rank within its source names the equal-token
block it takes of that source's shuffled stream, which repeats up to `most` times. What a source gives is what the
points ask of it: a few of its own blocks more or less than its target. Sources are few: their table is ordered in one
task. Null texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows
are rows of their own; an empty table gives no rows; columns beside doc_id, source and text are not read. Reruns agree:
the shuffle is a hash of doc_id, or of the text where that is null.
"""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

WORD = "[^\\x20\\x09-\\x0D]+"
GOLDEN = 0.6180339887498949
BLOCK = 512
CELLS = 1024


def _join(a: DataFrame, b: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """a with b's other columns; nulls in the keys are equal."""
    b = b.select(*[F.col(c).alias(f"{c}__r" if c in keys else c) for c in b.columns])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}__r"))
        on = one if on is None else on & one
    return a.join(b, on, how).drop(*[f"{k}__r" for k in keys])


def targets(sizes: DataFrame, most: float = 3.0, weights=(1, 2, 3)) -> DataFrame:
    """source, source_size, target: the total shared by weight, none above `most` times its size, excess reshared.

    With level L the target is min(weight * L, most * size); sources reach their cap in order of most * size / weight,
    so L follows from running sums in that order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double")).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.col("rest_w"))
    # the first source below its cap fixes the level of all later ones
    w = w.withColumn("open", F.col("cap") > F.col("level") * F.col("w")).withColumn("L", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"])
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("L") * F.col("w")), F.col("cap")).alias("target"))


def blocks(shares: DataFrame, most: int = BLOCK, parts: int = 200) -> DataFrame:
    """shares with block, the words of each of the source's blocks: at most `most`, and small enough that its own target is `parts` blocks.

    A source's slots are target / block, so that every stretch of slots holds words in the ratio of the targets whatever
    the blocks' sizes; a small source adds few slots and leaves the others' as they are."""
    return shares.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("target") / parts))).cast("long"))


def schedule(shares: DataFrame) -> DataFrame:
    """slot, source, rank: slot k's source is the one in whose share of [0, 1) the k-th golden-ratio point falls; rank counts the source's slots so far.

    shares has source, target and block; a source's share goes by its blocks."""
    spark = shares.sparkSession
    t = shares.filter("target > 0").withColumn("want", F.col("target") / F.col("block"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = t.withColumn("hi", F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole, n = t.agg(F.coalesce(F.max("hi"), F.lit(0.0)), F.count("*")).first()
    t = t.select("source", ((F.col("hi") - F.col("want")) / max(whole, 1.0)).alias("lo"), (F.col("hi") / max(whole, 1.0)).alias("hi"))
    many = max(CELLS, 4 * n)  # cells of [0, 1) in which points and shares meet
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * many), F.least(F.floor(F.col("hi") * many), F.lit(many - 1)))))
    points = spark.range(-int(-whole // 1)).select(F.col("id").alias("slot"), F.expr(f"(id + 1) * {GOLDEN}D - floor((id + 1) * {GOLDEN}D)").alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * many))
    own = points.join(cells, "cell").filter("u >= lo AND u < hi").select("source", "slot", F.floor(F.col("slot") / 4096).alias("part"))
    counts = own.groupBy("source", "part").count()
    counts = counts.withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    in_part = own.withColumn("i", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1)
    return _join(in_part, counts.drop("count"), ["source", "part"]).select("slot", "source", (F.coalesce("before", F.lit(0)) + F.col("i")).alias("rank"))


def place(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each row's place in its source's shuffled stream (source, bucket, nth, at), and the sizes."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", "source", size.alias("size"), h.alias("h"))
    sizes = materialize(sizes, "mix-sizes")
    buckets = max(64, sizes.count() // 2000)
    s = sizes.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = s.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    placed = s.withColumn("own", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).withColumn("nth", F.row_number().over(inner))
    return _join(placed, sums, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("own")), sizes


def stream(docs: DataFrame, most: int = 3, block: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces in order (slot, at): source, rank, doc_id, start and words of the piece; and the placed rows.

    Pass p of a source's stream has its row at [at + p * source_size, + size); block r is its words [r * block, (r + 1) * block).
    block: words a block for every source; None takes each source's own (`blocks`)."""
    at, sizes = place(docs, seed)
    shares = targets(sizes, most)
    shares = materialize(shares.withColumn("block", F.lit(block).cast("long")) if block else blocks(shares), "mix-targets")
    slots = materialize(schedule(shares), "mix-slots")
    shares = _join(shares, slots.groupBy("source").agg(F.count("*").alias("slots")), ["source"], "left")
    placed = materialize(_join(at, shares, ["source"]).select("doc_id", "source", "size", "bucket", "nth", "at", "source_size", "target", "block", F.coalesce("slots", F.lit(0)).alias("slots")), "mix-placed")
    runs = placed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("p"))
    runs = runs.withColumn("lo", F.col("at") + F.col("p") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("slots") * F.col("block"))).filter("lo < hi")
    ranks = F.expr("sequence(lo div block, (hi - 1) div block)")
    pieces = runs.select("source", "bucket", "nth", "doc_id", "lo", "hi", "block", F.explode(ranks).alias("rank"))
    first = F.greatest("lo", F.col("rank") * F.col("block"))
    pieces = pieces.select("source", "rank", "bucket", "nth", "doc_id", first.alias("at"), (first - F.col("lo")).alias("start"), (F.least("hi", (F.col("rank") + 1) * F.col("block")) - first).alias("words"))
    return _join(pieces, slots, ["source", "rank"]), placed


def mix(docs: DataFrame, **kw) -> DataFrame:
    """docs' doc_id and source with size, source_size, target and taken (words of the stream, repeats counted), one row per row."""
    pieces, placed = stream(docs, **kw)
    took = pieces.groupBy("source", "bucket", "nth").agg(F.sum("words").alias("taken"))
    return _join(placed, took, ["source", "bucket", "nth"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat_taken(docs: DataFrame, **kw) -> DataFrame:
    """Whole documents: each as many times as the mix takes its words, rounded. Sizeless documents stay once."""
    mark = "_"
    while any(c.lower().endswith(mark) for c in docs.columns):  # names that no column of docs has
        mark += "_"
    d, s, z, times, again = (x + mark for x in ("d", "s", "z", "times", "again"))
    m = mix(docs.select("doc_id", "source", "text"), **kw).groupBy("doc_id", "source", "size").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")))).cast("int").alias(times))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    m = m.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), times)
    out = docs.join(m, docs.doc_id.eqNullSafe(m[d]) & docs.source.eqNullSafe(m[s]) & (size == m[z]))
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), m[times])).alias(again)).drop(again)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")
