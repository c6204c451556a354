"""Operator 13: audit of how far sources lie apart, from joint count histograms.

Tasks count terms (lower-cased A-Z, runs of letters) of whole texts by hash and hand on sums by (lang, source, term).
Each language keeps the terms that at least `least` of its documents hold. Kept terms with the same counts in the same
sources are one vector with a multiplicity; from the vectors each pair of sources tallies how many terms have a count a
here and b there. Cells with a zero are implied: they are a source's own tally (or all terms) less what the pair shares,
so no term is spelled out for a source that lacks it. The divergence f is evaluated once a cell and multiplied.

p = 1 + floor(10**9 * (count + 1) / (N + V)), N a group's kept occurrences, V the language's kept terms;
f = floor((p - q)**2 / q). Arithmetic is on whole numbers of up to 38 digits.

Null text, lang and source are ''. A source without kept terms is a group too (all its counts are 0); a language with one
source has no pair rows. Ties of value go by the item's UTF-8 bytes. Rows that repeat count as documents of their own.
Empty table: no rows. Other columns are not looked at. Within a task terms are told apart by 64-bit hashes.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table
from ._words import _class, chunks, trimmed, words

LETTERS = _class([(0, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LEAST = 3
TOP = 200
SCALE = 1_000_000_000
#: sums that a task holds before it hands them on
HELD = 600_000
_CELL = "lang string, source string, term string, n long, docs long"


class _Counts:
    """Sums by (group, term hash) of a task: sorted keys, merged when new ones are as many as old ones."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.terms: dict[int, bytes] = {}
        self.parts: list[tuple] = []
        self.size = self.merged = 0

    def add(self, group: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
        starts, ends, h, first = words(data, off, LETTERS)
        if not len(h):
            return
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        row = np.repeat(np.arange(len(group)), np.diff(first))
        key, n = np.unique(row * len(u) + inv, return_counts=True)  # a term in a text
        g, t = group[key // len(u)].astype(np.int64), key % len(u)
        cell, back = np.unique(g * len(u) + t, return_inverse=True)
        self.parts.append((cell // len(u), u[cell % len(u)], np.bincount(back, n).astype(np.int64), np.bincount(back)))
        self.size += len(cell)
        if new := [(k, i) for k, i in zip(u.tolist(), at.tolist(), strict=True) if k not in self.terms]:
            low = data[: ends[-1]].tobytes().lower()  # of bytes: A-Z alone
            self.terms.update((k, low[starts[i] : ends[i]]) for k, i in new)

    def merge(self) -> None:
        g, h, n, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((h, g))
        g, h, n, d = g[order], h[order], n[order], d[order]
        edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
        self.parts = [(g[edge], h[edge], np.add.reduceat(n, edge), np.add.reduceat(d, edge))]
        self.size = self.merged = len(edge)

    def flush(self):
        """What was summed up, in batches; a group's first row has no term, so that groups without terms are known."""
        names = list(self.groups)
        lang, source = ([x[k] for x in names] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.nulls(len(names), pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([0] * len(names), pa.int64())], names=["lang", "source", "term", "n", "docs"])
        if self.parts:
            self.merge()
            g, h, n, d = self.parts[0]
            known = np.fromiter(self.terms, np.uint64, len(self.terms))
            order = np.argsort(known)
            term = order[np.searchsorted(known, h, sorter=order)]
            terms, lang, source = pa.array(list(self.terms.values()), pa.binary()).cast(pa.string()), pa.array(lang, pa.string()), pa.array(source, pa.string())
            for i in range(0, len(g), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(g[s])), source.take(pa.array(g[s])), terms.take(pa.array(term[s])), pa.array(n[s]), pa.array(d[s].astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n occurrences, docs that hold it: sums of tasks, some keys more than once; term is null once a task and group."""

    def run(batches):
        c = _Counts()
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            group = np.array([c.groups.setdefault(x, len(c.groups)) for x in names], np.int64)
            for i, k, data, off in chunks(b.column(2)):
                c.add(group[i : i + k], data, off)
                if c.size > max(2 * c.merged, held):
                    c.merge()
                if c.merged > held or len(c.terms) > held:
                    yield from c.flush()
                    groups, c = c.groups, _Counts()
                    c.groups = groups
        yield from c.flush()

    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), "text").mapInArrow(trimmed(run), _CELL)


def _p(count, total):
    """p of a count in a group of which total = N + V; exact, as the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total)).cast("long")


def _f(p, q):
    """p and q are at most 10**9 + 1, so the square fits into 63 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("docs").alias("docs"))
    terms = materialize(terms.filter(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"), "divergence-terms")
    kept = terms.filter("term IS NOT NULL")
    occurring = terms.filter("term IS NULL").select("lang", F.explode("cells.source").alias("source"))

    # tallies: equal vectors of counts once, each with its number of terms
    vectors = materialize(kept.groupBy("lang", "cells").agg(F.count("*").alias("m")), "divergence-vectors")
    own = vectors.select("lang", "m", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("n")).agg(F.sum("m").alias("m"))
    own = materialize(own, "divergence-own")
    size = vectors.groupBy("lang").agg(F.sum("m").alias("v"))
    groups = occurring.join(own.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("n")), ["lang", "source"], "left").join(size, "lang", "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "divergence-groups")

    both = groups.select("lang", F.col("source").alias("a"), (F.col("n") + F.col("v")).alias("ta"), "v").join(groups.select("lang", F.col("source").alias("b"), (F.col("n") + F.col("v")).alias("tb")), "lang").filter("a < b")
    shared = vectors.select("lang", "m", "cells", F.posexplode("cells").alias("i", "x"))
    shared = shared.select("lang", "m", "x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    shared = shared.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.sum("m").alias("m"))
    zero, keys = F.lit(0).cast("long"), ["lang", "a", "b"]
    cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    na, nb, m = F.col("na"), F.col("nb"), F.col("m")
    cells = shared.select(*keys, F.explode(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))).alias("c"))
    one = lambda side, c: both.select(*keys).join(own.select("lang", F.col("source").alias(side), "n", "m"), ["lang", side]).select(*keys, F.explode(F.array(c, cell(zero, zero, -m))).alias("c"))
    cells = cells.unionByName(one("a", cell(F.col("n"), zero, m))).unionByName(one("b", cell(zero, F.col("n"), m))).unionByName(both.select(*keys, cell(zero, zero, F.col("v")).alias("c")))
    tally = cells.groupBy(*keys, "c.na", "c.nb").agg(F.sum("c.m").alias("m")).filter("m > 0")
    tally = both.join(tally, keys, "left").withColumn("p", _p(na, F.col("ta"))).withColumn("q", _p(nb, F.col("tb")))
    times = lambda f: F.coalesce(F.sum(f.cast("decimal(20,0)") * m.cast("decimal(18,0)")), F.lit(0)).cast("long")
    value = tally.groupBy(*keys).agg(times(_f(F.col("p"), F.col("q"))).alias("ab"), times(_f(F.col("q"), F.col("p"))).alias("ba"))
    side = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value"))
    pairs = value.select("lang", F.explode(F.array(side("a", "b", "ab"), side("b", "a", "ba"))).alias("r")).select("lang", "r.*")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))

    # a term's count in the whole language against its count in each source that has it
    whole = size.join(groups.groupBy("lang").agg(F.sum("n").alias("nl")), "lang").select("lang", (F.col("nl") + F.col("v")).alias("tl"))
    each = kept.select("lang", "term", F.aggregate("cells.n", zero, lambda x, y: x + y).alias("all"), F.explode("cells").alias("c"))
    each = each.select("lang", "term", "all", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    each = each.join(groups.select("lang", "source", (F.col("n") + F.col("v")).alias("ts")).join(whole, "lang"), ["lang", "source"])
    each = each.withColumn("p", _p(F.col("n"), F.col("ts"))).withColumn("q", _p(F.col("all"), F.col("tl"))).filter("p > q")
    each = each.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).unionByName(each.withColumn("part", F.lit("term")).select(*out))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS nl FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(nl) AS tot FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, v.tot, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN v USING (lang) LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0)::HUGEINT + 1)) // (s.n + s.v) AS p, 1 + ({SCALE} * (k.nl::HUGEINT + 1)) // (s.tot + s.v) AS q FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
