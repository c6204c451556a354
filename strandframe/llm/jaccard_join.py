"""Operator 9: exact n-gram Jaccard join by universe-partition pigeonhole.

Index. Shingle hashes are dealt into segments. A set's band follows from its size, and a band's theta bounds the
difference of any pair whose smaller set it holds. A band's allotment is the cheaper, by signatures and by the
meetings that the corpus' size lets expect, of one unit a segment (it must be equal; theta + c segments, so that a
linked pair agrees in c of them) and two units (it may differ by one deletion, so the one-deletion neighbourhood is
indexed too; theta / 2 + 1 segments). By the measured frequencies of signatures each set then keeps a subset of its
segments: a set with fewer than c shared signatures links with nothing, and the c - 1 most frequent ones need not be
looked up, for a pair that agrees in c segments agrees in a rarer one.

Verification. Under each signature all members are verified exactly against one of them, its pivot, and linked ones
are contracted. What is left are members of different components under one signature. Their differences from the
pivot, known exactly by then, differ from each other as the members do, but without what all of them share; so a
prefix filter on the differences, rarest elements first, leaves few pairs, whose differences are compared exactly.
No group is paired with itself as a whole and nothing is capped.

Null or empty texts have an empty set and link with nothing; fewer than n words are one shingle; equal sets are one
class; rows that repeat a doc_id are judged by their own texts; component_id is the smallest doc_id, null where the
component has none; extra columns are ignored; an empty table gives no rows. Sets are known by 79 bits of a hash.
"""
import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.operators.graph import connected_components

from ._shared import discard, materialize, parts_for, table
from ._words import NONSPACE, chunks, mix, trimmed, words

_U = np.uint64
SLACK = 0.25  # spare segments, as a share of theta
BITS = 12  # a shingle is taken to be in one of 2 ** BITS sets


def shingle_sets(arr: pa.Array, n: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for i, k, data, off in chunks(arr):
        _, _, h, first = words(data, off, NONSPACE)
        with np.errstate(over="ignore"):
            g = np.zeros(max(0, len(h) - n + 1), _U)
            for j in range(n):
                g = mix(g * _U(0xD1342543DE82EF95) + h[j : len(h) - n + 1 + j]) if len(h) >= n else g
            for r in range(k):
                a, z = int(first[r]), int(first[r + 1])
                if z - a >= n:
                    yield i + r, np.unique(g[a : z - n + 1])
                elif z > a:
                    x = _U(z - a)
                    for w in h[a:z]:
                        x = mix(x * _U(0xD1342543DE82EF95) + w)
                    yield i + r, np.array([x], _U)
                else:
                    yield i + r, np.zeros(0, _U)


def set_id(s: np.ndarray) -> tuple[int, int]:
    """64 and 15 bits of a hash of the set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=10).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little") >> 1


@functools.lru_cache(8)
def edges(num: int, den: int) -> np.ndarray:
    """The smallest sizes of the bands: (den / num) ** 2 apart, so a linked pair lies in one band or in two adjacent ones."""
    w, out = (den / num) ** 2, [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * w - 1e-9)))
    return np.array(out)


@functools.lru_cache(4096)
def plan(band: int, num: int, den: int, crowd: int = 1 << 20) -> tuple[int, int, int]:
    """Segments, units each and the segments in which a linked pair agrees, for pairs whose smaller set is in the band (the larger in it or the next)."""
    top = int(edges(num, den)[band + 1]) - 1
    theta = (den - num) * (top + top * den // num) // (den + num)
    c = 1 + math.ceil(theta * SLACK)

    def cost(m, signatures):
        return signatures + m * crowd * 2.0 ** -min(1000, BITS * top / m)

    two = theta // 2 + 1
    return (theta + c, 1, c) if theta == 0 or cost(theta + c, theta + c) <= cost(two, two + top) else (two, 2, 1)


def signatures(s: np.ndarray, num: int, den: int, crowd: int = 1 << 20):
    """(role, shared signatures that a linked pair has at least, signatures): role 0 in the set's own band, 1 in the one below it."""
    if not len(s):
        return
    cut = edges(num, den)
    own = int(np.searchsorted(cut, len(s), "right")) - 1
    with np.errstate(over="ignore"):
        v = mix(s ^ _U(0xA0761D6478BD642F))
        for role, band in enumerate((own, own - 1)):
            if role and (not own or -(-len(s) * num // den) >= cut[own]):
                return  # no smaller band holds a set that may link
            m, units, c = plan(band, num, den, crowd)
            seg = ((v >> _U(32)) * _U(m)) >> _U(32)
            order = np.argsort(seg, kind="stable")
            sg, sv = seg[order].astype(np.int64), v[order]
            sums, size = np.zeros(m, _U), np.bincount(sg, minlength=m)
            at = np.flatnonzero(np.r_[True, sg[1:] != sg[:-1]])
            sums[sg[at]] = np.add.reduceat(sv, at)
            salt = mix(np.arange(m, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(band + 1) * _U(0xE7037ED1A0B428DB))
            full = mix(sums + salt + size.astype(_U) * _U(0x8EBC6AF09C88C6E3))
            if units == 2:  # whole, and with one element taken out
                yield role, 1, np.unique(np.r_[full, mix(sums[sg] - sv + salt[sg] + (size[sg] - 1).astype(_U) * _U(0x8EBC6AF09C88C6E3))])
            elif (empty := int((size == 0).sum())) < c:  # fewer empty segments than a pair agrees in: they need no signature
                yield role, c - empty, full[size > 0]
            else:
                yield role, 1, full


def index_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles and the set's id (lo, hi) of each row."""

    def run(batches):
        for b in batches:
            got = [(len(s), *set_id(s)) for _, s in shingle_sets(b.column(2), n)]
            size, lo, hi = zip(*got, strict=True) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int32())], names=["doc_id", "text_key", "n_shingles", "lo", "hi"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(trimmed(run), "doc_id long, text_key long, n_shingles long, lo long, hi int")


def index_signatures(docs: DataFrame, n: int, num: int, den: int, crowd: int) -> DataFrame:
    """x (48 bits of the signature, hi, role), lo and need; a set met again in a task is left out there."""

    def run(batches):
        seen: set = set()
        for b in batches:
            buf, rows = [], 0

            def flush(buf):
                x, lo, need = (np.concatenate(v) for v in zip(*buf, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(lo), pa.array(need)], names=["x", "lo", "need"])

            for _, s in shingle_sets(b.column(0), n):
                key = set_id(s)
                if key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                for role, need, g in signatures(s, num, den, crowd):
                    buf.append(((g & ~_U(0xFFFF)) | _U(key[1] << 1 | role), np.full(len(g), key[0], np.int64), np.full(len(g), need, np.int32)))
                    rows += len(g)
                if rows >= 100_000:
                    yield flush(buf)
                    buf, rows = [], 0
            if buf:
                yield flush(buf)

    return docs.select("text").mapInArrow(trimmed(run), "x long, lo long, need int")


def kept_signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig, lo, hi: of each set the signatures to look up, chosen by their measured frequencies."""
    by_sig, by_set = Window.partitionBy("sig"), Window.partitionBy("lo", "own")
    rows = index_signatures(docs, n, num, den, max(1, docs.count())).withColumn("sig", F.shiftrightunsigned("x", 16))
    other = (F.min("lo").over(by_sig) < F.max("lo").over(by_sig)) | (F.min("x").over(by_sig) < F.max("x").over(by_sig))
    shared = rows.withColumn("other", other).withColumn("n", F.count("*").over(by_sig)).filter("other")
    shared = materialize(shared.select("sig", "n", "lo", F.col("x").bitwiseAND(0xFFFF).cast("int").alias("own"), "need"), "jaccard-shared")
    one = shared.repartition(parts_for(shared), "lo").dropDuplicates(["lo", "own", "sig"])
    one = one.withColumn("c", F.count("*").over(by_set)).filter("c >= need").withColumn("rank", F.row_number().over(by_set.orderBy("n", "sig"))).filter("rank <= c - need + 1")
    out = materialize(one.select("sig", "lo", F.shiftrightunsigned("own", 1).alias("hi")), "jaccard-kept")
    discard(shared)
    return out


def pivots(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, id and the pivot of each signature that several sets keep: the member that meets most others."""
    by_sig = Window.partitionBy("sig")
    rows = materialize(kept.join(nodes.select("lo", "hi", "id"), ["lo", "hi"]).select("sig", "id").withColumn("n", F.count("*").over(by_sig)).filter("n > 1"), "jaccard-members")
    weight = rows.groupBy("id").agg(F.sum("n").alias("w"))
    top = F.max(F.struct("w", (-F.col("id")).alias("id"))).over(by_sig)
    out = materialize(rows.select("sig", "id").join(weight, "id").withColumn("pivot", -top["id"]).select("sig", "id", "pivot"), "jaccard-pivots")
    discard(rows)
    return out


def verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, each: int = 64) -> DataFrame:
    """pairs (pivot, id) with pivot_size, size, linked and diff (the elements in one of the two sets only): exact, on whole texts.

    A pivot's pairs are dealt to tasks by `each`, so that no pivot's members meet in one."""
    per = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / each).alias("deals"))
    rows = pairs.join(per, "pivot").withColumn("deal", F.pmod(F.xxhash64("id"), "deals").cast("int")).drop("deals")
    rows = materialize(rows, "jaccard-dealt")
    t = texts.select(F.col("id").alias("t_"), "text")
    heads = rows.select("pivot", "deal").distinct().withColumn("id", F.col("pivot")).withColumn("head", F.lit(True))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads).join(t, F.col("id") == F.col("t_"))
    both = both.select("pivot", "deal", "head", "id", "text").repartition(parts_for(texts), "pivot", "deal").sortWithinPartitions("pivot", "deal", F.desc("head"), "id")

    def run(batches):
        base, names = np.zeros(0, _U), ["pivot", "id", "pivot_size", "size", "linked", "diff"]
        for b in batches:
            for a in range(0, b.num_rows, 256):
                p = b.slice(a, 256)
                pivot, head, ids, out = p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(2).to_pylist(), []
                for r, s in shingle_sets(p.column(3), n):
                    if head[r]:
                        base = s
                    else:
                        diff = np.setxor1d(base, s, assume_unique=True)
                        total = len(base) + len(s)
                        out.append((pivot[r], ids[r], len(base), len(s), den * (total - len(diff)) >= num * (total + len(diff)), diff.view(np.int64)))
                if out:
                    *cols, diffs = zip(*out, strict=True)
                    at = np.r_[0, np.cumsum([len(x) for x in diffs])].astype(np.int32)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(diffs)))], names=names)

    return both.select("pivot", "head", "id", "text").mapInArrow(trimmed(run), "pivot long, id long, pivot_size long, size long, linked boolean, diff array<long>")


def links_apart(rows: DataFrame, tested: DataFrame, cc: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: the links between members of one signature that are in different components so far.

    With D and E the members' differences from the pivot, |A ^ B| = |D ^ E|; a pair links if that is at most
    (den - num) / (den + num) of |A| + |B|, which asks for a certain overlap of D and E. The first common element, in
    an order by frequency, must leave that many elements after it in both (positions are the prefix filter)."""
    c = cc.select(F.col("id").alias("c_"), "component")
    comp = rows.join(c, F.col("id") == F.col("c_"), "left").select("sig", "pivot", "id", F.coalesce("component", "id").alias("comp"))
    by = Window.partitionBy("sig")
    open_ = comp.withColumn("a", F.min("comp").over(by)).withColumn("b", F.max("comp").over(by)).filter("a <> b AND id <> pivot").select("pivot", "id", "comp").distinct()
    d = materialize(tested.join(open_, ["pivot", "id"]).select("pivot", "id", "comp", "size", F.size("diff").cast("long").alias("q"), "diff"), "jaccard-open")
    e = materialize(d.select("pivot", "id", "comp", F.explode("diff").alias("e")), "jaccard-elements")
    many = e.groupBy("pivot", "e").agg(F.count("*").alias("df"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("pivot", "e", "df")
    own = Window.partitionBy("pivot", "id")
    e2 = e.select("pivot", "id", "e").join(many, ["pivot", "e"]).join(d.select("pivot", "id", "comp", "size", "q"), ["pivot", "id"])
    e2 = e2.withColumn("at", F.row_number().over(own.orderBy("df", "e")) - 1 + F.col("q") - F.count("*").over(own))  # elements that no other component has come first
    least = F.greatest(F.lit(1), F.col("q") - F.expr(f"{den - num} * (size + size * {den} div {num}) div {den + num}"))
    e2 = materialize(e2.filter(F.col("at") <= F.col("q") - least).select("pivot", "e", "id", "comp", "size", "q", "at"), "jaccard-prefixes")
    f = e2.select("pivot", "e", *[F.col(x).alias(f"{x}2") for x in ("id", "comp", "size", "q", "at")])
    room = f"2 * least(q - at, q2 - at2) * {den + num} >= (q + q2) * {den + num} - {den - num} * (size + size2)"
    close = f"size * {num} <= size2 * {den} AND size2 * {num} <= size * {den}"
    pairs = e2.join(f, ["pivot", "e"]).filter(f"id < id2 AND comp <> comp2 AND {close} AND {room}").groupBy("id", "id2").agg(F.min("pivot").alias("pivot"))
    left = d.select("pivot", "id", "size", "diff")
    right = d.select("pivot", F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("diff").alias("diff2"))
    apart = F.size("diff") + F.size("diff2") - 2 * F.size(F.array_intersect("diff", "diff2"))
    found = materialize(pairs.join(left, ["pivot", "id"]).join(right, ["pivot", "id2"]).filter(apart * (den + num) <= (den - num) * (F.col("size") + F.col("size2"))).select(F.col("id").alias("u"), F.col("id2").alias("v")), "jaccard-links")
    discard(d, e, e2)
    return found


def classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' ids, and of each set (lo, hi) n_shingles, component_id and the component's best row (nulls last)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = materialize(index_sets(docs, n), "jaccard-index")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    sets = materialize(index.filter("n_shingles > 0").groupBy("lo", "hi").agg(best, F.max("n_shingles").alias("n_shingles"), F.count("*").alias("rows")), "jaccard-sets")
    kept = kept_signatures(docs, n, num, den)
    ids = kept.select("lo", "hi").distinct().join(sets, ["lo", "hi"])
    nodes = materialize(ids.select("lo", "hi", "best.doc_id", "best.text_key", F.monotonically_increasing_id().alias("id")), "jaccard-nodes")
    rows = pivots(kept, nodes)
    inside = nodes.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("d_"), F.col("text_key").alias("k_")).hint("merge")
    texts = docs.withColumn("key_", F.xxhash64("text")).join(inside, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key_") == F.col("k_"))).select("id", "text").dropDuplicates(["id"])
    texts = materialize(texts, "jaccard-texts")
    discard(kept)
    tested = materialize(verify(rows.filter("id <> pivot").select("pivot", "id").distinct(), texts, n, num, den), "jaccard-tested")
    discard(texts)
    direct = tested.filter("linked").select(F.col("pivot").alias("u"), F.col("id").alias("v"))
    cc = materialize(connected_components(direct), "jaccard-components")
    more = links_apart(rows, tested, cc, num, den)
    if more.take(1):
        names = [F.coalesce(f"{x}_", x).alias(x) for x in ("u", "v")]
        ends = more.join(cc.select(F.col("id").alias("u"), F.col("component").alias("u_")), "u", "left").join(cc.select(F.col("id").alias("v"), F.col("component").alias("v_")), "v", "left")
        up = materialize(connected_components(ends.select(*names)), "jaccard-joined")
        again = up.select(F.col("id").alias("component"), F.col("component").alias("up"))
        cc2 = cc.join(again, "component", "left").select("id", F.coalesce("up", "component").alias("component")).unionByName(up.join(cc, "id", "left_anti"))
        cc = materialize(cc2, "jaccard-all")
    linked = materialize(cc.join(nodes.select("id", "lo", "hi"), "id").select("component", "lo", "hi").join(sets, ["lo", "hi"]), "jaccard-linked")
    tops = linked.groupBy("component").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    alone = sets.join(linked.select("lo", "hi"), ["lo", "hi"], "left_anti")
    cols = ("lo", "hi", "n_shingles", "best", "rows")
    together = linked.select("component", "lo", "hi", "n_shingles").join(tops, "component")
    out = materialize(alone.select(*cols).unionByName(together.select(*cols)), "jaccard-classes")
    discard(sets, nodes, rows, tested, cc, linked)
    return index, out


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    index, found = classes(docs, n, num, den)
    some = index.filter("n_shingles > 0").select("doc_id", "n_shingles", "lo", "hi").join(found.select("lo", "hi", F.col("best.doc_id").alias("component_id")), ["lo", "hi"])
    return some.select("doc_id", "n_shingles", "component_id").unionByName(index.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, of the smallest doc_id (null ids last), and all rows without shingles.

    Rows are known by doc_id and text, so null and repeated ids obey the decision too, and of equal rows one stays."""
    index, found = classes(docs, n, num, den)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    many = index.filter("n_shingles > 0").join(found.filter("rows > 1").select("lo", "hi", "best"), ["lo", "hi"])
    mark = "_"
    while any(c.lower().endswith(mark) for c in docs.columns):  # names that no column of docs has
        mark += "_"
    keys, lost, nth = [f"k{i}{mark}" for i in range(3)], f"lost{mark}", f"nth{mark}"
    known = lambda i, key: [F.coalesce(i, F.lit(0)), i.isNull(), key]
    lose = many.groupBy("doc_id", "text_key").agg(F.first(mine != F.col("best")).alias(lost))
    lose = lose.select(lost, *[c.alias(k) for c, k in zip(known(F.col("doc_id"), F.col("text_key")), keys, strict=True)]).hint("merge")
    out = docs.select("*", *[c.alias(k) for c, k in zip(known(docs.doc_id.cast("long"), F.xxhash64(docs.text)), keys, strict=True)])
    out = out.join(lose, keys, "left").filter(f"{lost} IS NULL OR NOT {lost}").withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return out.filter(f"{lost} IS NULL OR {nth} = 1").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
