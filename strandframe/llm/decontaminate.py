"""Operator 4: benchmark decontamination with a generalised suffix automaton of the normalised test items.

Null or empty texts have no words; an item with no words never occurs; an item whose id is null counts for hits and
is not listed; repeated rows are rows of their own; empty tables give no rows, or clean ones. An automaton takes about
600 bytes a word and is broadcast, so items are dealt into groups of a bounded number of words (an item that is longer
is a group of its own). With several groups each scans the documents in tasks of its own, so that a worker holds one
automaton; their hits, far fewer than the texts, are put together by document.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import ALNUM, chunks, mix, trimmed, words

WINDOW = 10
MAX_WORDS = 200_000  # words of items that one automaton may hold: 120 MB


class SuffixAutomaton:
    """Of several sequences of word hashes; `items` of a state are those that hold its strings."""

    def __init__(self, seqs: list[tuple], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.len, self.items, self.short = [-1], [0], [set()], [0]
        ends = []
        for item, seq in seqs:
            last, path = 0, []
            for w in seq:
                last = self._extend(last, int(w))
                path.append(last)
            ends.append((item, path, len(seq)))
        for item, path, _ in ends:
            for s in path:
                while s > 0 and item not in self.items[s]:
                    self.items[s].add(item)
                    s = self.link[s]
        # items shorter than a window are found whole: their state, and for each state the nearest such suffix
        self.whole: dict[int, set] = {}
        for item, path, n in ends:
            if 0 < n < window:
                s = path[-1]
                while self.len[self.link[s]] >= n:
                    s = self.link[s]
                self.whole.setdefault(s, set()).add((n, item))

    def _new(self, n: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(n)
        self.items.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        if self.len[p] + 1 == self.len[q]:
            return q
        c = self._new(self.len[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, q, w)
        cur, p = self._new(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        self.link[cur] = 0 if p < 0 else self._split(p, self.next[p][w], w)
        return cur

    def scan(self, seq, found: set, mark) -> None:
        """Stream words; mark(i, n) for each occurring window of n words that ends at i; adds its items to found."""
        s = n = 0
        nxt, link, lens, k = self.next, self.link, self.len, self.window
        for i, w in enumerate(seq):
            while s and w not in nxt[s]:
                s = link[s]
                n = lens[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            if not n:
                continue
            if n >= k:
                t = s
                while lens[link[t]] >= k:
                    t = link[t]
                mark(i, k)
                found |= self.items[t]
            if self.whole:
                t = s
                while t > 0:
                    for m, item in self.whole.get(t, ()):
                        if m <= n:
                            mark(i, m)
                            found.add(item)
                    t = link[t]


class Matcher:
    """The automaton behind exact filters on single words and on pairs of words: a window needs all of its pairs."""

    BITS = 20

    def __init__(self, items: list[tuple]):
        seqs = []
        for item, text in items:
            b = np.frombuffer((text or "").encode(), np.uint8)
            seqs.append((item, words(b, np.array([0, len(b)]), ALNUM)[2]))
        seqs = [x for x in seqs if len(x[1])]
        self.sam = SuffixAutomaton([(i, s.tolist()) for i, s in seqs])
        self.least = min([WINDOW, *(len(s) for _, s in seqs)])
        self.any = bool(seqs)
        self.one, self.two = np.zeros(1 << self.BITS, bool), np.zeros(1 << self.BITS, bool)
        for _, s in seqs:
            self.one[self.slot(s)] = True
            self.two[self.slot(self.pairs(s))] = True

    def slot(self, h):
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    @staticmethod
    def pairs(h):
        with np.errstate(over="ignore"):
            return mix(h[:-1] * np.uint64(0xD1342543DE82EF95) + h[1:])

    def batch(self, h: np.ndarray, first: np.ndarray):
        """Per row with hits: (row, boolean array over its words, items)."""
        if not self.any or not len(h):
            return
        if self.least == 1:
            runs = [(first[r], first[r + 1]) for r in range(len(first) - 1)]
        else:
            ok = self.two[self.slot(self.pairs(h))] & self.one[self.slot(h[:-1])]
            ok[(b := first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))]) - 1] = False
            edge = np.diff(np.r_[False, ok, False].astype(np.int8))
            a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            keep = z - a >= self.least - 1
            runs = list(zip(a[keep], z[keep] + 1, strict=True))
        rows: dict[int, tuple] = {}
        for a, z in runs:
            if z - a < self.least:
                continue
            found: set = set()
            hit = np.zeros(z - a, bool)

            def mark(i, n, hit=hit):
                hit[i - n + 1 : i + 1] = True

            self.sam.scan(h[a:z].tolist(), found, mark)
            if found:
                r = int(np.searchsorted(first, a, "right")) - 1
                got = rows.setdefault(r, (np.zeros(first[r + 1] - first[r], bool), set()))
                got[0][a - first[r] : z - first[r]] |= hit
                got[1].update(found)
        yield from ((r, *x) for r, x in rows.items())


def matchers(benchmark: DataFrame, most: int = MAX_WORDS) -> list:
    """Broadcast matchers over groups of items whose texts stay under `most` words (of two bytes at the least); the driver holds one group at a time."""
    spark, out, group, size = benchmark.sparkSession, [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        group.append((r[0], r[1]))
        size += len(r[1] or "") // 2 + 1
        if size >= most:
            out.append(spark.sparkContext.broadcast(Matcher(group)))
            group, size = [], 0
    return [*out, spark.sparkContext.broadcast(Matcher(group))] if group or not out else out


def scan(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (start, end byte offsets of hit runs in the text)."""
    docs, rows = _found(docs.select(F.col("doc_id").cast("long"), "text"), matchers(benchmark, most))

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            for i, k, data, off in chunks(b.column(1)):
                _, _, h, first = words(data, off, ALNUM)
                hits = rows(b, i, k, h, first)
                n_hit, n_items, sha = np.zeros(k, np.int64), np.zeros(k, np.int64), [none] * k
                for r, (hit, items) in hits.items():
                    ids = sorted(str(x) for x in items if x is not None)
                    n_hit[r], n_items[r], sha[r] = hit.sum(), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(n_hit > 0)], schema=schema)

    return docs.mapInArrow(trimmed(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _rows(found, h, first) -> dict:
    hits: dict = {}
    for m in found:
        for r, hit, items in m.value.batch(h, first):
            got = hits.setdefault(r, (np.zeros(len(hit), bool), set()))
            got[0][:] |= hit
            got[1].update(items)
    return hits


def _found(docs: DataFrame, found: list):
    """docs and rows(batch, first row, rows, h, first), which gives the hits of rows; of several matchers by a last column of docs."""
    if len(found) == 1:
        return docs, lambda b, i, k, h, first: _rows(found, h, first)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text")]
    texts = docs.select(key[0].alias("d"), key[1].alias("k"), "text")
    one = [texts.mapInArrow(trimmed(_hits(m)), "d string, k long, hit binary, items array<string>") for m in found]
    every = one[0]
    for x in one[1:]:
        every = every.unionByName(x)
    name = "hits"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    every = every.groupBy("d", "k").agg(F.collect_set(F.struct("hit", "items")).alias(name))  # one at most of each group of items
    names = [x + name for x in ("d", "k")]
    out = docs.select("*", key[0].alias(names[0]), key[1].alias(names[1])).join(every.withColumnsRenamed({"d": names[0], "k": names[1]}), names, "left")

    def rows(b, i, k, h, first):
        hits = {}
        for r, got in enumerate(b.column(b.num_columns - 1).slice(i, k).to_pylist()):
            n = int(first[r + 1] - first[r])
            for x in got or ():
                own = hits.setdefault(r, (np.zeros(n, bool), set()))
                own[0][:] |= np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=n).astype(bool)
                own[1].update(x["items"])
        return hits

    return out.select(*docs.columns, name), rows


def _hits(m):
    def run(batches):
        for b in batches:
            for i, k, data, off in chunks(b.column(2)):
                _, _, h, first = words(data, off, ALNUM)
                got = _rows([m], h, first)
                at = pa.array([i + r for r in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([np.packbits(hit).tobytes() for hit, _ in got.values()], pa.binary()), pa.array([[x if x is None else str(x) for x in items] for _, items in got.values()], pa.list_(pa.string()))], names=["d", "k", "hit", "items"])

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, most: int = MAX_WORDS) -> DataFrame:
    """docs without the hit words; a document with more than max_coverage of its words hit goes. Clean texts stay as they are."""
    cols, schema = docs.columns, docs.schema
    docs, rows = _found(docs, matchers(benchmark, most))
    at = cols.index("text")
    n_at = cols.index("n_chars") if "n_chars" in cols else None

    def run(batches):
        for b in batches:
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            changed = {}
            for i, k, data, off in chunks(b.column(at)):
                starts, ends, h, first = words(data, off, ALNUM)
                for r, (hit, _) in rows(b, i, k, h, first).items():
                    if hit.mean() > max_coverage:
                        keep[i + r] = False
                        continue
                    raw, parts, last = texts[i + r].encode(), [], 0
                    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
                    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        parts.append(raw[last : starts[first[r] + a] - off[r]])
                        last = int(ends[first[r] + z - 1] - off[r])
                    changed[i + r] = b"".join([*parts, raw[last:]]).decode()
            arrays = [b.column(c) for c in range(len(cols))]
            if changed:
                for r, t in changed.items():
                    texts[r] = t
                arrays[at] = pa.array(texts, b.schema.field(at).type)
                if n_at is not None:
                    ns = b.column(n_at).to_pylist()
                    for r, t in changed.items():
                        ns[r] = len(t)
                    arrays[n_at] = pa.array(ns, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([b.schema.field(c) for c in range(len(cols))])).filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents), b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
