"""Operator 5: toxicity by weak supervision.

Voters are insults of a seed lexicon, a lexicon of words and word beginnings mined from labelled training rows, and
style patterns; a voter fires or abstains. A generative label model (expectation maximisation; the given label is one
more voter of unknown accuracy) estimates how often each fires on toxic and on other texts, and the correlations of
voters within either class: one that fires with others is weighted by its share. A linear classifier is trained on the posterior labels; it sees the
voters and further words and beginnings that go with the posterior, so texts on which no voter fires are told apart
too. The given labels then only calibrate its scores. All is fitted on at most `max_rows` labelled rows, never a
held-out one; only voters and distinct vote patterns reach the driver. Scoring reads every whole text.

Null or empty texts get the prior; a null doc_id is not held out; labels of unknown documents are ignored; repeated
rows are scored alike; without training rows the seed lexicon alone decides; an empty table gives no rows.
"""
import collections
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, materialize, table
from ._words import ALNUM, LOWER, chunks, trimmed, word_hash, words

SEED = "idiot idiots stupid moron morons loser losers scum trash clown pathetic worthless disgusting dumb imbecile fool hate filthy vermin bastard".split()
MAX_ROWS = 40_000
LIMIT = 0.7
STEMS = (4, 5, 6)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@functools.lru_cache(100_000)
def word_keys(w: str) -> tuple:
    """A word and its beginnings of up to 8 bytes."""
    return w, *(f"{w[:k]}*" for k in STEMS if len(w) > k and len(w[:k].encode()) <= 8)


def keys(text: str) -> set:
    return set(itertools.chain.from_iterable(map(word_keys, set(_WORD.findall((text or "").translate(_LOWER))))))


def patterns(text: str) -> list[bool]:
    t = text or ""
    return [t.count("!") * 20 > len(t) + 1, sum(map(str.isupper, t)) * 2 > len(t) + 1, "you " in t and "!" in t]


class Model:
    """Voters' words and stems, and the weights of a linear classifier on the votes."""

    def __init__(self, names: list[str], w: np.ndarray | None = None, b: float = -3.0):
        self.names, self.b = names, b
        self.w = np.r_[np.full(len(names), 4.0), 0, 0, 0] if w is None else w


class LabelModel:
    """Fitted on distinct vote rows v, each met n times, y of them with label 1: P(fires | class) of each voter, its own share of the evidence and the prior.

    The label is one more voter of unknown accuracy: from lexicon and pattern votes alone the two classes come out as languages."""

    def __init__(self, v: np.ndarray, n: np.ndarray, y: np.ndarray):
        v, y, n = np.r_[v, v], np.r_[np.ones(len(n)), np.zeros(len(n))], np.r_[y, n - y]
        v, y, n = v[n > 0], y[n > 0], n[n > 0] / n.sum()
        x, few = v.astype(np.float32), 1e-5
        post = 0.1 + 0.8 * y
        for step in range(15):
            q1, q0 = n * post, n * (1 - post)
            self.p1, self.p0 = (q1 @ x + few / 2) / (q1.sum() + few), (q0 @ x + few / 2) / (q0.sum() + few)
            l1, l0 = (q1 @ y + few) / (q1.sum() + 2 * few), (q0 @ y + few) / (q0.sum() + 2 * few)
            if step % 5 == 0:  # correlations given the class
                corr = np.maximum(*(self.correlation(x, w / w.sum()) for w in (q1, q0)))
                share = 1 / np.maximum(1, (corr * (corr > 0.5)).sum(0))
            self.w, self.b = share * np.log(self.p1 / self.p0), float(np.log(q1.sum() / q0.sum()))
            said = np.where(y > 0, np.log(l1 / l0), np.log((1 - l1) / (1 - l0)))
            post = self(v, said)
        self.said = float(np.log(l1 / l0)), float(np.log((1 - l1) / (1 - l0)))

    @staticmethod
    def correlation(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean = n @ x
        sd = np.sqrt(np.maximum(mean - mean * mean, 0)) + 1e-6
        return np.abs(((x * n[:, None].astype(np.float32)).T @ x - np.outer(mean, mean)) / np.outer(sd, sd))

    def __call__(self, v: np.ndarray, said: np.ndarray) -> np.ndarray:
        """The posterior of vote rows, with what their labels add."""
        return np.clip(_sigmoid(v @ self.w + self.b + said), 0.001, 0.999)

    def mean(self, v: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """The posterior of rows of which a share has label 1."""
        return rate * self(v, self.said[0]) + (1 - rate) * self(v, self.said[1])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(row, col, width: int, y: np.ndarray, n: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels y of rows met n times; (row, col) are the features that are on."""
    w, b, n = np.zeros(width), 0.0, n / n.sum()
    g2, gb2 = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        e = n * (_sigmoid(np.bincount(row, w[col], len(y)) + b) - y)
        g, gb = np.bincount(col, e[row], width) + 1e-5 * w, e.sum()
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w, b = w - 0.5 * g / np.sqrt(g2), b - 0.5 * gb / np.sqrt(gb2)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the scores z to the labels' rates y."""
    a, b, n = 1.0, 0.0, n / n.sum()
    for _ in range(300):
        e = n * (_sigmoid(a * z + b) - y)
        a, b = max(0.2, a - 0.5 * float(e @ z) / max(1.0, float(n @ (z * z)) / 4)), b - 0.5 * float(e.sum())
    return a, b


def key_counts(rows: DataFrame, judge=None, most: int = 300_000) -> DataFrame:
    """key, bad, good: toxic and other rows that hold each word or stem, by judge(texts, labels) or the labels. A task's counts are merged before they leave it."""

    def run(batches):
        bad, good = collections.Counter(), collections.Counter()

        def flush():
            names = list(bad.keys() | good.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in (bad, good))], names=["key", "bad", "good"])

        for b in batches:
            said = judge(b.column(0), b.column(1)) if judge else b.column(1).to_pylist()
            for t, y in zip(b.column(0), said, strict=True):
                (bad if y else good).update(keys(t.as_py()))
                if len(good) + len(bad) > most:
                    yield flush()
                    bad.clear()
                    good.clear()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(trimmed(run), "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def find_voters(rows: DataFrame, n1: float, n0: float, judge=None, voters: int = 400, lift: float = 12.0, least: int = 4) -> list[str]:
    """Seed words, and the `voters` strongest of the keys whose odds reach `lift` over all rows, n1 of them toxic and n0 not."""
    odds = ((F.col("bad") + 0.5) / n1) / ((F.col("good") + 0.5) / n0)
    found = key_counts(rows, judge).filter(F.col("bad") >= max(least, 0.002 * n1)).withColumn("odds", odds).filter(F.col("odds") >= lift)
    top = found.orderBy(F.desc(F.col("bad") * F.log("odds")), "key").select("key").limit(voters).collect()
    return sorted({*SEED, *(r[0] for r in top)})


class Voters:
    """Votes of whole text columns: one column a name, then the patterns."""

    def __init__(self, names: list[str]):
        whole = sorted((word_hash(k), i) for i, k in enumerate(names) if not k.endswith("*"))
        self.width = len(names) + 3
        self.hs, self.col = np.array([h for h, _ in whole], np.uint64), np.array([i for _, i in whole])
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.hs >> np.uint64(48)).astype(np.int64)] = True
        stems = [(k[:-1].encode(), i) for i, k in enumerate(names) if k.endswith("*")]
        self.tab = {n: _stem_table([(s, i) for s, i in stems if len(s) == n]) for n in sorted({len(s) for s, _ in stems})}

    def __call__(self, texts: pa.Array):
        """(first row, rows, votes) of runs of rows."""
        for i, k, data, off in chunks(texts):
            starts, ends, h, first = words(data, off, ALNUM)
            votes = np.zeros((k, self.width), bool)
            row = np.repeat(np.arange(k), np.diff(first))
            near = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hs, h[near]), len(self.hs) - 1)
            ok = self.hs[at] == h[near]
            votes[row[near[ok]], self.col[at[ok]]] = True
            low = np.r_[LOWER[data], np.zeros(16, np.uint8)]
            for n, (ks, cs) in self.tab.items():
                long = ends - starts > n
                pos = starts[long]
                x = np.zeros(len(pos), np.uint64)
                for j in range(n):
                    x = x << np.uint64(8) | low[pos + j].astype(np.uint64)
                at = np.minimum(np.searchsorted(ks, x), len(ks) - 1)
                ok = ks[at] == x
                votes[row[long][ok], cs[at[ok]]] = True
            for r, t in enumerate(texts.slice(i, k).to_pylist()):
                votes[r, -3:] = patterns(t)
            yield i, k, votes


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fitted on max_rows labelled rows at most, chosen by a hash of their ids: the only rows of labels that are broadcast."""
    known = labels.filter("toxic IS NOT NULL").filter(~held()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    share = min(1.0, 1.05 * max_rows / max(1, known.count()))
    known = known.filter(F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy("h", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")
    rows = materialize(rows.select("text", "toxic"), "toxicity-rows")
    n1, n0 = (int(x or 0) + 1 for x in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    names = find_voters(rows, n1, n0)
    got = _patterns(rows, names, max_rows)
    if not any(r.bad for r in got) or all(r.bad == r.n for r in got):
        discard(rows)
        return Model(names)
    seen, n = _unpack(got, len(names) + 3), np.array([r.n for r in got], float)
    label_model, vote = LabelModel(seen, n, np.array([r.bad for r in got], float)), docs.sparkSession.sparkContext.broadcast(Voters(names))

    def judge(texts, labels):  # the label model's verdicts
        y = labels.to_numpy(zero_copy_only=False)
        return np.concatenate([np.zeros(0), *(label_model.mean(v, y[i : i + k]) for i, k, v in vote.value(texts))]) >= 0.5

    n1 = 1 + float(n @ (label_model.mean(seen, np.array([r.bad for r in got]) / n) >= 0.5))
    feats = sorted({*names, *find_voters(rows, n1, n.sum() + 2 - n1, judge, voters=300, lift=8.0, least=16)})
    got = _patterns(rows, feats, max_rows)
    discard(rows)
    v, n = _unpack(got, len(feats) + 3), np.array([r.n for r in got], float)
    rate = np.array([r.bad for r in got]) / n
    at = np.r_[np.searchsorted(feats, names), np.arange(len(feats), len(feats) + 3)]
    row, col = np.nonzero(v)
    w, b = descend(row, col, v.shape[1], label_model.mean(v[:, at], rate), n)
    a, c = calibrate(np.bincount(row, w[col], len(n)) + b, rate, n)
    return Model(feats, a * w, a * b + c)


def _patterns(rows: DataFrame, names: list[str], most: int) -> list:
    """Distinct vote rows of the names, how often each was met and how often with the label 1."""
    vote = rows.sparkSession.sparkContext.broadcast(Voters(names))

    def run(batches):
        for b in batches:
            for i, k, v in vote.value(b.column(0)):
                packed = [x.tobytes() for x in np.packbits(v, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1).slice(i, k)], names=["votes", "toxic"])

    seen = rows.mapInArrow(trimmed(run), "votes binary, toxic int").groupBy("votes").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    return seen.orderBy(F.desc("n"), "votes").limit(most).collect()


def _unpack(got: list, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(r.votes for r in got), np.uint8).reshape(len(got), -1), axis=1, count=width).astype(bool)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((Voters(model.names), model.w, model.b))

    def run(batches):
        vote, w, bias = shared.value
        for b in batches:
            for i, k, votes in vote(b.column(1)):
                s = 1 / (1 + np.exp(-(votes @ w + bias)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), b.column(2).slice(i, k), pa.array(s)], names=["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text", held().alias("held_out")).select("doc_id", "text", "held_out").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def _stem_table(items):
    """Sorted stems of up to 8 bytes as numbers, and their columns."""
    items = sorted((int.from_bytes(s, "big"), i) for s, i in items)
    return np.array([x for x, _ in items], np.uint64), np.array([i for _, i in items])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; each row is judged by its own text, whatever its doc_id."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((Voters(model.names), model.w, model.b))
    at = docs.columns.index("text")

    def run(batches):
        vote, w, bias = shared.value
        for b in batches:
            for i, k, votes in vote(b.column(at)):
                s = 1 / (1 + np.exp(-(votes @ w + bias)))
                yield b.slice(i, k).filter(pa.array(s < LIMIT))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
