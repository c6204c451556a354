"""Operator 11: quality by a sparse rule ensemble.

Tasks take statistics of every whole text (STATS). Boosted trees of depth `depth` are grown on the statistics of at most
`max_rows` labelled training rows; each path from a root to any node is a rule, a conjunction of bounds on statistics.
A logistic regression with an L1 penalty weighs the rules, most get 0; the penalty is the largest whose loss on a fifth
of the rows lies within a standard error of the best. What is left is compiled into one Spark column over the statistics.

Null and empty texts have all statistics 0 and get the score of that. Null doc_id: not held out, not trained on. Rows that
repeat are scored alike; a doc_id with several labels takes the highest; labels without document or quality are ignored.
Without training rows of both kinds the score is the share of good ones (0.5 without any). Ties of splits go to the
first statistic and threshold. Empty table: no rows. Other columns are not looked at.
"""
import dataclasses
import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import NONSPACE, chunks, mix, trimmed, words

MAX_ROWS = 40_000
LIMIT = 0.7
STATS = (
    "bytes", "words", "lines", "upper", "digits", "symbols", "foreign", "blank", "word_bytes", "longest", "short", "capital", "shouted", "no_letter",
    "odd_end", "stopped", "distinct", "most", "repeated3", "line_bytes", "repeated_lines",
)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_STOP = np.isin(np.arange(256), list(b".,;:?\"')"))
_BREAK = np.ones(256, bool)
_BREAK[10] = False


def held():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _copies(row: np.ndarray, h: np.ndarray, rows: int):
    """Per row: distinct hashes, the count of the most frequent one, and how many occur again."""
    if not len(h):
        return (np.zeros(rows),) * 3
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])]))
    n = np.diff(np.append(edge, len(x)))
    most = np.zeros(rows)
    np.maximum.at(most, r[edge], n)
    return np.bincount(r[edge], minlength=rows), most, np.bincount(r[edge], np.where(n > 1, n, 0), rows)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """STATS of each of the texts whose bytes lie end to end: counts, then shares of bytes, words or lines."""
    rows = len(off) - 1
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
    size = np.diff(off).astype(float)
    starts, ends, h, first = words(data, off, NONSPACE)
    n = np.diff(first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(first))
    per = lambda x: np.bincount(row, x, rows)
    share = lambda a, b: a / np.maximum(b, 1)
    upper, letter = (data >= 65) & (data <= 90), _LETTER[data]
    length = (ends - starts).astype(float)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    word_upper, word_letter = (c[ends] - c[starts] for c in (upto(upper), upto(letter)))
    last, longest = data[ends - 1] if len(ends) else np.zeros(0, np.uint8), np.zeros(rows)
    np.maximum.at(longest, row, length)
    distinct, most, _ = _copies(row, h, rows)
    same = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        h3 = mix(h[:-2] + np.uint64(3) * mix(h[1:-1]) + np.uint64(5) * mix(h[2:] + np.uint64(7)))[same] if len(row) > 2 else h[:0]
    _, _, again = _copies(row[:-2][same] if len(row) > 2 else row[:0], h3, rows)
    ls, le, lh, lf = words(data, off, _BREAK)  # lines with something in them
    lrow, lines = np.repeat(np.arange(rows), np.diff(lf)), np.diff(lf).astype(float)
    _, _, line_again = _copies(lrow, lh, rows)
    out = (
        size, n, lines, share(sums(upper), sums(letter)), share(sums((data >= 48) & (data <= 57)), size), share(sums(_SYMBOL[data]), size), share(sums(data > 127), size), share(sums(~NONSPACE[data]), size),
        share(per(length), n), longest, share(per(length <= 3), n), share(per(upper[starts]) if len(starts) else n, n), share(per((word_upper == word_letter) & (word_letter > 1)), n), share(per(word_letter == 0), n),
        share(per(_SYMBOL[last] & ~_STOP[last]), n), share(per(_STOP[last]), n), share(distinct, n), share(most, n), share(again, n), share(np.bincount(lrow, le - ls, rows), lines), share(line_again, lines),
    )
    return np.stack(out, axis=1).astype(float)


def with_statistics(docs: DataFrame, keep: str) -> DataFrame:
    """docs' columns `keep` (a schema that leaves text out) and STATS of text."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        for b in batches:
            for i, k, data, off in chunks(b.column(len(names))):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, k) for j in range(len(names))), *(pa.array(x[:, j]) for j in range(len(STATS)))], names=[*names, *STATS])

    return docs.select(*names, "text").mapInArrow(trimmed(run), ", ".join([keep, *(f"{s} double" for s in STATS)]))


@dataclasses.dataclass(frozen=True)
class Rule:
    """Bounds on statistics that hold together: (statistic, over, at most), with infinities where there is none."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return functools.reduce(operator.and_, ((x[:, j] > a) & (x[:, j] <= b) for j, a, b in self.bounds))

    def column(self) -> Column:
        parts = [F.col(STATS[j]) > a for j, a, _ in self.bounds if np.isfinite(a)] + [F.col(STATS[j]) <= b for j, _, b in self.bounds if np.isfinite(b)]
        return functools.reduce(operator.and_, parts)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 32, least: int = 20, rate: float = 0.3) -> list[Rule]:
    """Rules of boosted trees on labels y: each node's path, by order of making, each set of bounds once."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    flat, width = code + np.arange(x.shape[1]) * bins, x.shape[1] * bins
    z, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def split(rows, bounds, level):
        p = 1 / (1 + np.exp(-z[rows]))
        g, h = y[rows] - p, p * (1 - p) + 1e-6
        if level < depth and len(rows) >= 2 * least:
            at = flat[rows].ravel()
            hist = [np.bincount(at, None if w is None else np.repeat(w, x.shape[1]), width).reshape(-1, bins).cumsum(1) for w in (g, h, None)]
            left_g, left_h, left_n = hist
            gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = 0
            j, c = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, c] > 1e-3:
                cut = float(cuts[j][c])
                lo, hi = bounds.get(int(j), (-np.inf, np.inf))
                to_left = x[rows, j] <= cut
                for some, span in ((rows[to_left], (lo, cut)), (rows[~to_left], (cut, hi))):
                    b = bounds | {int(j): span}
                    found.setdefault(Rule(tuple((k, *b[k]) for k in sorted(b))), None)
                    split(some, b, level + 1)
                return
        step[rows] = g.sum() / (h.sum() + 1)

    for _ in range(trees):
        step = np.zeros(len(y))
        split(np.arange(len(y)), {}, 0)
        z = z + rate * step
    return list(found)


def lasso(v: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float, start=None, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty on rows v met n times, a share y of them good; accelerated proximal steps."""
    v1 = np.column_stack([v, np.ones(len(v))]).astype(float)
    n = n / n.sum()
    w = np.zeros(v1.shape[1]) if start is None else np.append(*start)
    size = 4 / np.linalg.eigvalsh((v1 * n[:, None]).T @ v1)[-1]
    off = np.append(np.full(v.shape[1], penalty * size), 0)
    at, t = w, 1.0
    for _ in range(steps):
        step = at + size * (v1.T @ (n * (y - 1 / (1 + np.exp(-np.clip(v1 @ at, -30, 30))))))
        new = np.sign(step) * np.maximum(np.abs(step) - off, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


@dataclasses.dataclass
class Model:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The score as a column over STATS."""
        z = sum((F.when(r.column(), float(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-z))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, penalties=(3e-2, 1e-2, 3e-3, 1e-3, 3e-4)) -> Model:
    """The rule ensemble on statistics x and labels y; a row's place decides whether it judges the penalties, every fifth does."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    judge = np.arange(len(y)) % 5 == 4

    def patterns(rules, some):
        bits = np.packbits(np.stack([r.holds(x[some]) for r in rules], axis=1), axis=1)
        one, back, n = np.unique(bits, axis=0, return_inverse=True, return_counts=True)
        return np.unpackbits(one, axis=1, count=len(rules)).astype(bool), np.bincount(back.ravel(), y[some]) / n, n

    best, start = [], None
    train_y = y[~judge]
    if judge.any() and train_y.min() < train_y.max() and (rules := grow(x[~judge], train_y)):
        v, rate, n = patterns(rules, ~judge)
        test = np.stack([r.holds(x[judge]) for r in rules], axis=1)
        for p in penalties:
            start = lasso(v, rate, n, p, start)
            loss = _loss(test @ start[0] + start[1], y[judge])
            best.append((loss.mean(), loss.std() / np.sqrt(len(loss)), p))
    low = min(best, default=(0, 0, penalties[2]))
    penalty = max((p for m, _, p in best if m <= low[0] + low[1]), default=low[2])
    rules = grow(x, y)
    if not rules:
        return fit(x, np.full(len(y), y.mean()))
    v, rate, n = patterns(rules, slice(None))
    w, b = lasso(v, rate, n, penalty, steps=1000)
    on = np.flatnonzero(np.abs(w) > 1e-9)
    return Model([rules[i] for i in on], w[on], b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fitted on max_rows labelled rows at most, chosen by a hash of their ids; only their statistics reach the driver."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    known = known.orderBy("h", "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = with_statistics(rows, "doc_id long, h long, quality int").drop("text").toPandas().drop_duplicates("doc_id").sort_values(["h", "doc_id"])
    return fit(got[list(STATS)].to_numpy(float), got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    d = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held().alias("held_out"), "text"), "doc_id long, held_out boolean")
    return d.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
