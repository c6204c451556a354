import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandframe.llm import quality_rules as q
from strandframe.llm._words import chunks

SCHEMA = "doc_id long, text string, lang string, source string, score string, words int"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def slow(text):
    """STATS by their words, one text at a time."""
    b = (text or "").encode()
    w = SPACE.findall(b)
    low = [x.lower() for x in w]
    lines = [x.lower() for x in b.split(b"\n") if x]
    count = lambda p: len(re.findall(p, b))
    share = lambda a, n: a / max(n, 1)
    upper = lambda x: len(re.findall(rb"[A-Z]", x))
    letters = lambda x: len(LETTER.findall(x))
    three, many = collections.Counter(zip(low, low[1:], low[2:])), collections.Counter(low)
    again = lambda c: sum(n for n in c.values() if n > 1)
    stop = b".,;:?\"')"
    n = len(w)
    return [
        len(b), n, len(lines), share(upper(b), letters(b)), share(count(rb"[0-9]"), len(b)), share(count(rb"[!-/:-@\[-`{-~]"), len(b)), share(count(rb"[\x80-\xff]"), len(b)), share(count(rb"[\x20\x09-\x0D]"), len(b)),
        share(sum(map(len, w)), n), max(map(len, w), default=0), share(sum(len(x) <= 3 for x in w), n), share(sum(upper(x[:1]) for x in w), n), share(sum(letters(x) > 1 and upper(x) == letters(x) for x in w), n), share(sum(letters(x) == 0 for x in w), n),
        share(sum(bool(re.fullmatch(rb"[!-/:-@\[-`{-~]", x[-1:])) and x[-1] not in stop for x in w), n), share(sum(x[-1] in stop for x in w), n), share(len(many), n), share(max(many.values(), default=0), n), share(again(three), n),
        share(sum(map(len, lines)), len(lines)), share(again(collections.Counter(lines)), len(lines)),
    ]


def texts(n, seed):
    rng = random.Random(seed)
    vocab = ["a", "The", "THE", "na\u00efve", "\u00dc", "12", "x1", "end.", "what?", "###", "a|", "(b)", "\U0001f600", "it's"]
    return [None, "", " \n\t ", "\n\n", "one", "a b a b a b", *("".join(rng.choice(vocab) + rng.choice((" ", " ", "\n", "  ")) for _ in range(rng.randrange(60))) for _ in range(n))]


def test_statistics_by_brute_force():
    t = texts(200, 1)
    got = np.concatenate([q.statistics(data, off) for _, _, data, off in chunks(pa.array(t), 500)])
    assert got.shape == (len(t), len(q.STATS))
    np.testing.assert_allclose(got, [slow(x) for x in t], rtol=1e-12)


def table(rng, n):
    x = np.stack([rng.uniform(0, 1, n) for _ in q.STATS], axis=1)
    y = ((x[:, 3] < 0.4) & (x[:, 16] > 0.3)) | (x[:, 9] > 0.9)
    return x, (y ^ (rng.uniform(0, 1, n) < 0.05)).astype(float), y


def test_rules_find_conjunctions_and_are_few():
    rng = np.random.default_rng(2)
    x, y, _ = table(rng, 4000)
    m = q.fit(x, y)
    x2, _, truth = table(rng, 4000)
    assert ((m(x2) >= 0.5) == truth).mean() > 0.97 and 0 < len(m.rules) < 80
    for r in q.grow(x, y, trees=3):
        assert 1 <= len(r.bounds) <= 3 and 20 <= r.holds(x).sum() < len(x)


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(3)
    v = rng.uniform(0, 1, (300, 12)) < rng.uniform(0.1, 0.9, 12)
    y = (rng.uniform(0, 1, 300) < np.where(v[:, 0] & ~v[:, 1], 0.9, 0.2)).astype(float)
    n = rng.integers(1, 5, 300)
    w, b = q.lasso(v, y, n, 0.01, steps=4000)
    e = n / n.sum() * (1 / (1 + np.exp(-(v @ w + b))) - y)
    g = v.T @ e
    assert abs(e.sum()) < 1e-6 and (np.abs(g[w == 0]) <= 0.01 + 1e-6).all()
    np.testing.assert_allclose(g[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-6)
    assert 0 < (w == 0).sum()


def test_compiled_column_gives_the_models_scores(spark):
    rng = np.random.default_rng(4)
    x, y, _ = table(rng, 600)
    m = q.fit(x, y)
    rows = spark.createDataFrame(x.tolist(), list(q.STATS)).withColumn("i", F.monotonically_increasing_id())
    got = rows.select("i", m.column().alias("s"), *q.STATS).orderBy("i").toPandas()
    np.testing.assert_allclose(got["s"], m(got[list(q.STATS)].to_numpy()), rtol=1e-12)


def corpus(n):
    rng, out = random.Random(5), []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 80))]
        out.append((i, " ".join(w) if i % 4 else " ".join(f"{x}###" for x in w), "en", "s", "x", 1))
    return out


def test_held_out_rows_are_never_learned_from_and_are_told_apart(spark):
    import zlib

    rows = corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    true = [(i, int(i % 4 > 0)) for i, *_ in rows]
    wrong = [(i, 1 - y if held[i] else y) for i, y in true]  # what is held out cannot do harm
    labels = [spark.createDataFrame(x + [(None, 1), (10**9, 0), (3, None)], "doc_id long, quality int") for x in (true, wrong)]
    a, b = (q.score(docs, q.train(docs, x)).orderBy("doc_id").collect() for x in labels)
    assert a == b and all(r.predicted == int(r.doc_id % 4 > 0) and r.held_out == held[r.doc_id] and 0 <= r.score <= 1 for r in a)
    few = q.train(docs, labels[0], max_rows=150)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in q.score(docs, few).collect())


def test_edges(spark):
    rows = [(None, "some text", None, None, None, 1), (1, None, "en", "s", "", 1), (1, "", "en", "s", "", 1), (2, "w " * 400_000, "en", "s", "", 1), (2, "w " * 400_000, "en", "s", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = q.train(docs, none)
    got = q.score(docs, m).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0} and {r.held_out for r in got if r.doc_id is None} == {False}
    one = q.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {r.predicted for r in q.score(docs, one).collect()} == {1}
    assert q.score(docs.limit(0), m).collect() == []
    d = spark.createDataFrame(corpus(200), SCHEMA)
    by_text = q.score(docs.union(d), q.train(d, spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int"))).collect()
    assert len({r.score for r in by_text if r.doc_id == 2 and r.score is not None}) <= 2 and all(0 <= r.score <= 1 for r in by_text)
