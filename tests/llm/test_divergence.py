import random
import re
from collections import Counter, defaultdict

from strandframe.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n int, rank string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        w = WORD.findall((text or "").translate(LOW))
        docs[lang].update(set(w))
        count[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        ps, all_ = {s: p(count[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(b, sum(f(ps[s][t], ps[b][t]) for t in kept)) for b in sources if b != s]
            term = [(t, f(ps[s][t], all_[t])) for t in kept if count[lang, s][t] and ps[s][t] > all_[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["a", "The", "\u00dcber", "\u00fcber", "x\u0301", "\ufffd", "\U0001f600", "na\u00efve"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    out = []
    for i in range(n):
        w = [vocab[min(int(rng.paretovariate(0.7)) - 1, len(vocab) - 1)] for _ in range(rng.randrange(40))]
        out.append((i, rng.choice((None, "", "12 !", *[rng.choice(" \n7-_").join(w)] * 7)), rng.choice(("en", "de", None, "")), rng.choice(("s", "s", "s", "t\u00e9", "T", None, "z")), 1, "r"))
    return out + out[:5]


def test_against_brute_force(spark):
    for seed, n in ((1, 120), (2, 9)):
        rows = corpus(n, seed)
        d = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert sorted(map(tuple, dv.audit(d).collect())) == brute(rows)
        assert sorted(map(tuple, dv.audit(d, least=1, top=2).collect())) == brute(rows, 1, 2)


def test_tasks_hand_on_what_they_cannot_hold(spark):
    rows = corpus(80, 3)
    counts = dv.term_counts(spark.createDataFrame(rows, SCHEMA), held=5).collect()
    want = defaultdict(lambda: [0, 0])
    for _, text, lang, source, *_ in rows:
        for t, n in Counter(WORD.findall((text or "").translate(LOW))).items():
            w = want[lang or "", source or "", t]
            w[0], w[1] = w[0] + n, w[1] + 1
    got = defaultdict(lambda: [0, 0])
    for r in counts:
        if r.term is not None:
            g = got[r.lang, r.source, r.term]
            g[0], g[1] = g[0] + r.n, g[1] + r.docs
    assert got == want


def test_edges(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = [(i, "one two one", "en", "s", 1, "") for i in range(3)]
    assert sorted(map(tuple, dv.audit(spark.createDataFrame(alone, SCHEMA)).collect())) == brute(alone)
    nothing = [(1, None, None, "a", 1, ""), (2, "", "", None, 1, ""), (3, "77", "", "b", 1, "")]
    got = sorted(map(tuple, dv.audit(spark.createDataFrame(nothing, SCHEMA)).collect()))
    assert got == brute(nothing) and all(r[4] == 0 for r in got) and len(got) == 6
    long_text = [(1, "ab cd " * 500_000, "en", "s", 1, ""), (2, "ab", "en", "t", 1, ""), (3, "ab cd", "en", "t", 1, ""), (4, "cd", "en", "t", 1, "")]
    assert sorted(map(tuple, dv.audit(spark.createDataFrame(long_text, SCHEMA)).collect())) == brute(long_text)


def test_p_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, t = 40_000_000_000, 123_456_789_012
    r = spark.range(1).select(dv._p(F.lit(n), F.lit(t)).alias("p")).first()
    assert r.p == 1 + 10**9 * (n + 1) // t
