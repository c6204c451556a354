"""Template labels against a plain reading: every start, in order, by weight."""
import random

from strandframe.llm import licenses


def label(text):
    index, h = licenses.Index(), licenses.words(*_bytes(text), licenses.ALNUM)[2]
    return index.labels(h, licenses.np.flatnonzero(index.rare_words(h)))[0]


def test_order_and_gaps(spark):
    scrambled = "license the under 2 version apache licensed 0 apache license"
    notice = licenses.TEMPLATES["bsd"][1][0].split()
    gaps = " ".join(w for k, w in enumerate(notice) if k % 9 != 5)
    assert all(label(" ".join(w for k, w in enumerate(notice) if k % 9 != m)) == {"bsd"} for m in (0, 5, 7, 8))
    rnd = random.Random(3)
    mixed = list(notice)
    rnd.shuffle(mixed)
    rows = [(1, scrambled), (2, f"x {gaps} y"), (3, " ".join(mixed)), (4, None), (5, ""), (6, "x " * 50000 + " ".join(notice)), (6, "again")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.labels, r.score))
    assert [x for x, _ in got[1]] == [""] and [x for x, _ in got[2]] == ["bsd"] and [x for x, _ in got[3]] == [""]
    assert got[4] == got[5] == [("", 0.0)] and sorted(x for x, _ in got[6]) == ["", "bsd"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts(spark):
    rows = [(1, "Apache apache the"), (2, "the"), (3, None), (4, "nothing")]
    assert licenses.text_counts(spark.createDataFrame(rows, "doc_id long, text string"), ["the", "apache", "mit"]) == ({"the": 2, "apache": 1, "mit": 0}, 4)


def test_templates_by_brute_force():
    index = licenses.Index()
    for label, ts in licenses.TEMPLATES.items():
        for t, _ in ts:
            for lead in (0, 7, 40):
                h = licenses.words(*_bytes("pad " * lead + t + " pad" * 5), licenses.ALNUM)[2]
                got, score = index.labels(h, licenses.np.flatnonzero(index.rare_words(h)))
                assert label in got and score == 1.0


def _bytes(text):
    b = licenses.np.frombuffer(text.encode(), licenses.np.uint8)
    return b, licenses.np.array([0, len(b)])
