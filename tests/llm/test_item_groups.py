"""Items in several groups of bounded size give what one automaton gives."""
from strandframe.llm import decontaminate


def test_groups(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (None, "w3 " + long[:80], "b"), (2, None, "c"), (2, "", "c"), (3, "nothing of it", None), (4, "short one here", "d"), (5, " ".join(f"w{k}" for k in range(5, 25)) + " and more words after it " * 4, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    items = [(7, " ".join(f"w{k}" for k in range(10, 30))), (None, "short one"), (8, " ".join(f"w{k}" for k in range(20, 45))), (9, "w3 w0"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same = lambda f: [sorted(map(tuple, f(docs, bench, **kw).collect()), key=str) for kw in ({}, {"most": 5})]
    a, b = same(decontaminate.scan)
    assert a == b and len(a) == len(rows) and sum(r[5] for r in a) == 5
    a, b = same(decontaminate.remove_spans)
    assert a == b and 0 < len(a) < len(rows)
    assert len(decontaminate.matchers(bench, 5)) > 2 and decontaminate.remove_spans(docs, bench, most=5).columns == docs.columns
