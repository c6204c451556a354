"""Pages and training rows at the edges: defined results, the same columns always."""
from strandframe.llm import language_id


def test_edges(spark):
    train = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune Fuchs und der Hund", "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame([*train, (None, None, "xx"), (None, "text", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model[0] == ["de", "en"]
    schema = "page_id long, url string, html string, host string"
    pages = [(1, "https://a.de/x", "<p>und der Hund</p>", "z"), (1, "https://a.de/x", "<p>und der Hund</p>", "z"), (None, None, None, None), (4, "", "", ""), (5, "https://b.com/", "<p>" + "and the dog " * 100000 + "</p>", "z")]
    got = [tuple(r) for r in language_id.identify(spark.createDataFrame(pages, schema), model).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert len(got) == 5 and by[1][0] == by[1][1] and by[5][0][3] == "en" and by[5][0][4] > 0.99 and by[None][0][3] is not None
    empty = language_id.identify(spark.createDataFrame([], schema), model)
    none = language_id.identify(spark.createDataFrame(pages, schema), language_id.train(docs.limit(0)))
    assert empty.count() == 0 and none.columns == empty.columns and none.filter("lang IS NOT NULL").count() == 0 and none.count() == 5


def test_training_counts_by_brute_force(spark):
    rows = [(1, "ab ab", "en"), (2, "abc", "en"), (3, "été", "fr")]
    langs, logp = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, lang in enumerate(langs):
        want = language_id.np.full(language_id.BUCKETS, 0.5)
        for _, t, x in rows:
            b = f" {t} ".encode()
            for j in range(len(b) - 2 if x == lang else 0):
                want[((b[j] * 65599 * 65599 + b[j + 1] * 65599 + b[j + 2]) * 2654435761 & 0xFFFFFFFF) >> 16] += 1
        assert abs(language_id.np.exp(logp[k]) - want / want.sum()).max() < 1e-12
