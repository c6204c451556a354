"""A cloud of near copies, linked and not, against brute force: links that no pivot shows must be found."""
import random

from strandframe.llm import jaccard_join


def test_cloud(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows, shared = [], [f"p{k}" for k in range(90)]
    for i in range(90):
        w = list(base)
        for at in sorted(rnd.sample(range(0, 150, 5), rnd.choice([1, 1, 2, 3, 4, 6])), reverse=True):
            del w[at]
        rows.append((i, " ".join(w), "x"))
        if i % 9 == 0:  # a copy that differs in one more word, linked with its twin but seldom with the rest
            rows.append((200 + i, " ".join([*w[:-2], "new"]), "x"))
    rows += [(500 + i, " ".join(shared + [f"q{i}x{k}" for k in range(30)]), "x") for i in range(40)]  # a passage of many, none linked
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t, _ in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string, component string")
    for num in (90, 80):
        comp = {i: i for i in sets}

        def top(i, comp=comp):
            while comp[i] != i:
                i = comp[i]
            return i

        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    comp[y] = x
        want = {i: (len(s), top(i)) for i, s in sets.items()}
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d, 3, num, 100).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) > 40
    assert jaccard_join.keep_one(d, n=3, num=80).count() == len({c for _, c in want.values()})
