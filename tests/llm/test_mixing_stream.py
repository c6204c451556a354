"""The schedule itself: what the mix takes is what its golden-ratio points say, in their order."""
import collections

from strandframe.llm import mixing


def test_stream(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), None if i % 11 == 0 else f"s{i % 4}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times_ long")
    pieces, _ = mixing.stream(docs, block=16)
    got = sorted(map(tuple, pieces.select("slot", "at", "source", "rank", "doc_id", "start", "words").collect()))
    share = {r.source: r.target for r in mixing.mix(docs, block=16).select("source", "target").distinct().collect()}
    total, lo, span = sum(t / 16 for t in share.values()), 0.0, {}
    for s in sorted(share, key=lambda s: (s is None, s)):
        span[s] = (lo, lo + share[s] / 16 / total)
        lo = span[s][1]
    by_slot = {}
    for slot, _, s, rank, *_ in got:
        by_slot.setdefault(slot, (s, rank))
    counts = collections.Counter()
    for slot in range(-int(-total // 1)):
        u = (slot + 1) * mixing.GOLDEN % 1
        s = next(s for s, (a, z) in span.items() if a <= u < z)
        assert by_slot.get(slot, (s, counts[s])) == (s, counts[s])
        counts[s] += 1
        assert all(abs(counts[x] - (slot + 1) * (z - a)) < 4 for x, (a, z) in span.items())  # every prefix of the stream is mixed
    taken = collections.Counter()
    for _, _, _, _, d, start, words in got:
        assert 0 <= start and start + words <= 5 + d % 40
        taken[d] += words
    assert taken == collections.Counter({r.doc_id: r.taken for r in mixing.mix(docs, block=16).collect() if r.taken})
    sizes = {d: 5 + d % 40 for d in range(400)}
    assert all(taken[d] <= 3 * sizes[d] for d in taken)
    out = mixing.repeat_taken(docs)
    assert out.columns == docs.columns and out.filter("times_ <> doc_id").count() == 0

    monkeypatch.setattr(mixing, "GOLDEN", 0.0)  # without the points the result is another
    one = mixing.mix(docs, block=16).filter("taken > 0").select("source").distinct().count()
    assert one == 1


def test_stream_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.repeat_taken(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (None, "a b", None), (2, "a b", "s"), (2, "a b", "s"), (3, "", "s")]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r.size for r in got)


def test_tiny_source_leaves_the_others(spark):
    schema = "doc_id long, text string, source string, size int, rank int, slots int, block int"
    rows = [(i, " ".join(["w"] * 877), f"s{i % 3}", 1, 1, 1, 1) for i in range(400)]
    tiny = (1000, "one two three", "t", 1, 1, 1, 1)
    without, with_ = (spark.createDataFrame(r, schema) for r in (rows, rows + [tiny]))
    (a, placed_a), (b, placed_b) = mixing.stream(without), mixing.stream(with_)
    assert placed_b.filter("source = 't'").select("block", "target").first() == (1, 9.0)
    size = {r.source: r.block for r in placed_b.select("source", "block").distinct().collect()}
    alone = {r.source: r.block for r in placed_a.select("source", "block").distinct().collect()}
    assert all(abs(size[s] - n) <= 1 for s, n in alone.items())  # three words more to share may move a target's 200th part by one
    slots = [x.select("slot").distinct().count() for x in (a, b)]
    assert abs(slots[1] - slots[0]) <= 9 + 4 and b.count() <= a.count() + 40
    taken = {r.source: (r.taken, r.target) for r in mixing.mix(with_).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "taken", "target").collect()}
    assert all(abs(got - want) <= 3 * size[s] for s, (got, want) in taken.items())


def test_null_ids_spread(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    placed, _ = mixing.place(docs, 17)
    assert placed.select("bucket").distinct().count() > 40
