"""The pipeline, stage by stage, against brute force on a small corpus with odd rows and clashing columns."""
import collections
import random
import re

import corpus_pipeline

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus():
    rnd = random.Random(9)
    vocab = [f"word{k}" for k in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    item = text(30)
    rows = [(i, text(40 + i % 60)) for i in range(120)]
    rows += [(200 + i, f"{rows[i][1]} idiot moron you stupid scum") for i in range(40)]
    rows += [(300 + i, rows[50 + i][1]) for i in range(10)]  # exact copies
    rows += [(400 + i, rows[70 + i][1] + " one more") for i in range(10)]  # near copies
    rows += [(500, text(60) + " " + item), (501, item), (502, None), (503, ""), (None, rows[3][1]), (None, "alone " + text(30)), (504, text(20000))]
    docs = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "x", k) for k, (i, t) in enumerate(rows)]
    return docs, [(i, 0 if i < 200 else 1) for i, _ in rows if i is not None and i < 240], [(1, item), (2, None)]


def test_stages(spark, tmp_path):
    docs, labels, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, lost__ string, times_ long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, at, str(tmp_path))
        assert k == 4 or done.columns == at.columns
        done.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = at.collect()

    clean = [d for d in docs if "idiot" not in (d[1] or "")]
    assert sorted(map(str, map(tuple, out["toxicity"]))) == sorted(map(str, clean))

    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in (re.findall(r"[^\x20\x09-\x0D]+", (d[1] or "").lower()) for d in clean)]
    group = list(range(len(clean)))
    for a in range(len(clean)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    best = {}
    for k, d in enumerate(clean):
        key = (d[0] is None, d[0] or 0)
        if sets[k] and (group[k] not in best or key < best[group[k]][0]):
            best[group[k]] = (key, k)
    keep = {k for _, k in best.values()} | {k for k, s in enumerate(sets) if not s}
    left = [d for k, d in enumerate(clean) if k in keep]
    assert sorted(map(str, map(tuple, out["near_copies"]))) == sorted(map(str, left)) and len(left) < len(clean) - 15

    words = lambda t: W.findall((t or "").lower())
    items = {tuple(w[k : k + 10]) for _, t in bench for w in [words(t)] for k in range(len(w) - 9)}
    want = {}
    for d in left:
        w, hit = words(d[1]), set()
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in items:
                hit.update(range(k, k + 10))
        if len(hit) <= len(w) / 2:
            want[d[6]] = [x for k, x in enumerate(w) if k not in hit]
    got = {r.times_: words(r.text) for r in out["decontamination"]}
    assert got == want and 501 not in {r.doc_id for r in out["decontamination"]}

    times = collections.Counter(r.times_ for r in out["mixing"])
    assert max(times.values()) <= 3 and set(times) <= set(want)
    size = collections.Counter()
    for r in out["decontamination"]:
        size[r.source] += len((r.text or "").split())
    assert set(size) == {"s0", "s1", "s2", None}

    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = sorted((r.doc_id is not None, r.doc_id or 0, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in out["mixing"])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out["tokens"]) == n


def test_empty_and_all_null(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], [(None, None, None, None, None)] * 2)):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert corpus_pipeline.run(spark, d).count() == len(rows)
