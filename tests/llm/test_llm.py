import collections
import hashlib
import html
import io
import re
import zlib

import numpy as np
import pytest

from strandframe.llm import chat, decontaminate, html_text, jaccard_join, language_id, licenses, mixing, ogg, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(40)] + ["Straße", "été", "　x", "n b"]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(6)]
    texts = [None, "", " ", "One", "one two", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "under the mit license " * 3, "a" * 3000, " ".join(rng.choice(vocab, 9000))]
    for b in base:
        for k in (0, 1, 2, 5):
            w = b.split(" ")
            for p in rng.integers(0, len(w), k):
                w[p] = "changed"
            texts += [" ".join(w)]
    texts.append(texts[-1])
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS), rows


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in token_store.token_output(spark, docs[0]).collect()}
    for i, text, *_ in docs[1]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for s in ("a  b\n\n c", "<|endoftext|>x", "it's 12 été　 "):
        assert enc(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_shard_checksums():
    f = io.BytesIO()
    w = token_store.ShardWriter(f, frame_bytes=40)
    for k in range(20):
        w.add(k, np.arange(k))
    w.close()
    r = token_store.ShardReader(f)
    assert [r.ids(k).tolist() for k in (19, 0, 7)] == [list(range(19)), [], list(range(7))] and len(r.table) > 3
    r.table = r.table.copy()
    r.table[0, 2] ^= 1
    r.kept = (None, b"")
    with pytest.raises(ValueError):
        r.frame(0)


def test_chat(spark):
    odd = "␛1 <|turn|> ␛0</s>[INST] <<SYS>>\n"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (2, 0, "assistant", "x"), (3, 0, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_chats(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"system\n{odd}\nuser\n\nassistant\n{odd}\n") and got[1].loss_sha256 == sha(odd) and got[1].valid
    assert not got[2].valid and got[2].loss_chars == 1 and got[3].n_turns == 1 and not got[3].valid
    assert chat.read_chats(out.limit(0)).count() == 0


def test_mixing(spark, docs):
    a, b = ({r.doc_id: r for r in mixing.mix(docs[0], block=8).collect()} for _ in range(2))
    assert a == b and len(a) == len(docs[1])
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for i, t, _, s, *_ in docs[1]:
        assert a[i].size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and a[i].taken <= 3 * a[i].size
        taken[s] += a[i].taken
        size[s] += a[i].size
        target[s] = a[i].target
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, left = {}, sum(size.values())
    while True:
        rest = [s for s in order if s not in full]
        over = [s for s in rest if left * w[s] / sum(w[x] for x in rest) > 3 * size[s]]
        if not over:
            break
        full.update({s: 3 * size[s] for s in over})
        left = sum(size.values()) - sum(full.values())
    for s in order:
        want = full.get(s, left * w[s] / sum(w[x] for x in rest))
        assert abs(target[s] - want) < 1e-6 * (1 + want) and abs(taken[s] - want) <= 3 * 8  # a few blocks: what the points ask of the source
    assert mixing.mix(docs[0].limit(0)).count() == 0


def test_decontamination(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = docs[1][12][1].split(" ")
    items = [(1, " ".join(w[3:20])), (2, "one TWO"), (10, " ".join(w[5:16])), (3, None), (4, "!!"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs[0], bench).collect()}
    for i, t, *_ in docs[1]:
        d, hit, found = words(t), set(), set()
        for k, x in items:
            x = words(x)
            n = min(10, len(x))
            for j in range(len(x) - n + 1) if n else ():
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == x[j : j + n]:
                        hit.update(range(p, p + n))
                        found.add(k)
        ids = sorted(str(k) for k in found if k is not None)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(d), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    left = decontaminate.remove_spans(docs[0], bench)
    assert left.columns == docs[0].columns and decontaminate.scan(left, bench).filter("contaminated").count() == 0
    assert decontaminate.scan(docs[0], bench.limit(0)).filter("contaminated").count() == 0


def test_toxicity(spark):
    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([*rng.choice(["alpha", "beta", "gamma", "delta", "you"], 20), *(["grumblo", "idiot"] if bad else [])])))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "idiot")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, y)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert toxicity.score(d, toxicity.train(d, y.limit(0))).count() == len(rows)


def test_html():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>m</a></nav><!-- <p>c</p> --><div class='ad'>buy now, buy.</div><article><header><h1>Head &amp; more</h1></header><p>First,  text\n here.<p><b>Second</b> one, too.<br></article><div class=comments><p>Nice, all.</p></div><footer>f</footer></body></html>"
    assert html_text.main_text(page) == "Head & more\nFirst, text here.\nSecond one, too."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("<p>" + "Long, text. " * 20000) == ("Long, text. " * 20000).strip() and html.unescape("&amp") == "&"


def test_html_ratios_decide():
    story = [f"Paragraph {k} of the story, with a point. " * 12 for k in range(10)]
    body = "".join(f"<p>{x}</p>" for x in story)
    want = "\n".join(x.strip() for x in story)
    for tag in ("article", "main"):
        teaser = f"<section><{tag}><p>Another tale, to be read elsewhere today. Read more of it.</p></{tag}></section>"
        assert html_text.main_text(f"<body><div class=content>{body}</div>{teaser}</body>") == want
        assert html_text.main_text(f"<body>{teaser}<div class=content>{body}</div></body>") == want
        links = "<div class=more>" + "<ul><li><a>Other tale</a></li></ul>" * 30 + "</div>"
        assert html_text.main_text(f"<body><{tag}><div class=content>{body}</div>{links}</{tag}></body>") == want
        assert html_text.main_text(f"<body><{tag}><div class=top><h1>Title</h1></div><div class=content>{body}</div></{tag}></body>") == "Title\n" + want
    assert html_text.main_text(f"<body><div><a>Home</a> <a>Away</a></div><div class=content>{body}</div></body>") == want


def test_html_class_names():
    story = "<h1>Title</h1>" + "".join(f"<p>Paragraph {k} of the story, with a point.</p>" for k in range(9))
    want = "\n".join(["Title", *(f"Paragraph {k} of the story, with a point." for k in range(9))])
    for name in ("site has-sidebar", "content with-sidebar", "no-header", "nav-open", "sidebar-left", "menu", "widget", "search"):
        assert html_text.main_text(f"<body><div class='{name}'><article>{story}</article></div></body>") == want, name
        assert html_text.main_text(f"<body><div class='{name}'>{story}</div><footer>f</footer></body>") == want, name
    assert html_text.main_text(f"<body><form id=f><div>{story}</div></form></body>") == want
    for name in ("post-header", "entry-header", "header", "section-header"):
        assert html_text.main_text(f"<body><article>{story.replace('<h1>', f'<div class={name}><h1>').replace('</h1>', '</h1></div>')}</article></body>") == want, name
    for name in ("ad", "ad-slot", "site-footer", "comment-list", "cookie-notice", "related-posts", "share-buttons", "sidebar-left", "x main-nav"):
        extra = f"<div class='{name}'><p>Something else, said by others.</p></div>"
        assert html_text.main_text(f"<body><article>{story}{extra}</article></body>") == want, name
    talk = "<div class=comments>" + "<p>A long comment, longer than all. </p>" * 60 + "</div>"
    assert html_text.main_text(f"<body><div>{story}</div>{talk}</body>") == want
    assert html_text.main_text("<body><div class=ad>Buy now, buy.</div></body>") == ""


def test_ogg(spark, docs):
    got = {r.doc_id: r for r in ogg.decode_media(ogg.encode_media(docs[0])).collect()}
    for i, t, *_ in docs[1]:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    m = bytearray(ogg.mux(b"z" * 57600))
    assert b"".join(ogg.demux(bytes(m))[ogg.DATA]["packets"][1:]) == b"z" * 57600
    m[500] ^= 1
    with pytest.raises(ValueError):
        ogg.demux(bytes(m))

    def slow(page):
        c = 0
        for b in page:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    assert ogg.page_crc(b"OggS and more") == slow(b"OggS and more")


def test_licenses(spark, docs):
    got = {r.doc_id: r for r in licenses.scan(docs[0]).collect()}
    for i, t, *_ in docs[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(p, v) for k, v in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(k.split())] == k.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    mit = "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    want = [
        (gpl.format(3), "gpl-3"), (gpl.format(2), "gpl-2"), (gpl.replace("General", "Lesser General").format("2.1"), "lgpl"), (gpl.replace("General", "Affero General").format(3), ""),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"), ("GNU General Public License version 3", "gpl-3"),
        ("version 2 of the GNU General Public License", "gpl-2"), ("GPL-3.0-or-later", "gpl-3"), ("either the GNU General Public License or the Apache License, Version 2.0", "apache-2"),
        (mit, "mit"), (mit.replace("hereby granted", "granted"), "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("Licensed under the Apache License, Version 1.1", ""), ("the Apache License 2.0", "apache-2"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"), ("Creative Commons Attribution 4.0 International", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("the permission of the general public to use this software, version 3, is free of charge", ""), ("a license to sail in any version 2 of the boat", ""),
    ]
    rows = [(k, f"{'some words before it ' * 9}{t}{' and some after it' * 9}") for k, (t, _) in enumerate(want)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(want)] == want


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, docs, n, num):
    sets = {}
    for i, t, *_ in docs[1]:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard_join.jaccard_components(docs[0], n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), comp[i]) for i in sets} and len(got) == len(sets)
    assert jaccard_join.keep_one(docs[0], n=n, num=num).count() == len(set(comp.values()))


def test_null_and_repeated_ids(spark, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    near = text(0).replace("w0x39", "changed")
    rows = [(5, text(0), "a"), (5, text(0), "a"), (None, text(0), "b"), (None, near, "c"), (4, near, "d"), (None, text(1), "e"), (None, text(1), "e"), (7, text(2), "f"), (7, text(2), "f"), (9, text(3), "g"), (9, text(4), "h"), (None, None, "i"), (None, None, "i"), (None, "", "j"), (8, "", "k"), (8, "", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, jaccard_join.keep_one(d, n=3, num=80, den=100).collect()), key=str)
    assert got == sorted([(4, near, "d"), (None, text(1), "e"), (7, text(2), "f"), (9, text(3), "g"), (9, text(4), "h"), *rows[11:]], key=str)

    model = toxicity.Model(["idiot"], np.array([9.0, 0, 0, 0]), -4.0)
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    bad = spark.createDataFrame([(1, "you idiot", 3), (None, "you idiot", 3), (None, "you there", 3), (2, None, 3), (2, "kind words", None)], "doc_id long, text string, n int")
    assert sorted(map(tuple, toxicity.drop_toxic(bad, bad).collect()), key=str) == sorted([(None, "you there", 3), (2, None, 3), (2, "kind words", None)], key=str)


def test_jaccard_empty(spark, docs):
    assert jaccard_join.jaccard_components(docs[0].limit(0)).count() == 0
    assert jaccard_join.jaccard_components(docs[0].filter("doc_id < 3")).count() == 3


def test_language(spark):
    train = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune Fuchs und der Hund", "en" if i % 2 else "de") for i in range(20)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    pages = [(1, "https://a.de/de/1", "<html lang='de'><p>und der Hund</p>"), (2, "https://b.com/x", "<p>and the dog, the fox</p>"), (3, None, None), (4, "https://a.de/", "")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and got[4].lang == "de" and len(got) == 4 and 0 < got[3].p_lang <= 1


def test_long_text_outvotes_the_markup(spark):
    line = "the quick brown fox and the dog and a cat ran over to the old mill "
    train = [(i, line * 4 + ("to see it" if i % 2 else "to sea et"), "en" if i % 2 else "de") for i in range(20)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    body = (line * 4 + "to see it ") * 40
    pages = [(1, "https://a.de/de/1", f"<html lang='de'><p>{body}</p>"), (2, "https://a.de/de/2", f"<html lang='de'><p>{body[:60]}</p>")]
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got == {1: "en", 2: "de"}


def test_more_than_500_languages(spark):
    d = spark.createDataFrame([(i, "some text", f"l{i:03}") for i in range(502)], "doc_id long, text string, lang string").coalesce(1).cache()
    assert language_id.train(d)[0] == [f"l{i:03}" for i in range(502)]
