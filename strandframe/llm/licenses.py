"""Operator 8: license scans with a positional index of rare template words.

Templates are notices and whole license texts, several a label; a word's weight is its inverse document frequency over
all texts and the templates, by grouped counts. The index holds each template's words of the highest weight. Their
places in a text are looked up, and the postings intersected by relative position: a template may start where two of
its words at least (word position less position in the template) agree within its slack, a quarter of its length. It
holds where the words that stand there in its order make enough of its weight and its key phrases are there. Rare words also anchor phrases that name a
license by themselves, and license names, whose version is the nearest one after them (up to the next name) or before.
Base phrases are counted wherever their words stand consecutively. Null texts count as empty: no words, no labels,
null positions, score 0; repeated rows are scanned alike; extra columns are ignored.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import ALNUM, chunks, word_hash, words

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
shall be included in all copies or substantial portions of the software"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version {} of the license or at your option any later version"""
_LGPL = _GPL.replace("program", "library").replace("general", "lesser general")
#: label: (notice, mandatory phrases) of each template
TEMPLATES = {
    "mit": [("released under the mit license", ["mit license"]), (_MIT, ["substantial portions of the software"])],
    "apache-2": [
        ("licensed under the apache license version 2 0", ["apache license", "version 2"]),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["compliance with the license", "license 2 0"]),
    ],
    "cc-by-nc": [("licensed under cc by nc 4 0", ["cc by nc"]), ("licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"])],
    "cc-by-sa": [("licensed under cc by sa 4 0", ["cc by sa"]), ("licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"])],
    "cc-by": [("licensed under a creative commons attribution 4 0 license", ["creative commons attribution 4 0"]), ("licensed under a creative commons attribution 3 0 unported license", ["creative commons attribution 3 0"])],
    "gpl-3": [("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]), (_GPL.format(3), ["gnu general public license", "version 3"])],
    "gpl-2": [("this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]), (_GPL.format(2), ["gnu general public license", "version 2"])],
    "lgpl": [("licensed under the gnu lesser general public license", ["lesser general public license"]), (_LGPL.format("2 1"), ["lesser general public license"]), (_LGPL.format(3), ["lesser general public license"])],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["this list of conditions"]),
    ],
    "mpl-2": [
        ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
        ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mpl 2 0"]),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software"]), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission notice appear in all copies", "without fee"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["unencumbered software"]), ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["public domain", "compiled binary"])],
}
#: label: phrases that name it by themselves
NAMED = {
    "mit": ["mit license", "mit licence", "license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2": ["apache 2 0", "apache org licenses license 2 0"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial", "creativecommons org licenses by nc"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike", "creativecommons org licenses by sa"],
    "cc-by": [f"{x} {n}" for x in ("cc by", "creative commons attribution", "creativecommons org licenses by") for n in (1, 2, 3, 4)] + [f"creative commons attribution {x}" for x in ("license", "licence", "international")],
    "gpl-3": ["gplv3", "gpl3"],
    "gpl-2": ["gplv2", "gpl2"],
    "lgpl": ["gnu lesser general public license", "gnu lesser general public licence", "gnu library general public license", "gnu lgpl", "lgplv2", "lgplv3", "lgpl 2", "lgpl 3", "lgpl v2", "lgpl v3", "lgpl version 2", "lgpl version 3"],
    "bsd": ["bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl-2": ["mozilla org mpl 2 0", "mplv2"],
    "isc": ["isc license", "isc licence", "license identifier isc"],
    "unlicense": ["the unlicense", "unlicense org", "license identifier unlicense", "free and unencumbered software released into the public domain"],
}
#: family: names; a version of it counts up to the next name of any family
FAMILIES = {
    "gpl": ["gnu general public license", "gnu general public licence", "gnu gpl", "gpl"],
    "lgpl": ["lesser general public license", "lesser general public licence", "library general public license", "lgpl"],
    "agpl": ["affero general public license", "affero general public licence", "agpl"],
    "apache": ["apache license", "apache licence", "apache software license"],
    "mpl": ["mozilla public license", "mozilla public licence", "mpl"],
    "": ["mit license", "bsd license", "isc license", "eclipse public license", "creative commons", "cc by", "artistic license"],
}
VERSIONS = {("gpl", 3): "gpl-3", ("gpl", 2): "gpl-2", ("apache", 2): "apache-2", ("mpl", 2): "mpl-2"}
_ANCHORS = "gnu gpl cc mit bsd isc apache mozilla mpl lesser library lgpl affero agpl creative creativecommons unlicense unencumbered hereby redistribution".split()
_DIGIT = {word_hash(str(n)): n for n in range(1, 10)}
_V = {word_hash(x) for x in ("version", "v")}
_VN = {word_hash(f"v{n}"): n for n in range(1, 10)}
_OF, _THE = word_hash("of"), word_hash("the")


def versions(ws: list[int], start: int, end: int, stop: int, reach: int = 24) -> set[int]:
    """Versions of a license named by the words from start to end: 'version 3 of the' before it, or the nearest after it and those a few words on."""
    got: set = set()
    a = start - 1 if start and ws[start - 1] == _THE else start
    if a >= 2 and ws[a - 1] == _OF:
        if ws[a - 2] in _VN:
            got.add(_VN[ws[a - 2]])
        elif a >= 3 and ws[a - 2] in _DIGIT and ws[a - 3] in _V:
            got.add(_DIGIT[ws[a - 2]])
        elif a >= 4 and ws[a - 3] in _DIGIT and ws[a - 4] in _V:  # version 2 0 of the
            got.add(_DIGIT[ws[a - 3]])
    if got:
        return got
    last = min(stop, end + reach, len(ws))
    j = end
    while j < last:
        n = _VN.get(ws[j]) or (_DIGIT.get(ws[j]) if j == end else None) or (_DIGIT.get(ws[j + 1]) if ws[j] in _V and j + 1 < len(ws) else None)
        if n:
            if not got:
                last = min(last, j + 9)
            got.add(n)
        j += 1
    return got


class Index:
    def __init__(self, templates=TEMPLATES, base=BASE, rare: int = 4, cover: float = 0.75, slack: int = 1, seen: dict | None = None, texts: int = 0):
        """seen: the number of texts that hold each word, of `texts`."""
        self.cover = cover
        flat = [(k, t.split(), ps) for k, ts in templates.items() for t, ps in ts]
        df: dict = {}
        for _, ws, _ in flat:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: math.log((len(flat) + texts + 1) / (c + (seen or {}).get(w, 0))) for w, c in df.items()}
        hashed = lambda s: [word_hash(w) for w in s.split()]
        self.base = [(hashed(p), label) for p, label in base.items()]
        #: label, (word, weight), key phrases and slack of each template
        self.templates = [(k, [(word_hash(w), self.idf[w]) for w in ws], [hashed(p) for p in ps], max(slack, len(ws) // 4)) for k, ws, ps in flat]
        self.post: dict[int, list] = {}
        for t, (_, ws, _) in enumerate(flat):
            for w in sorted(set(ws), key=lambda w: (-self.idf[w], -len(w), w))[: max(rare, len(ws) // 10)]:
                self.post.setdefault(word_hash(w), []).extend((t, i) for i, x in enumerate(ws) if x == w)
        self.indexed: dict[int, int] = {}
        for t, _ in {p for ps in self.post.values() for p in ps}:
            self.indexed[t] = self.indexed.get(t, 0) + 1
        self.anchors: dict[int, list] = {}  # (phrase, place of the anchor in it, label, family)
        for k, p, family in [(k, p, None) for k, ps in NAMED.items() for p in ps] + [(None, p, f) for f, ps in FAMILIES.items() for p in ps]:
            ws = p.split()
            i = max(range(len(ws)), key=lambda i: (ws[i] in _ANCHORS, len(ws[i])))
            self.anchors.setdefault(word_hash(ws[i]), []).append((hashed(p), i, k, family))
        self.keys = np.array(sorted({*self.post, *self.anchors}), np.uint64)

    @staticmethod
    def places(h: np.ndarray, phrase: list[int]) -> np.ndarray:
        n = len(phrase)
        ok = np.ones(max(0, len(h) - n + 1), bool)
        for j, w in enumerate(phrase):
            ok &= h[j : len(h) - n + 1 + j] == np.uint64(w) if len(ok) else ok
        return np.flatnonzero(ok)

    def rare_words(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h

    def named(self, h: np.ndarray, hits: np.ndarray) -> set:
        """Labels by phrases that name a license, and by names with versions."""
        got, names, ws = set(), [], None
        for pos in hits.tolist():
            for phrase, i, label, family in self.anchors.get(int(h[pos]), ()):
                a = pos - i
                if a >= 0 and h[a : a + len(phrase)].tolist() == phrase:
                    if label:
                        got.add(label)
                    else:
                        names.append((a, a + len(phrase), family))
        names.sort()
        for j, (a, z, family) in enumerate(names):
            if family in ("gpl", "apache", "mpl"):
                ws = h.tolist() if ws is None else ws
                stop = next((x for x, _, _ in names[j + 1 :] if x >= z), len(ws))
                got.update(VERSIONS[family, n] for n in versions(ws, a, z, stop) if (family, n) in VERSIONS)
        return got

    def starts(self, places: dict):
        """(template, start) where votes of two different words of it, or of its only one, lie within its slack."""
        for t, votes in places.items():
            slack, need = self.templates[t][3], min(2, self.indexed[t])
            votes.sort()
            j, end = 0, None
            for k, (at, _) in enumerate(votes):
                while votes[j][0] < at - slack:
                    j += 1
                if (end is None or at > end) and len({i for _, i in votes[j : k + 1]}) >= need:
                    yield t, votes[j][0]
                    end = votes[j][0] + max(1, slack // 2)

    @staticmethod
    def aligned(window: list, ws: list, lead: int, slack: int) -> float:
        """Weight of the template's words that stand in its order, each near its place."""
        where: dict = {}
        for k, w in enumerate(window):
            where.setdefault(w, []).append(k)
        after = total = 0
        last, jump = lead, max(2, slack // 3)  # where the next word is due, and how far ahead of it a word is still taken
        for i, (w, x) in enumerate(ws):
            q = next((q for q in where.get(w, ()) if q >= after), None)
            if q is not None and (not after or q <= last + jump) and q <= lead + i + slack + max(1, slack // 2):
                total, after, last = total + x, q + 1, q + 1
            else:
                last += 1
        return total

    def labels(self, h: np.ndarray, hits: np.ndarray) -> tuple[set, float]:
        """Template labels of one text, and the best weighted coverage."""
        got, places = self.named(h, hits), {}
        best = 1.0 if got else 0.0
        for pos in hits.tolist():
            for t, i in self.post.get(int(h[pos]), ()):
                places.setdefault(t, []).append((pos - i, i))
        for t, start in self.starts(places):
            label, ws, phrases, slack = self.templates[t]
            if label in got:
                continue
            a = max(0, start - slack)
            window = h[a : max(0, start + len(ws) + slack + max(1, slack // 2))]
            c = self.aligned(window.tolist(), ws, start - a, slack) / sum(x for _, x in ws)
            if c > best or c >= self.cover:
                full = c >= self.cover and all(len(self.places(window, p)) for p in phrases)
                if full:
                    got.add(label)
                    best = max(best, c)
                else:
                    best = max(best, 0.5 * c)
        return got, min(1.0, best)


def text_counts(docs: DataFrame, names: list[str]) -> tuple[dict, int]:
    """The number of texts that hold each of the names, and of all texts; each task sums its own."""
    hs = np.array([word_hash(w) for w in names], np.uint64)
    order = np.argsort(hs)
    hs, at = hs[order], order

    def run(batches):
        sums, total = np.zeros(len(hs), np.int64), 0
        for b in batches:
            for _, k, data, off in chunks(b.column(0)):
                _, _, h, first = words(data, off, ALNUM)
                j = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
                ok = np.flatnonzero(hs[j] == h)
                row = np.searchsorted(first, ok, "right") - 1
                sums += np.bincount(np.unique(row * len(hs) + j[ok]) % len(hs), minlength=len(hs))
                total += k
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*sums.tolist(), total], pa.int64())], names=["at", "n"])

    got = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = {r["at"]: r["n"] for r in got}
    return {w: n.get(k, 0) for k, w in enumerate(names)}, n.get(-1, 0)


def corpus_index(docs: DataFrame, templates=TEMPLATES) -> Index:
    seen, texts = text_counts(docs, sorted({w for ts in templates.values() for t, _ in ts for w in t.split()}))
    return Index(templates, seen=seen, texts=texts)


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """The contract's columns, one row per row of docs; the index is of the templates' words alone, so it does not grow with the data."""
    shared = docs.sparkSession.sparkContext.broadcast(index or corpus_index(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        x = shared.value
        for b in batches:
            for i, k, data, off in chunks(b.column(1)):
                _, _, h, first = words(data, off, ALNUM)
                out = [[0] * k, [None] * k, [None] * k, [""] * k, [""] * k, [0.0] * k]
                base: dict[int, list] = {}
                for phrase, label in x.base:
                    at = x.places(h, phrase)
                    r = np.searchsorted(first, at, "right") - 1
                    ok = at + len(phrase) <= first[r + 1]  # not over the end of a text
                    for p, row in zip(at[ok].tolist(), r[ok].tolist(), strict=True):
                        base.setdefault(row, []).append((p - int(first[row]), label))
                rare = np.flatnonzero(x.rare_words(h))
                rows = np.searchsorted(first, rare, "right") - 1
                for row in np.unique(np.r_[rows, np.array(list(base), np.int64)]).tolist():
                    a, z = int(first[row]), int(first[row + 1])
                    own, s = x.labels(h[a:z], rare[rows == row] - a)
                    hits = base.get(row, [])
                    bl = {label for _, label in hits}
                    if hits:
                        out[0][row], out[1][row], out[2][row] = len(hits), min(p for p, _ in hits), max(p for p, _ in hits)
                    out[3][row], out[4][row], out[5][row] = ",".join(sorted(bl)), ",".join(sorted(bl | own)), 1.0 if bl else s
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), pa.array(np.diff(first).astype(np.int64)), *(pa.array(v, f.type) for v, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
