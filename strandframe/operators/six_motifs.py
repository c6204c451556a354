"""Distance profiles of six motifs: training, the profile's text format, and the stepwise search.

The search finds A, B and C together and then adds F2, D and E one at a time: a chain's candidates are thinned to the
best within ten places, the best triple of the three is taken, and each further motif is the place that makes the score
of all so far the greatest. Pairs of candidates are scored by tables of squared distances, which err by a known amount;
the triples that come so near the best are scored exactly. A profile is 57 x 57 numbers and is broadcast; a chain is a row."""
import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.contacts import _Blocks, _Scores, portions
from strandframe.operators.evaluation import class_probability

#: fixed values: names, lengths, anchor letter (x for none) and its place, least and most way to the next motif, least score
MOTIFS = ("f2", "a", "b", "c", "d", "e")
SIZES = (7, 12, 14, 10, 7, 7)
ANCHORS = (("R", 2), ("D", 3), ("G", 1), ("D", 3), ("x", 0), ("x", 0))
LEAST_WAY = (30, 30, 20, 10, 4, 0)
MOST_WAY = (100, 150, 100, 70, 70, 100)
LEAST_SCORE = (0.6, 0.55, 0.6, 0.6, 0.6, 0.4)
THIN = 10
#: triples that are met at a time, and candidates of a motif that are scored with each other at a time
MET, TILE = 1 << 18, 3072
#: triples of a chain that wait for those of others to be scored exactly
FEW = 4096
REPORT_LEAST = 0.1
PLACES = sum(SIZES)


def _at(c: str):
    return lambda i: F.get(c, i).cast("double")


def faults(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, motifs: chains whose stated letters (seq_f2 ...) are not at the stated place (pos_f2 ..., from 1)."""
    off = [F.when(F.col(f"pos_{m}").isNotNull() & ~F.col(f"seq_{m}").eqNullSafe(F.substring("seq", F.col(f"pos_{m}"), F.lit(n))), F.lit(m)) for m, n in zip(MOTIFS, SIZES, strict=True)]
    return chains.select(key, F.concat_ws(",", *off).alias("motifs")).filter("motifs <> ''")


def cells(chains: DataFrame, key: str = "label") -> DataFrame:
    """key, i, j, value (i > j, from 0) between the places of the motifs that a chain has (pos_f2 ... from 1, null for none)."""
    at = F.concat(*[F.when(F.col(f"pos_{m}").isNull(), F.array_repeat(F.lit(None).cast("int"), n)).otherwise(F.sequence(F.col(f"pos_{m}") - 1, F.col(f"pos_{m}") + n - 2)) for m, n in zip(MOTIFS, SIZES, strict=True)])
    picked = chains.select(key, *[F.transform(at, _at(c)).alias(c) for c in ("xs", "ys", "zs")])
    ij = picked.select(key, "xs", "ys", "zs", F.explode(F.sequence(F.lit(1), F.lit(PLACES - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    d = [F.get(c, F.col("i")) - F.get(c, F.col("j")) for c in ("xs", "ys", "zs")]
    return ij.select(key, "i", "j", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("value")).filter("value IS NOT NULL")


def ways(chains: DataFrame) -> DataFrame:
    """motif, least and most way to the next one over all chains that have both."""
    pairs = F.array(*[F.struct(F.lit(m).alias("motif"), (F.col(f"pos_{n}") - F.col(f"pos_{m}")).alias("way")) for m, n in zip(MOTIFS, MOTIFS[1:], strict=False)])
    return chains.select(F.explode(pairs).alias("p")).filter("p.way IS NOT NULL").groupBy("p.motif").agg(F.min("p.way").alias("least"), F.max("p.way").alias("most"))


@dataclass
class Profile:
    mean: np.ndarray
    sd: np.ndarray

    @functools.cached_property
    def blocks(self) -> _Blocks:
        return _Blocks(self.mean, self.sd, SIZES)

    @staticmethod
    def of(trained: DataFrame) -> "Profile":
        """From (i, j, mean, sd) rows; each pair of places has to have been seen."""
        t = trained.toPandas()
        if len(t) != PLACES * (PLACES - 1) // 2:
            raise ValueError("some pairs of motifs occur in no chain")
        out = []
        for c in ("mean", "sd"):
            m = np.zeros((PLACES, PLACES))
            m[t["i"], t["j"]] = m[t["j"], t["i"]] = t[c]
            out.append(m)
        return Profile(*out)


def _places():
    return [(m.upper(), i) for m, n in zip(MOTIFS, SIZES, strict=True) for i in range(n)]


def profile_lines(p: Profile) -> list[str]:
    """The text format: the motifs, then means and deviations, a line a pair of places, four digits."""
    out = [f"cdinfo\t{len(MOTIFS)}", *(f"{k}\t{n}\t{m.upper()}" for k, (m, n) in enumerate(zip(MOTIFS, SIZES, strict=True)))]
    at = _places()
    for name, v in (("avg", p.mean), ("stddev", p.sd)):
        out.append(f"cddata\t{name}\t{PLACES}")
        out += [f"{at[i][0]}\t{at[i][1]}\t{at[j][0]}\t{at[j][1]}\t{v[i, j]:.4g}" for i in range(PLACES) for j in range(i)]
    return out


def read_profile(lines) -> Profile:
    """A profile from its text; a broken one raises."""
    rows, at, out = [x.rstrip("\r\n").split("\t") for x in lines], _places(), []
    head = profile_lines(Profile(np.zeros((PLACES, PLACES)), np.zeros((PLACES, PLACES))))[: 1 + len(MOTIFS)]
    size = PLACES * (PLACES - 1) // 2 + 1
    if rows[: len(head)] != [x.split("\t") for x in head] or len(rows) < len(head) + 2 * size:
        raise ValueError("not a profile of six motifs")
    for k in range(2):
        block = rows[len(head) + k * size : len(head) + (k + 1) * size]
        if block[0][:1] != ["cddata"] or block[0][2:] != [str(PLACES)]:
            raise ValueError("a matrix does not begin where it should")
        m = np.zeros((PLACES, PLACES))
        for row, (i, j) in zip(block[1:], ((i, j) for i in range(PLACES) for j in range(i)), strict=True):
            if row[:4] != [at[i][0], str(at[i][1]), at[j][0], str(at[j][1])] or len(row) != 5:
                raise ValueError(f"line {row} of the profile is out of place")
            m[i, j] = m[j, i] = float(row[4])
        out.append(m)
    return Profile(*out)


class _Chain:
    """A chain by itself or one of those whose points lie one after another in s, from start; own has its anchored places and scores by motif."""

    def __init__(self, seq: str, points: np.ndarray, p: Profile, s: _Scores | None = None, start: int = 0, own: dict | None = None):
        self.n = min(len(seq), len(points))
        self.s, self.start = s or _Scores(points, p.mean, p.sd, SIZES, p.blocks), start
        self.own = own or {k: _anchored(k, _letters(seq[: self.n]), np.array([0, self.n]), self.s) for k in range(4)}

    def candidates(self, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from lo to hi whose letter is the anchor's and whose own block scores enough, with the scores."""
        at, x = self.own[k]
        part = slice(*np.searchsorted(at, (lo, max(hi + 1, lo))))
        return at[part], x[part]

    def thin(self, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates nearer than ten to the last one kept, only a better one stays, in its stead."""
        kept: list = []
        for at, x in zip(*(v.tolist() for v in self.candidates(k, lo, hi)), strict=True):
            if kept and at - kept[-1][0] < THIN:
                if x > kept[-1][1]:
                    kept[-1] = (at, x)
            else:
                kept.append((at, x))
        return np.array([a for a, _ in kept], int), np.array([x for _, x in kept])

    def grid(self, k: int, m: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.s.cross(k, m, np.repeat(s, len(t)), np.tile(t, len(s))).reshape(len(s), len(t))

    def thinned(self) -> list | None:
        """Candidates of A, B and C and their scores."""
        found, span = [], None
        for k in (1, 2, 3):
            end = self.n - sum(w + 1 for w in LEAST_WAY[k:])
            if span is None:
                if end <= 0:
                    return None
                lo, hi = 0, end
            else:
                lo, hi = span[0] + LEAST_WAY[k - 1], min(span[1] + MOST_WAY[k - 1], end)
            at, x = self.thin(k, lo, hi) if lo <= hi else (np.zeros(0, int), None)
            if not len(at):
                return None
            found.append((at, x))
            span = int(at[0]), int(at[-1])
        return found

    def triples(self) -> "_Triples | None":
        """The triples of A, B and C that can be the best: all that come near it by the tables, or, of a long chain's many, the exact best."""
        found = self.thinned()
        if found is None:
            return None
        out = None
        for parts in itertools.product(*[range(0, len(x), TILE) for x, _ in found]):
            for t in self._near(out.top if out else 0.0, *[tuple(v[k : k + TILE] for v in x) for x, k in zip(found, parts, strict=True)]):
                out = _Triples.joined(out, t)
                if len(out.at[0]) > FEW:
                    out = out.best(self.s)
        return out

    def triple(self) -> dict | None:
        """The best places of A, B and C: {motif: place}."""
        got = self.triples()
        return dict(zip((1, 2, 3), ((x - self.start).tolist()[0] for x in got.best(self.s).at), strict=True)) if got else None

    def _near(self, top: float, *found):
        """Triples whose scores by tables come near the best, which is top or more."""
        (a, xa), (b, xb), (c, xc) = found
        (ab, e1), (bc, e2), (ac, e3) = (self.s.near(k, m, s + self.start, t + self.start) for k, m, s, t in ((1, 2, a, b), (2, 3, b, c), (1, 3, a, c)))
        off = 2 * (e1 + e2 + e3) + 1e-5
        own = xb.astype(np.float32)
        one, two, both = np.ascontiguousarray((2 * ab + xa[:, None].astype(np.float32)).T), 2 * bc + xc.astype(np.float32), 2 * ac
        # of each b, what its triples do not exceed by the best c of each a and by the best a of each c
        by_a, by_c = one + both.max(1) + (two.max(1) + own)[:, None], two + both.max(0) + (one.max(1) + own)[:, None]
        bound = np.minimum(by_a.max(1), by_c.max(1))
        least, met = top - off, []
        for j in np.argsort(-bound).tolist():
            if bound[j] < least:
                break
            i, k = np.flatnonzero(by_a[j] >= least), np.flatnonzero(by_c[j] >= least)
            if not len(i) or not len(k):
                continue
            base, rows = two[j, k] + own[j], max(1, MET // len(k))
            for x in range(0, len(i), rows):
                y = i[x : x + rows]
                total = both[y[:, None], k] + one[j, y][:, None] + base
                most = float(total.max())
                least = max(least, most - 2 * off)
                if most >= least:
                    met.append((most, j, y, k, base))
        for most, j, y, k, base in met:
            if most >= least:
                i, m = np.nonzero(both[y[:, None], k] + one[j, y][:, None] + base >= least)
                i, m, j = y[i], k[m], np.full(len(i), j)
                yield _Triples([x + self.start for x in (a[i], b[j], c[m])], [xa[i], xb[j], xc[m]], max(top, least + off))


@dataclass
class _Triples:
    """Places of A, B and C in a row of chains, their scores, and a score that the best one reaches."""

    at: list
    own: list
    top: float

    @staticmethod
    def joined(a: "_Triples | None", b: "_Triples") -> "_Triples":
        return _Triples([np.concatenate(x) for x in zip(a.at, b.at, strict=True)], [np.concatenate(x) for x in zip(a.own, b.own, strict=True)], max(a.top, b.top)) if a else b

    def scored(self, s: _Scores) -> tuple:
        """Scores, and blocks of A and B, B and C, A and C."""
        a, b, c = self.at
        ab, bc, ac = s.once(1, 2, a, b), s.once(2, 3, b, c), s.once(1, 3, a, c)
        xa, xb, xc = self.own
        return xb + xa + 2 * ab + xc + 2 * (bc + ac), ab, bc, ac

    def best(self, s: _Scores) -> "_Triples":
        """The best one alone; of equal ones the first c, then b, then a."""
        total = self.scored(s)[0]
        k = np.lexsort((*self.at, -total))[:1]
        return _Triples([x[k] for x in self.at], [x[k] for x in self.own], float(total[k[0]]))


def _letters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def _anchored(k: int, letters: np.ndarray, starts: np.ndarray, s: _Scores) -> tuple[np.ndarray, np.ndarray]:
    """Places of chains (letters one after another, from starts) with motif k's anchor whose own block scores enough, with the scores."""
    letter, off = ANCHORS[k]
    at = np.flatnonzero(letters == ord(letter)) - off
    chain = np.searchsorted(starts, at + off, "right") - 1
    at = at[(at >= starts[chain]) & (at + SIZES[k] <= starts[chain + 1])]
    x = s.own(k, at)
    return at[x >= LEAST_SCORE[k]], x[x >= LEAST_SCORE[k]]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of all places from lo to hi."""
    n = np.maximum(hi - lo + 1, 0)
    return np.repeat(np.arange(len(lo)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def _add(k: int, live: list, lo: np.ndarray, hi: np.ndarray, s: _Scores, own: dict) -> list:
    """Put motif k into each chain (places by motif, blocks by motifs, end) at the place from lo to hi that makes the mean over pairs the greatest, the first of equals; those without one go."""
    if k in own:
        at, x = own[k]
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, "right")
        of, k_at = _ranges(a, b - 1)
        places, x = at[k_at], x[k_at]
    else:
        of, places = _ranges(lo, hi)
        x = s.own(k, places)
        good = x >= LEAST_SCORE[k]
        of, places, x = of[good], places[good], x[good]
    gain, blocks = x.copy(), {}
    for m in live[0][0] if live else ():
        t = np.array([at[m] for at, _, _ in live])[of]
        blocks[m] = s.cross(m, k, t, places) if m < k else s.cross(k, m, places, t)
        gain += 2 * blocks[m]
    out, cut = [], np.searchsorted(of, np.arange(len(live) + 1))
    for c, (at, known, end) in enumerate(live):
        if lo[c] + SIZES[k] >= end or cut[c] == cut[c + 1]:
            continue
        best = cut[c] + int(gain[cut[c] : cut[c + 1]].argmax())
        score = float(sum(known[min(i, m), max(i, m)] for i in at for m in at) + gain[best]) / (len(at) + 1) ** 2
        known.update({(min(k, m), max(k, m)): v[best] for m, v in blocks.items()} | {(k, k): x[best]})
        at[k] = int(places[best])
        known["score"] = score
        out.append((at, known, end))
    return out


def _search(rows: list, p: Profile):
    """(label, seq, score, places of the six motifs in their order) of the rows (label, seq, points) that have all six; chains lie one after another, so that each step is one for all."""
    n = [min(len(seq), len(points)) for _, seq, points in rows]
    starts = np.cumsum([0, *n])
    s = _Scores(np.concatenate([x[:m] for (_, _, x), m in zip(rows, n, strict=True)]), p.mean, p.sd, SIZES, p.blocks)
    letters = np.concatenate([_letters(seq[:m]) for (_, seq, _), m in zip(rows, n, strict=True)])
    own = {k: _anchored(k, letters, starts, s) for k in range(4)}
    cut = {k: np.searchsorted(at, starts) for k, (at, _) in own.items()}
    found = []
    for c, (_, seq, points) in enumerate(rows):
        mine = {k: (at[cut[k][c] : cut[k][c + 1]] - starts[c], x[cut[k][c] : cut[k][c + 1]]) for k, (at, x) in own.items()}
        if got := _Chain(seq, points, p, s, int(starts[c]), mine).triples():
            found.append((c, got))
    if not found:
        return
    of = np.repeat([c for c, _ in found], [len(t.at[0]) for _, t in found])
    every = _Triples([np.concatenate(x) for x in zip(*(t.at for _, t in found), strict=True)], [np.concatenate(x) for x in zip(*(t.own for _, t in found), strict=True)], 0.0)
    total, ab, bc, ac = every.scored(s)
    order = np.lexsort((*every.at, -total, of))  # of equal ones the first c, then b, then a
    first = order[np.unique(of[order], return_index=True)[1]]
    live = []
    for c, t in zip(of[first].tolist(), first.tolist(), strict=True):
        at = {m: int(x[t]) for m, x in zip((1, 2, 3), every.at, strict=True)}
        live.append((at, {(1, 2): ab[t], (2, 3): bc[t], (1, 3): ac[t], "chain": c, "score": 0.0} | {(m, m): x[t] for m, x in zip((1, 2, 3), every.own, strict=True)}, int(starts[c + 1])))
    for k, before in ((0, 1), (4, 3), (5, 4)):
        place = np.array([at[before] for at, _, _ in live], int)
        if k == 0:
            lo, hi = np.array([starts[known["chain"]] for _, known, _ in live], int), place - LEAST_WAY[0]
        else:
            lo, hi = place + LEAST_WAY[before], np.minimum(place + MOST_WAY[before], np.array([end for _, _, end in live], int) - SIZES[k] - 1)
        live = _add(k, live, lo, hi, s, own)
    for at, known, _ in live:
        if known["score"] > 0:
            label, seq, _ = rows[known["chain"]]
            yield label, seq, known["score"], [at[k] - int(starts[known["chain"]]) for k in range(6)]


def search(chains: DataFrame, profile: Profile, least: float = REPORT_LEAST, key: str = "label", made=None) -> DataFrame:
    """key, score (of all six), p_rdrp, final_score, places (from 1) and letters of the motifs, gate, gdd; chains with all six and a final score of `least`. made: see contacts.search."""
    shared = chains.sparkSession.sparkContext.broadcast(profile)
    kind = chains.schema[key].dataType.simpleString()
    names = [key, "score", *(f"{c}_{m}" for m in MOTIFS for c in ("pos", "seq"))]

    def run(frames):
        p = shared.value

        for rows in portions(frames, made):
            hits = _search(rows, p)
            yield pd.DataFrame([(label, score, *(v for a, n in zip(at, SIZES, strict=True) for v in (a + 1, seq[a : a + n]))) for label, seq, score, at in hits], columns=names)

    schema = f"{key} {kind}, score double, " + ", ".join(f"pos_{m} long, seq_{m} string" for m in MOTIFS)
    d = (chains if made else chains.select(key, "seq", "xs", "ys", "zs")).mapInPandas(run, schema)
    d = d.withColumn("gate", F.substring("seq_a", 9, 1)).withColumn("gdd", F.substring("seq_c", 3, 3))
    d = d.withColumn("p_rdrp", class_probability(F.col("gate"), F.col("gdd"))).withColumn("final_score", F.col("score") * F.col("p_rdrp"))
    return d.filter(F.col("final_score") >= least)
