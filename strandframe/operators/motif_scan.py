"""Motif scan, chaining and the top-two fold over sequences; one vectorised pass per sequence and group."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandframe.functions.sequence import AMINO

A, B, C = 12, 14, 8
#: fixed values: allowed distances between motifs, in residues
MIN_AC, MAX_SPAN, MIN_GAP = 90, 180, 10
SHORTEST = A + B + C + MIN_GAP
SCHEMA = "seq_idx long, score int, group string, group2 string, diff2 int, abc string, ql int, lo int, hi int, ppl int, suff int, pos_a int, seq_a string, pos_b int, seq_b string, pos_c int, seq_c string, score_text string, diff2_text string"


class Model:
    """group -> profiles of the three motifs in hundredths, one row of 20 (or 21 with the wild card) a column."""

    def __init__(self, groups: dict, min_c: int = 300, min_ab: int = 200, min_total: int = 1000, stop: int = -1000):
        self.names, self.min_c, self.min_ab, self.min_total = list(groups), min_c, min_ab, min_total
        self.consensus: dict = {}  # group -> letters shown for the three profiles; the best letters where absent
        self.tables = []
        for motifs in groups.values():
            self.tables.append([np.array([[*row[:20], stop, row[20] if len(row) > 20 else 0] for row in m], np.int32) for m in motifs])


_LETTER = np.full(256, 21, np.uint8)
for _k, _a in enumerate(AMINO + "*"):
    _LETTER[ord(_a)] = _k


def window_scores(codes: np.ndarray, profile: np.ndarray) -> np.ndarray:
    n = len(codes) - len(profile) + 1
    out = np.zeros(max(0, n), np.int32)
    for c, row in enumerate(profile):
        out += row[codes[c : c + n]] if n > 0 else 0
    return out


def _top(scores: np.ndarray, lo: int, hi: int, size: int, least: int):
    """Leftmost best window in [lo, hi), its end before hi; None under `least`."""
    if lo >= hi:
        return None
    part = scores[lo : max(lo, hi - size)]
    if not len(part):
        return None
    k = int(part.argmax())
    return (lo + k, int(part[k])) if part[k] >= least else None


def hits(codes: np.ndarray, model: Model):
    """(total, group, a, b, c, permuted) in the order of groups, C hits, straight before permuted."""
    n = len(codes)
    if n < SHORTEST:
        return
    for g, (ta, tb, tc) in enumerate(model.tables):
        sc = window_scores(codes, tc)
        at = np.flatnonzero(sc > model.min_c)
        if not len(at):
            continue
        sa, sb = window_scores(codes, ta), window_scores(codes, tb)
        for c in at.tolist():
            c_hi = c + C - 1
            a = _top(sa, max(0, c_hi - MAX_SPAN + 1), min(n - 1, c_hi - MIN_AC + A), A, model.min_ab)
            if a and (b := _top(sb, a[0] + A - 1 + MIN_GAP, c - MIN_GAP, B, model.min_ab)):
                yield a[1] + b[1] + int(sc[c]), g, a[0], b[0], c, False
            b = _top(sb, c + MIN_AC - 1, min(n - 1, c + MAX_SPAN + B), B, model.min_ab)
            if b and (a := _top(sa, c_hi + MIN_GAP, b[0] - MIN_GAP, A, model.min_ab)):
                yield a[1] + b[1] + int(sc[c]), g, a[0], b[0], c, True


def fold(found, distinct_second: bool = False):
    """Best and second best hit. The old best becomes second unless second already holds the new best's group."""
    top = second = None
    for h in found:
        if top is None or h[0] > top[0]:
            if top is not None and (second is None or h[1] != second[1]) and not (distinct_second and top[1] == h[1]):
                second = top
            top = h
        elif h[1] != top[1] and (second is None or h[0] > second[0]):
            second = h
    return top, second


def shown(codes: np.ndarray, model: Model, hit) -> np.float32:
    """A hit's score as it is printed: sums of single precision, column by column, C's and the motif's found first before the last one's, as files of such hits have them."""
    parts = []
    for table, at in zip(model.tables[hit[1]], hit[2:5], strict=True):
        parts.append(np.float32(0))
        for c, row in enumerate(table):
            parts[-1] += np.float32(row[codes[at + c]] / 100)
    a, b, c = parts
    return b + c + a if hit[5] else a + c + b


def search(seqs: DataFrame, model: Model, distinct_second: bool = False) -> DataFrame:
    """One row per sequence (seq_idx, seq) whose best chain reaches the model's least total; positions from 1."""

    def run(frames):
        for f in frames:
            rows = []
            for i, s in zip(f["seq_idx"], f["seq"], strict=True):
                s = (s or "").upper()
                codes = _LETTER[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
                top, second = fold(hits(codes, model), distinct_second)
                if top is None or top[0] < model.min_total:
                    continue
                t, g, a, b, c, p = top
                score = shown(codes, model, top)
                lo, hi = (c, b + B - 1) if p else (a, c + C - 1)
                rows.append((i, t, model.names[g], model.names[second[1]] if second else None, t - second[0] if second else 0, "CAB" if p else "ABC", len(s), lo + 1, hi + 1, hi - lo + 1, len(s) - hi - 1, a + 1, s[a : a + A], b + 1, s[b : b + B], c + 1, s[c : c + C], f"{score:.1f}", f"{score - shown(codes, model, second) if second else 0:+.1f}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return seqs.select("seq_idx", "seq").mapInPandas(run, SCHEMA)
