"""Whole-sequence kernels over Arrow batches: six-frame translation and the best window of a profile."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandframe.functions.sequence import BASES, CODE
from strandframe.operators.motif_scan import _LETTER, window_scores

_DIGIT = np.full(256, 64, np.uint8)
_OTHER = np.full(256, 64, np.uint8)  # of the complement
for _k, _b in enumerate(BASES):
    for _c in (_b, _b.lower()):
        _DIGIT[ord(_c)] = _k
        _OTHER[ord("AGTC"[_k])] = _OTHER[ord("agtc"[_k])] = _k
_TABLE = np.full(64 * 21 + 1, ord("X"), np.uint8)
_TABLE[:64] = np.frombuffer(CODE.encode(), np.uint8)


def frames(seq: str) -> dict[int, str]:
    """Amino letters of frames 1, 2, 3 and of -1, -2, -3 on the reverse complement; codons with other letters give X, stops *."""
    raw = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    out = {}
    for sign, d in ((1, _DIGIT[raw].astype(np.int64)), (-1, _OTHER[raw][::-1].astype(np.int64))):
        for k in (0, 1, 2):
            n = max(0, (len(d) - k) // 3)
            c = d[k : k + 3 * n].reshape(n, 3)
            out[sign * (k + 1)] = _TABLE[c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2]].tobytes().decode("ascii")
    return out


def six_frames(seqs: DataFrame, key: str, seq: str, kind: str = "long") -> DataFrame:
    """key, frame, aa: six rows a sequence; a null sequence gives none."""

    def run(fs):
        for f in fs:
            rows = [(i, k, aa) for i, s in zip(f[key], f[seq], strict=True) if s is not None for k, aa in frames(s).items()]
            yield pd.DataFrame(rows, columns=[key, "frame", "aa"])

    return seqs.select(key, seq).mapInPandas(run, f"{key} {kind}, frame int, aa string")


def top_window(seqs: DataFrame, profile: np.ndarray) -> DataFrame:
    """seq_idx, score, pos (from 1): the leftmost best window of a profile (column, letter code); shorter sequences give none."""

    def run(fs):
        for f in fs:
            rows = []
            for i, s in zip(f["seq_idx"], f["seq"], strict=True):
                scores = window_scores(_LETTER[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)], profile)
                if len(scores):
                    at = int(scores.argmax())
                    rows.append((i, int(scores[at]), at + 1))
            yield pd.DataFrame(rows, columns=["seq_idx", "score", "pos"])

    return seqs.select("seq_idx", "seq").mapInPandas(run, "seq_idx long, score int, pos int")
