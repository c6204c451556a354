"""What is written of a motif hit: flanks, cores, motif and print records, evidence fields, aligned rows; and the C filter.

Hits are the rows of `motif_scan.search` (positions from 1, scores in hundredths). All but the aligned rows and the
filter's scan are expressions of one row. A null sequence gives no record."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.motif_scan import _LETTER, AMINO, A, B, C, Model, window_scores

#: fixed values: longest flanks beside the motifs, least score (hundredths) of cores and flanks, reach and least score of the C filter
LEFT, RIGHT, LEAST, C_REACH, C_LEAST = 149, 150, 2000, 150, 500


def _permuted() -> Column:
    return F.col("abc") == "CAB"


def exclude(hits: DataFrame, groups) -> DataFrame:
    """Hits of other groups: an excluded group still competes for the best hit, it is only not shown."""
    return hits.filter(~F.col("group").isin(*groups)) if groups else hits


def gate(hits: DataFrame, least: float = 10.0) -> DataFrame:
    """Hits over the least score of the structure commands."""
    return hits.filter(F.col("score") > least * 100)


def flanks(hits: DataFrame, left: bool, least: int = 0, least_score: int = LEAST) -> DataFrame:
    """seq_idx, abc, label suffix and flank before the first (left) or after the last motif; hits carry seq."""
    n = F.length("seq")
    if left:
        end = F.when(_permuted(), F.col("pos_c")).otherwise(F.col("pos_a")) - 1
        size, ok = F.least(end, F.lit(LEFT)), end > 1
        start = end - size + 1
    else:
        start = F.when(_permuted(), F.col("pos_b") + B).otherwise(F.col("pos_c") + C)
        size, ok = F.least(n - start + 1, F.lit(RIGHT)), start < n
    d = hits.filter(F.col("score") >= least_score).filter(ok).withColumn("size_", size).filter(F.col("size_") >= least)
    return d.select("seq_idx", "abc", F.concat(F.lit("group="), "group").alias("suffix"), F.substring("seq", start, F.col("size_")).alias("flank"))


def motif_records(hits: DataFrame, gap: str = "") -> DataFrame:
    """seq_idx, abc and the three motifs with `gap` between them, nothing by default."""
    return hits.filter("seq_a <> '' AND seq_b <> '' AND seq_c <> ''").select("seq_idx", "abc", F.concat_ws(gap, "seq_a", "seq_b", "seq_c").alias("motifs"))


def _places(lo: Column) -> Column:
    parts = [F.concat(F.lit(f" {x.upper()}:"), (F.col(f"pos_{x}") - lo + 1).cast("string"), F.lit(":"), F.col(f"seq_{x}")) for x in "abc"]
    return F.concat(*parts, F.lit(" PSSM:"), F.col("group"))


def prints(hits: DataFrame) -> DataFrame:
    """seq_idx, abc, label suffix with the motifs' places in the print, and the print from first to last motif."""
    return hits.select("seq_idx", "abc", _places(F.col("lo")).alias("suffix"), F.substring("seq", F.col("lo"), F.col("hi") - F.col("lo") + 1).alias("print"))


def cores(hits: DataFrame, least_flank: int = 0, least_score: int = LEAST) -> DataFrame:
    """seq_idx, abc, label suffix and core, from up to LEFT before the first motif to RIGHT after the last one's start; abc is null where a hit gives no core."""
    first, last = F.when(_permuted(), F.col("pos_c")).otherwise(F.col("pos_a")), F.when(_permuted(), F.col("pos_a")).otherwise(F.col("pos_c"))
    before, after = F.least(first - 1, F.lit(LEFT)), F.least(F.length("seq") - last, F.lit(RIGHT))
    ok = (F.col("score") >= least_score) & (before >= least_flank) & (after >= least_flank)
    lo = first - before
    when = lambda c: F.when(ok, c)
    return hits.select("seq_idx", when(F.col("abc")).alias("abc"), when(_places(lo)).alias("suffix"), when(F.substring("seq", lo, last + after - lo + 1)).alias("core"))


def evidence(hits: DataFrame, label: str = "seq_idx") -> DataFrame:
    """One key=value line a hit."""
    one = lambda c, form: F.col(f"{c}_text") if f"{c}_text" in hits.columns else F.format_string(form, F.col(c) / 100)
    fields = {"score": one("score", "%.1f"), "group": F.col("group"), "group2": F.coalesce("group2", F.lit(".")), "diff2": one("diff2", "%+.1f"), "ABC": F.col("abc")}
    for x in "abc":
        fields |= {f"seq{x.upper()}": F.col(f"seq_{x}"), f"pos{x.upper()}": F.col(f"pos_{x}").cast("string")}
    return hits.select(F.concat_ws("\t", F.col(label).cast("string"), *[F.concat(F.lit(f"pssm_{k}="), v) for k, v in fields.items()]).alias("line"))


def _aligned(h, model: Model, group: int, label) -> str:
    """Four rows: places and scores, the sequence, marks, the profile's best letters. The gap shown adds the earlier motif's length, as its readers expect."""
    rows, before = ["", "", "", ""], None
    for x in "cab" if h.abc == "CAB" else "abc":
        profile, seq, pos = model.tables[group]["abc".index(x)], getattr(h, f"seq_{x}"), getattr(h, f"pos_{x}")
        scores = [int(profile[c][_LETTER[ord(a) & 255]]) for c, a in enumerate(seq)]
        total = np.float32(0)
        for v in scores:
            total += np.float32(v / 100)
        head = f"{x.upper()}:{pos}-{pos + len(seq) - 1}({total:.1f})"
        marks = "".join("|" if s >= 100 else "+" if s >= 50 else "." if s > 0 else " " for s in scores)
        best = model.consensus[model.names[group]]["abc".index(x)] if model.consensus else "".join(AMINO[int(np.argmax(row[:20]))] for row in profile)
        gap = "   " if before is None else f" <{pos - before[0] + before[1]}> "
        wide = max(len(head), len(seq)) if x != ("b" if h.abc == "CAB" else "c") else len(seq)
        rows = [rows[0] + " " * len(gap) + head.ljust(len(seq)), *(r + (gap if k == 0 else " " * len(gap)) + v.ljust(wide) for k, (r, v) in enumerate(zip(rows[1:], (seq, marks, best), strict=True)))]
        before = pos, len(seq)
    rows[1] += f"  [{h.ppl}]"
    second = f" ({h.group2} {h.diff2_text})" if h.group2 else ""
    return "\n".join(["", f">{label}", *rows, f"Score {h.score_text}{' permuted' if h.abc == 'CAB' else ''}, {h.group}{second}"])


def reports(hits: DataFrame, model: Model, label: str = "seq_idx") -> DataFrame:
    """seq_idx and the report of each hit, under its label."""
    groups = {name: k for k, name in enumerate(model.names)}

    def run(frames):
        for f in frames:
            f["group2"] = f["group2"].astype(object).where(f["group2"].notna(), None)
            yield pd.DataFrame({"seq_idx": f["seq_idx"], "report": [_aligned(h, model, groups[h.group], getattr(h, label)) for h in f.itertuples()]})

    return hits.mapInPandas(run, "seq_idx long, report string")


def merge_c_hits(scores: np.ndarray, more_than: int) -> dict[int, tuple[int, int]]:
    """place -> (score, group) of the motif C scores (group, place) over `more_than`, group after group.

    A group whose hit falls on a place that is already known keeps the better of the two there and ends: its later hits are not taken."""
    found: dict[int, tuple[int, int]] = {}
    for g, row in enumerate(scores):
        for p in np.flatnonzero(row > more_than).tolist():
            known = p in found
            if not known or row[p] > found[p][0]:
                found[p] = (int(row[p]), g)
            if known:
                break
    return found


def c_filter(seqs: DataFrame, model: Model, least: int = C_LEAST) -> DataFrame:
    """seq_idx, pos (from 1), score, group, lo, hi, seq_c, consensus: the places where motif C alone reaches `least`, and the window around each."""

    def run(frames):
        best = [model.consensus[n][2] if model.consensus else "".join(AMINO[int(max(range(20), key=lambda a, r=r: r[a]))] for r in t[2]) for n, t in zip(model.names, model.tables, strict=True)]
        for f in frames:
            out = []
            for i, s in zip(f["seq_idx"], f["seq"], strict=True):
                s = (s or "").upper()
                codes = _LETTER[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
                if len(codes) < C:
                    continue
                found = merge_c_hits(np.stack([window_scores(codes, t[2]) for t in model.tables]), model.min_c)
                for p, (score, g) in sorted(found.items()):
                    if score >= least:
                        out.append((i, p + 1, score, model.names[g], max(0, p - C_REACH) + 1, min(len(s) - 1, p + C + C_REACH) + 1, s[p : p + C], best[g]))
            yield pd.DataFrame(out, columns=["seq_idx", "pos", "score", "group", "lo", "hi", "seq_c", "consensus"])

    return seqs.select("seq_idx", "seq").mapInPandas(run, "seq_idx long, pos int, score int, group string, lo int, hi int, seq_c string, consensus string")
