"""Palm-print cores of chains: the stretch from motif A to motif C in the motifs' own frame, its checks and its text format.

Chains carry pos_a, pos_b, pos_c (from 0). A chain is a row; nothing is shuffled."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.geometry import canonical_frame
from strandframe.operators.structure import SIZES

#: places that are put out at a time
PORTION = 1 << 18


def faults(chains: DataFrame, key: str = "label", core: bool = False) -> DataFrame:
    """key, fault: chains whose motifs are missing, overlap, or leave the chain; a core also begins with A and ends with C."""
    a, b, c, n = F.col("pos_a"), F.col("pos_b"), F.col("pos_c"), F.length("seq")
    rules = [
        (a.isNull() | b.isNull() | c.isNull() | (a < 0), "no motifs"), (a + SIZES[0] >= b, "A meets B"), (b + SIZES[1] >= c, "B meets C"), (c + SIZES[2] > n, "C leaves the chain"),
        (F.size("xs") != n, "places and letters differ"),
    ]
    if core:
        rules += [(a != 0, "A is not first"), (c + SIZES[2] != n, "C is not last")]
    out = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return chains.select(key, out.alias("fault")).filter("fault IS NOT NULL")


def checked(chains: DataFrame, key: str = "label") -> DataFrame:
    """The cores themselves; one that breaks a rule raises when it is read."""
    a, b, c, n = F.col("pos_a"), F.col("pos_b"), F.col("pos_c"), F.length("seq")
    ok = F.coalesce((a == 0) & (SIZES[0] < b) & (b + SIZES[1] < c) & (c + SIZES[2] == n) & (F.size("xs") == n), F.lit(False))
    return chains.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a core: "), F.col(key).cast("string")))))


def _moved(chains: DataFrame, key: str, cut: bool) -> DataFrame:
    kind = chains.schema[key].dataType.simpleString()
    names = [key, "seq", "pos_a", "pos_b", "pos_c", "xs", "ys", "zs"]

    def run(frames):
        for f in frames:
            rows, n = [], 0
            for k, seq, a, b, c, *xyz in f.itertuples(index=False):
                if pd.isna([a, b, c]).any() or seq is None or any(v is None for v in xyz):
                    continue
                a, b, c = int(a), int(b), int(c)
                p = np.array(xyz, float).T
                if a < 0 or a + SIZES[0] >= b or b + SIZES[1] >= c or c + SIZES[2] > len(p) or len(p) != len(seq):
                    continue
                shift, turn = canonical_frame(p[a], p[b], p[c])
                lo, hi = (a, c + SIZES[2]) if cut else (0, len(p))
                rows.append((k, seq[lo:hi], a - lo, b - lo, c - lo, *((p[lo:hi] + shift) @ turn.T).T))
                n += hi - lo
                if n >= PORTION:
                    yield pd.DataFrame(rows, columns=names)
                    rows, n = [], 0
            yield pd.DataFrame(rows, columns=names)

    return chains.select(*names).mapInPandas(run, f"{key} {kind}, seq string, pos_a int, pos_b int, pos_c int, xs array<double>, ys array<double>, zs array<double>")


def in_frame(chains: DataFrame, key: str = "label") -> DataFrame:
    """Whole chains turned into their motifs' frame: the triangle's middle at the origin, b on the first axis, a in the first plane. Chains with faults are left out."""
    return _moved(chains, key, False)


def cores(chains: DataFrame, key: str = "label") -> DataFrame:
    """The stretch from A to the end of C in the motifs' frame, with the places counted anew. Chains with faults are left out."""
    return _moved(chains, key, True)


def core_text(chains: DataFrame, key: str = "label") -> DataFrame:
    """value: a head with label and motifs (place from 1 and letters), then letter and coordinates by tab, three decimals."""
    parts = [F.concat(F.lit(f"{m}:"), F.col(f"pos_{m.lower()}") + 1, F.lit(":"), F.substring("seq", F.col(f"pos_{m.lower()}") + 1, F.lit(n))) for m, n in zip("ABC", SIZES, strict=True)]
    rows = F.transform(F.arrays_zip(F.split("seq", "").alias("a"), "xs", "ys", "zs"), lambda r: F.format_string("%s\t%.3f\t%.3f\t%.3f", r["a"], r["xs"], r["ys"], r["zs"]))
    return chains.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit(" "), F.concat_ws(" ", *parts), F.lit("\n"), F.concat_ws("\n", rows)).alias("value"))


def read_cores(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """label, seq, xs, ys, zs and pos_a, pos_b, pos_c (from 0) of such texts; strict: a record that is no core raises."""
    from strandframe.sources.readers import _number, _records

    head, body = F.substring_index("r", "\n", 1), F.regexp_extract("r", "(?s)^[^\n]*\n(.*)$", 1)
    rows = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    at = [(F.regexp_extract(head, rf"\s{m}:(\d+):", 1).try_cast("int") - 1).alias(f"pos_{m.lower()}") for m in "ABC"]
    d = _records(spark, path).select(F.regexp_extract("r", r"^(\S*)", 1).alias("label"), rows.alias("t"), *at)
    d = d.select("label", F.concat_ws("", F.transform("t", lambda x: x[0])).alias("seq"), *[F.transform("t", _number(k)).alias(n) for k, n in ((1, "xs"), (2, "ys"), (3, "zs"))], "pos_a", "pos_b", "pos_c")
    return checked(d) if strict else d
