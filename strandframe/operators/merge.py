"""key=value evidence records."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_fev(lines: DataFrame, col: str = "line") -> DataFrame:
    """label and a map of fields; the last of repeated keys wins, a field without = is null."""
    parts = F.split(col, "\t")
    pairs = F.filter(F.slice(parts, 2, 1 << 30), lambda x: x != "")
    entry = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    last = F.aggregate(entry, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return lines.select(F.element_at(parts, 1).alias("label"), last.alias("fields"))


def format_fev(label: Column, fields: dict) -> Column:
    return F.concat_ws("\t", label, *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()])


def evalue_score(e: Column) -> Column:
    """-log10, 100 at 1e-100 and under, 0 above 0.1."""
    return F.when(e.isNull() | (e > 0.1), 0.0).when(e <= 1e-100, 100.0).otherwise(-F.log10(e))


def pssm_evalue(score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / 5)


def motif_vote(seqs: list[Column]) -> Column:
    """The most frequent of the sequences that are not empty; of equal ones that which has its number first. Empty if none."""
    all_ = F.filter(F.array(*seqs), lambda s: s.isNotNull() & (s != ""))
    votes = F.transform(all_, lambda s: F.struct(F.size(F.filter(all_, lambda t: t == s)).alias("n"), (-(F.size(all_) - F.array_position(F.reverse(all_), s))).alias("last"), s.alias("s")))
    return F.coalesce(F.array_max(votes)["s"], F.lit(""))


def motif_position(motif: Column, seq: Column) -> Column:
    """Place (from 1) of a motif of four letters at least that occurs once, else null."""
    first = F.call_function("locate", motif, seq)
    again = F.call_function("locate", motif, seq, first + 1)
    return F.when((F.length(motif) >= 4) & (first > 0) & (again == 0), first)


#: fixed values: reach before the first and after the last motif that is known
TRIMS = (("150AC150", "a", "c", 150, 150), ("150CB150", "c", "b", 150, 150), ("200B200", "b", "b", 200, 200), ("250C150", "c", "c", 250, 150), ("150A250", "a", "a", 150, 250))


def full_trim(a: Column, b: Column, c: Column, size: Column, lo: Column, hi: Column) -> Column:
    """lo, hi and method of the first rule whose motifs are known (two of them in that order), else the alignments' span; null if none."""
    at, rules = {"a": a, "b": b, "c": c}, None
    for name, x, y, before, after in TRIMS:
        ok = at[x].isNotNull() & (at[y].isNotNull() & (at[x] < at[y]) if x != y else F.lit(True)) & (size > 0)
        span = F.struct(F.greatest(F.lit(1), at[x] - before).alias("lo"), F.least(size, at[y] + after).alias("hi"), F.lit(name).alias("method"))
        rules = F.when(ok, span) if rules is None else rules.when(ok, span)
    return rules.when(lo.isNotNull() & hi.isNotNull() & (size > 0), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit("aln").alias("method")))


def alignment_span(starts: list[Column], ends: list[Column]) -> tuple[Column, Column]:
    """The least start and the least end (not the largest: the rule that is in use) of the alignments that are there."""
    return F.array_min(F.array(*starts)), F.array_min(F.array(*ends))


def print_span(a: Column, b: Column, c: Column) -> Column:
    """lo and hi of the print: A to the end of C, or C to the end of B; null if neither order is known."""
    return F.when(a.isNotNull() & b.isNotNull() & (a < c), F.struct(a.alias("lo"), (c + 7).alias("hi"))).when(c < b, F.struct(c.alias("lo"), (b + 13).alias("hi")))


def evidence_class(plus: Column, minus: Column, minus_wins: Column) -> Column:
    """0..100 from the scores (evalue_score) of the best evidence for and against."""
    one = F.when(plus >= 10, 100.0).otherwise(50 + plus * 5)
    both = F.when(minus - plus > 1, 0.0).when(minus > plus, 50.0).when(plus - minus > 10, 100.0).otherwise(50 + 5 * (plus - minus))
    return F.when(minus_wins | (plus == 0), 0.0).when(minus == 0, one).otherwise(both)


def class_counts(rows: DataFrame, score: str = "score") -> DataFrame:
    """records, and how many have score 100, 90, 50, over 0 and 0, each record in the highest class it reaches."""
    s = F.col(score)
    return rows.agg(F.count("*").alias("records"), F.count_if(s == 100).alias("n100"), F.count_if((s >= 90) & (s < 100)).alias("n90"), F.count_if((s >= 50) & (s < 90)).alias("n50"), F.count_if((s >= 1) & (s < 50)).alias("n1"), F.count_if(s < 1).alias("n0"))
