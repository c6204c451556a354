"""Operator 12: exact rolling median and median absolute deviation of clicks, by series and time window.

A series is a kind (null is one). Clicks are taken once by click_id and brought down to counts of equal (kind, ts, cents)
before they are dealt out in chunks of time, each with a halo: the window's length before it. Chunks last at most
`longest`; where the rows are dense they get shorter, down to the window itself. A task reads its chunks in order of time,
in blocks, and holds one block and one window. Cents become ranks; the block's moments are cut into lanes, each with a
Fenwick tree of the counts by rank that holds its first window, and numpy moves all lanes at once: one time pointer of a
lane adds what has come, the other takes away what has left. The descent of the tree finds the median; the deviation's
median is found by bisection of a radius, the tree telling how many cents lie within. Clicks then get what holds at their
moment by a join, so that one moment may have any number of clicks.

Empty table: no rows. Null ts: the click goes. Null, NaN or infinite value: no cents, but a row (|value| < 1e15).
Null click_id: one click. Rows that share a click_id but differ: the one with the least ts, kind and value stays, nulls
last. Ties, repeated rows: windows count each click_id. Other columns are not looked at.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import trimmed

MINUTE = 60_000_000
WINDOW = 60 * MINUTE
LONGEST = 6 * WINDOW
#: rows that a chunk of all series together should hold
DENSE = 16_384
LANE = 24
BLOCK = 1 << 17
CELLS = 1 << 23
_OUT = "kind string, us long, n long, median2 long, mad4 long"


def clicks_once(clicks: DataFrame) -> DataFrame:
    """click_id, kind, us (microseconds of ts), cents; one row a click_id, none without ts."""
    nulls_last = [F.col("ts").isNull(), F.unix_micros(F.col("ts").cast("timestamp_ltz")), F.col("kind").isNull(), F.col("kind"), F.col("value").isNull(), F.col("value").cast("double")]
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(nulls_last)])
    one = clicks.groupBy("click_id").agg(F.min(row).alias("r"))
    value = F.col("r.c5")
    cents = F.when(F.abs(value) < 1e15, F.floor(value * 100 + 0.5))  # false for null, NaN and infinite values
    return one.filter("r.c1 IS NOT NULL").select("click_id", F.col("r.c3").alias("kind"), F.col("r.c1").alias("us"), cents.alias("cents"))


def chunk_length(points: DataFrame, window: int = WINDOW, longest: int = LONGEST, dense: int = DENSE) -> int:
    """A chunk's microseconds: dense rows of all series at the mean rate, but from the window to `longest`."""
    n, a, b = points.agg(F.count("*"), F.min("us"), F.max("us")).first()
    return int(min(longest, max(window, dense * (b - a + 1) / n))) if n else longest


def build(h: np.ndarray) -> np.ndarray:
    """Fenwick trees of rows of counts; cell 0 is unused."""
    c = np.zeros((h.shape[0], h.shape[1] + 1), np.int64)
    np.cumsum(h, axis=1, out=c[:, 1:])
    i = np.arange(1, c.shape[1])
    c[:, 1:] -= c[:, i - (i & -i)]
    return c


class Lanes:
    """Fenwick trees side by side, moved together: tree i has size[i] cells, base[i] is the place of its cell 0."""

    def __init__(self, trees: list[np.ndarray]):
        self.size = np.concatenate([np.full(len(t), t.shape[1] - 1) for t in trees])
        self.base = np.r_[0, np.cumsum(self.size + 1)[:-1]]
        self.cells = np.concatenate([t.ravel() for t in trees])
        self.top = 1 << int(self.size.max()).bit_length() - 1

    def add(self, lane: np.ndarray, rank: np.ndarray, n: np.ndarray) -> None:
        """n more at a rank (from 0)."""
        base, size, at = self.base[lane], self.size[lane], rank + 1
        while len(at):
            np.add.at(self.cells, base + at, n)
            at = at + (at & -at)
            on = np.flatnonzero(at <= size)
            base, size, at, n = base[on], size[on], at[on], n[on]

    def below(self, lane: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many lie at ranks under `rank`."""
        base, at = self.base[lane], rank
        out = self.cells[base + at]
        for _ in range(int(rank.max(initial=0)).bit_length() - 1):
            at = at & (at - 1)
            out += self.cells[base + at]  # cell 0 holds 0
        return out

    def kth(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rank of the k-th in order (from 1), by descent."""
        at, left, base, size = np.zeros(len(lane), np.int64), k.copy(), self.base[lane], self.size[lane]
        step = self.top
        while step:
            to = at + step
            c = self.cells[base + np.minimum(to, size)]
            ok = (to <= size) & (c < left)
            at += ok * step
            left -= ok * c
            step >>= 1
        return at


def pieces(us: np.ndarray, cents: np.ndarray, n: np.ndarray, asked: np.ndarray, window: int) -> list["Series"]:
    """Series of runs of the moments, about as long as a window holds rows, each with the rows that its windows hold."""
    per = max(512, int(np.searchsorted(us, asked[len(asked) // 2], "right") - np.searchsorted(us, asked[len(asked) // 2] - window)))
    out = []
    for i in range(0, len(asked), per):
        some = asked[i : i + per]
        a, b = np.searchsorted(us, some[0] - window), np.searchsorted(us, some[-1], "right")
        out.append(Series(us[a:b], cents[a:b], n[a:b], some, window))
    return out


class Series:
    """Rows of one series in order of time: cents and counts, and the moments asked for."""

    def __init__(self, us: np.ndarray, cents: np.ndarray, n: np.ndarray, asked: np.ndarray, window: int):
        self.asked = asked
        self.end, self.start = np.searchsorted(us, asked, "right"), np.searchsorted(us, asked - window, "left")
        has = n > 0  # a moment may be there without cents
        self.values, rank = np.unique(cents[has], return_inverse=True)
        self.rank, self.n = np.zeros(len(us), np.int64), n
        self.rank[has] = rank

    def lanes(self, lane: int) -> list[tuple[int, int]]:
        """(first, after the last) of the moments of each lane; lanes are fewer and longer where the trees are large."""
        q, width = len(self.asked), len(self.values) + 1
        per = max(lane, -(-q // max(1, CELLS // width)))
        return [(a, min(q, a + per)) for a in range(0, q, per)]

    def trees(self, cuts: list[tuple[int, int]]) -> np.ndarray:
        """Counts by rank just before each lane's first moment, as Fenwick trees."""
        u = max(1, len(self.values))
        h = np.zeros((len(cuts), u), np.int64)
        for bound, sign in ((self.end, 1), (self.start, -1)):
            at = np.r_[0, [bound[a - 1] if a else 0 for a, _ in cuts]]
            for j in range(len(cuts)):
                s = slice(at[j], at[j + 1])
                h[j] += sign * np.bincount(self.rank[s], self.n[s], u).astype(np.int64)
        return build(np.cumsum(h, axis=0))


def windows(series: list[Series], lane: int = LANE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n, doubled median and doubled median deviation for each moment of each series (0 where n is 0)."""
    cuts = [s.lanes(lane) for s in series]
    f = Lanes([s.trees(c) for s, c in zip(series, cuts, strict=True)])
    of = np.repeat(np.arange(len(series)), [len(c) for c in cuts])
    row0 = np.r_[0, np.cumsum([len(s.rank) for s in series])][:-1]
    ask0 = np.r_[0, np.cumsum([len(s.asked) for s in series])][:-1]
    rank, count = np.concatenate([s.rank for s in series]), np.concatenate([s.n for s in series])
    end, start = (np.concatenate([x + row0[i] for i, x in enumerate(xs)]) for xs in ([s.end for s in series], [s.start for s in series]))
    # the values of all series in one sorted array: series by series, each moved beyond the one before
    val0 = np.r_[0, np.cumsum([max(1, len(s.values)) for s in series])][:-1]
    values = np.concatenate([s.values if len(s.values) else np.zeros(1, np.int64) for s in series])
    low, high = (np.array([int(g(s.values)) if len(s.values) else 0 for s in series]) for g in (np.min, np.max))
    span = high - low + 2
    move = np.r_[0, np.cumsum(span)[:-1]] - low
    keys = values + np.repeat(move, [max(1, len(s.values)) for s in series])
    first = np.array([a for c in cuts for a, _ in c]) + ask0[of]
    last = np.array([b for c in cuts for _, b in c]) + ask0[of]
    came, left = (np.where(first > ask0[of], x[np.maximum(first - 1, 0)], row0[of]) for x in (end, start))
    out_n, out_m, out_d = (np.zeros(len(end), np.int64) for _ in range(3))
    total = np.array([count[a:b].sum() for a, b in zip(left, came, strict=True)], np.int64)
    guess, wide = np.zeros(len(of), np.int64), np.full(len(of), 1024)

    def rank_of(lanes, x):  # how many values of the lane's series are under x
        s = of[lanes]
        return np.searchsorted(keys, np.clip(x, low[s] - 1, high[s] + 1) + move[s], "left") - val0[s]

    def within(lanes, m2, r):  # how many cents c have |2c - m2| <= r
        a, b = rank_of(lanes, -((r - m2) // 2)), rank_of(lanes, (m2 + r) // 2 + 1)
        c = f.below(np.concatenate((lanes, lanes)), np.concatenate((a, b)))
        return c[len(lanes) :] - c[: len(lanes)]

    for k in range(int((last - first).max(initial=0))):
        on = np.flatnonzero(first + k < last)
        q = first[on] + k
        row, lane_of, n = [], [], []
        for at, upto, sign in ((came, end[q], 1), (left, start[q], -1)):  # the rows between where a pointer was and where it goes
            many = upto - at[on]
            to = np.cumsum(many)
            row.append(np.arange(to[-1]) + np.repeat(at[on] - to + many, many))
            lane_of.append(np.repeat(on, many))
            n.append(sign * count[row[-1]])
            at[on] = upto
        row, lane_of, n = map(np.concatenate, (row, lane_of, n))
        f.add(lane_of, rank[row], n)
        np.add.at(total, lane_of, n)
        n = total[on]
        out_n[q] = n
        some = n > 1
        on, q, n = on[some], q[some], n[some]
        if not len(on):
            continue
        k1, k2 = (n + 1) // 2, n // 2 + 1
        v = values[f.kth(np.concatenate((on, on)), np.concatenate((k1, k2))) + np.tile(val0[of[on]], 2)]
        m2 = v[: len(on)] + v[len(on) :]
        # bracket the radius of the k1 nearest from where it was a moment ago, by steps as large as its last change, then bisect
        r, step = guess[on], wide[on]
        up = within(on, m2, r) < k1
        lo, hi = np.where(up, r, -1), np.where(up, -1, r)
        open_ = np.arange(len(on))
        while len(open_):
            u = up[open_]
            to = np.where(u, lo[open_] + step[open_], np.maximum(hi[open_] - step[open_], -1))
            enough = within(on[open_], m2[open_], to) >= k1[open_]  # never at -1
            hi[open_[enough]], lo[open_[~enough]] = to[enough], to[~enough]
            step[open_] *= 4
            open_ = open_[enough != u]
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            enough = within(on[open_], m2[open_], mid) >= k1[open_]
            hi[open_[enough]], lo[open_[~enough]] = mid[enough], mid[~enough]
            open_ = open_[hi[open_] - lo[open_] > 1]
        wide[on] = np.abs(hi - r) + 4
        d1 = d2 = hi
        guess[on] = hi
        more = np.flatnonzero((k2 > k1) & (within(on, m2, hi) < k2))
        if len(more):  # the next farther one, on either side
            s, m, r = on[more], m2[more], hi[more]
            a, b = rank_of(s, -((r - m) // 2)), rank_of(s, (m + r) // 2 + 1)
            under, upto = f.below(s, a), f.below(s, b)
            far = np.full(len(more), np.iinfo(np.int64).max)
            for some, kk in ((under > 0, under), (upto < n[more], upto + 1)):
                x = values[f.kth(s[some], kk[some]) + val0[of[s[some]]]]
                far[some] = np.minimum(far[some], np.abs(2 * x - m[some]))
            d2 = hi.copy()
            d2[more] = far
        out_m[q], out_d[q] = m2, d1 + d2
    return [(x[a : a + len(s.asked)], y[a : a + len(s.asked)], z[a : a + len(s.asked)]) for s, a in zip(series, ask0, strict=True) for x, y, z in [(out_n, out_m, out_d)]]


def rolling(points: DataFrame, window: int = WINDOW, length: int = LONGEST, lane: int = LANE, block: int = BLOCK) -> DataFrame:
    """kind, us, n, median2, mad4 for each (kind, us) of the points (kind, us, cents, n)."""
    home = F.expr(f"us div {length} - IF(us % {length} < 0, 1, 0)")
    halos = -(-window // length)  # a later chunk needs the row if its first moment is at most a window away
    later = F.filter(F.array(*[F.lit(k) for k in range(1, halos + 1)]), lambda k: (F.col("home") + k) * length - F.col("us") <= window)
    dealt = points.withColumn("home", home).withColumn("late", F.explode(F.concat(F.array(F.lit(0)), later)))
    dealt = dealt.select("kind", (F.col("home") + F.col("late")).alias("chunk"), "us", F.coalesce("cents", F.lit(0)).alias("cents"), "n", (F.col("late") == 0).alias("own"))
    dealt = dealt.repartition("kind", "chunk").sortWithinPartitions("kind", "chunk", "us")

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows in order; the last group may go on
        size, done = 0, {"key": None, "us": None}

        def answer(final: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            kind, chunk, us, cents, n, own = (t.column(i) for i in range(6))
            us, cents, n, own, chunk = (x.to_numpy() for x in (us, cents, n, own, chunk))
            code = kind.combine_chunks().dictionary_encode(null_encoding="encode") if isinstance(kind, pa.ChunkedArray) else kind.dictionary_encode(null_encoding="encode")
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code)
            names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            edge = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1]), True])
            series, keys, keep = [], [], len(us)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                key, open_ = (names[code[a]], int(chunk[a])), b == len(us) and not final
                asked = np.unique(us[a:b][own[a:b]])
                if key == done["key"]:
                    asked = asked[asked > done["us"]]
                if open_:  # its last moment may go on in what comes
                    asked = asked[asked < us[b - 1]]
                    keep = a + int(np.searchsorted(us[a:b], us[b - 1] - window))
                    before = done["us"] if key == done["key"] else None
                    done.update(key=key, us=int(asked[-1]) if len(asked) else before if before is not None else -(1 << 62))
                if len(asked):
                    series.append(pieces(us[a:b], cents[a:b], n[a:b], asked, window))
                    keys.append(key[0])
            held = [b for b in t.slice(keep).to_batches()] if keep < len(us) else []
            size = sum(b.num_rows for b in held)
            if series:
                keys = [k for k, s in zip(keys, series, strict=True) for _ in s]
                series = [x for s in series for x in s]
                got = windows(series, lane)
                kinds = pa.array([k for k, s in zip(keys, series, strict=True) for _ in range(len(s.asked))], pa.string())
                n, m, d = (np.concatenate([g[i] for g in got]) for i in range(3))
                few = n < 2
                yield pa.RecordBatch.from_arrays([kinds, pa.array(np.concatenate([s.asked for s in series])), pa.array(n), pa.array(m, mask=few), pa.array(d, mask=few)], names=["kind", "us", "n", "median2", "mad4"])

        grow = 0  # a window of more rows than a block is waited for
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= block + 2 * grow:
                yield from answer(False)
                grow = size
        if held:
            yield from answer(True)

    return dealt.mapInArrow(trimmed(run), _OUT)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = clicks_once(table(spark, sf_dir, "clicks"))
    points = once.groupBy("kind", "us", "cents").agg(F.count("cents").alias("n"))
    got = rolling(points, length=chunk_length(table(spark, sf_dir, "clicks").select(F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("us")).filter("us IS NOT NULL")))
    got = got.select(F.col("kind").alias("k"), F.col("us").alias("u"), "n", "median2", "mad4")
    c, far = F.col("cents"), 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 3 * F.col("mad4")
    rows = once.join(got.hint("merge"), F.col("kind").eqNullSafe(F.col("k")) & (F.col("us") == F.col("u")))
    return rows.select("click_id", "kind", "n", "median2", "mad4", F.when(c.isNotNull(), far).alias("far"))


ORACLE = """
WITH once AS (SELECT DISTINCT click_id, ts, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents FROM clicks WHERE ts IS NOT NULL),
w AS (SELECT click_id, kind, cents, list_sort(list_filter(list(cents) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS l FROM once),
m AS (SELECT *, CAST(len(l) AS BIGINT) AS n, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] AS m2 FROM w),
d AS (SELECT *, list_sort(list_transform(l, lambda x: abs(2 * x - m2))) AS e FROM m)
SELECT click_id, kind, n, CASE WHEN n > 1 THEN m2 END AS median2, CASE WHEN n > 1 THEN e[(n + 1) // 2] + e[n // 2 + 1] END AS mad4,
    CASE WHEN n > 1 AND cents IS NOT NULL THEN 2 * abs(2 * cents - m2) > 3 * (e[(n + 1) // 2] + e[n // 2 + 1]) END AS far
FROM d
"""
