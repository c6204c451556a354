"""Rigid superposition and alignment of two chains in frames of their own, in numpy, for many pairs and seeds at a time.

Fragments of both chains are laid on each other, each seed is aligned and scored at once, and the best is refined: the
superposition of what is near and the alignment under it follow each other until the score stands still.

Pairs of the same two lengths go through all steps together: points are (axis, place, pair), so that each operation runs
along pairs; a step takes as many as BLOCK elements hold, and what it keeps of a pair is its best alone."""
import numpy as np

#: fixed values: the published scale of distances by length, the reach of near pairs and the widths around them
FRAGMENTS = ((20, 3), (100, 2))
JUMPS = ((250, 45), (200, 35), (150, 25), (0, 15))
GAP_PRICES = (-0.6, 0.0)
ROUNDS, SEARCH_STEP = 20, 40
BLOCK = 1_000_000
SWEEPS = 12


def scale(length: int) -> float:
    """d0 of the final score."""
    return 0.5 if length <= 21 else max(0.5, 1.24 * (length - 15) ** (1 / 3) - 1.8)


def search_scale(length: int) -> float:
    return (0.168 if length <= 19 else 1.24 * (length - 15) ** (1 / 3) - 1.8) + 0.8


def reach(d0: float) -> float:
    return min(8.0, max(4.5, d0))


def far(length: int) -> float:
    """Pairs farther than this are no part of the result."""
    return 1.5 * length**0.3 + 3.5


def _rotations(cov: np.ndarray) -> np.ndarray:
    """The rotations (3, 3, k) that covariances (3, 3, k) ask for. Their columns are turned until they are at right angles; the shortest gives way to the cross product, so there is no mirror image.

    Where all points lie on a line the rotation is open, and singular values choose it."""
    w = np.concatenate([cov.transpose(1, 0, 2), np.broadcast_to(np.eye(3)[:, :, None], cov.shape)], 1)  # (column, row; below them the turns)
    with np.errstate(all="ignore"):
        for _ in range(SWEEPS):
            still = True
            for p, q in ((0, 1), (0, 2), (1, 2)):
                b, c = w[p, :3], w[q, :3]
                one, other, both = (b * b).sum(0), (c * c).sum(0), (b * c).sum(0)
                still = still and bool((both * both <= 1e-20 * one * other).all())
                off, both = other - one, 2 * both
                t = np.copysign(both, both * np.copysign(1.0, off)) / (np.abs(off) + np.sqrt(off * off + both * both))
                t[~np.isfinite(t)] = 0
                cos = 1 / np.sqrt(1 + t * t)
                sin = cos * t
                w[p], w[q] = cos * w[p] - sin * w[q], sin * w[p] + cos * w[q]
            if still:
                break
        size = np.sqrt((w[:, :3] * w[:, :3]).sum(1))
        u = w[:, :3] / size[:, None]
        least = size.argmin(0)
        for z in range(3):
            a, b = u[(z + 1) % 3], u[(z + 2) % 3]
            u[z] = np.where(least == z, np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]), u[z])
        turn = (w[:, 3:, None] * u[:, None]).sum(0)
    line = np.flatnonzero(~(np.sort(size, 0)[1] > 1e-12 * size.max(0)))
    if len(line):
        u, _, vt = np.linalg.svd(cov[:, :, line].transpose(2, 0, 1))
        u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
        turn[:, :, line] = (u @ vt).transpose(2, 1, 0)
    return turn


def _superposed(x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (3, 3, k) and shifts (3, k) that lay the points x (3, n, k) on y where on (n, k) holds."""
    n, w = np.maximum(on.sum(0), 1), x * on
    mx, my = w.sum(1) / n, (y * on).sum(1) / n
    turn = _rotations(np.stack([[(w[i] * y[j]).sum(0) - n * mx[i] * my[j] for j in range(3)] for i in range(3)]))
    return turn, my - (turn * mx).sum(1)


def _laid(x: np.ndarray, turn: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x (3, n, k) after the rotations and shifts."""
    return np.stack([turn[i, 0] * x[0] + turn[i, 1] * x[1] + turn[i, 2] * x[2] + shift[i] for i in range(3)])


def _apart(x: np.ndarray, y: np.ndarray, turn: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Squared distances (n, k) of x laid on y."""
    d = _laid(x, turn, shift)
    d -= y
    d *= d
    return d.sum(0)


def superpose(x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (k, 3, 3) and shifts (k, 3) that lay the points x (n, 3) on y (n, 3) where on (k, n) holds."""
    turn, shift = _superposed(x.T[:, :, None], y.T[:, :, None], on.T)
    return turn.transpose(2, 0, 1), shift.T


def moved(x: np.ndarray, turn: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.einsum("kij,nj->kni", turn, x) + shift[:, None, :]


def _near(d2: np.ndarray, d: float) -> np.ndarray:
    """Points within d, by columns; where they are fewer than three, d is widened by halves until they are not."""
    on = d2 <= d * d
    if len(d2) > 3 and len(few := np.flatnonzero(on.sum(0) < 3)):
        third = np.partition(d2[:, few], 2, axis=0)[2]
        wide = d + np.ceil(2 * (np.sqrt(third) - d)) / 2
        on[:, few] = d2[:, few] <= np.maximum(wide * wide, third)
    return on


def _distinct(pair: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's different columns of on, in order."""
    bits = np.packbits(on, axis=0)
    bits = np.ascontiguousarray(np.concatenate([bits, np.zeros((-len(bits) % 8, len(pair)), np.uint8)]).T).view(">u8").T.astype(np.uint64)
    by = np.lexsort((*bits[::-1], pair))
    pair, bits = pair[by], bits[:, by]
    first = np.ones(len(by), bool)
    first[1:] = (np.diff(pair) != 0) | (bits[:, 1:] != bits[:, :-1]).any(0)
    return pair[first], on[:, by[first]]


def _tops(pair: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of each pair, which stand together, the place of its first greatest score."""
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    at = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, start), np.diff(start, append=len(pair))))
    return at[np.flatnonzero(np.diff(pair[at], prepend=-1))]


def _blocks(pairs: int, each: int, size: int):
    """(pair, number under each) of pairs * each items, by portions of BLOCK elements of which an item takes size."""
    per = max(1, BLOCK // size)
    for lo in range(0, pairs * each, per):
        yield np.divmod(np.arange(lo, min(lo + per, pairs * each)), each)


def _best(x: np.ndarray, y: np.ndarray, d0: float, norm: float, step: int = 1, cut: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_superposition of pairs (3, n, pair): scores, rotations (3, 3, pair) and shifts (3, pair)."""
    n, pairs, d = *x.shape[1:], reach(d0)
    sizes = []
    for k in range(6):
        sizes.append(max(min(4, n), n >> k if k < 5 else 4))
        if sizes[-1] <= 4:
            break
    seeds = np.array(sorted({(s, a) for s in sizes for a in (*range(0, n - s, step), n - s)}))
    at = np.arange(n)[:, None]
    best, turns, shifts = np.full(pairs, -1.0), np.zeros((3, 3, pairs)), np.zeros((3, pairs))
    for pair, k in _blocks(pairs, len(seeds), n):
        size, a = seeds[k].T
        on = (at >= a) & (at < a + size)
        for r in range(ROUNDS + 1):
            p, q = x[:, :, pair], y[:, :, pair]
            turn, shift = _superposed(p, q, on)
            d2 = _apart(p, q, turn, shift)
            s = np.where(d2 <= cut * cut, 1 / (1 + d2 / d0**2), 0).sum(0) / norm
            top = _tops(pair, s)
            top = top[s[top] > best[pair[top]]]
            best[pair[top]], turns[:, :, pair[top]], shifts[:, pair[top]] = s[top], turn[:, :, top], shift[:, top]
            new = _near(d2, d - 1 if r == 0 else d + 1)
            go = (new != on).any(0)
            if not go.any():
                break
            pair, on = _distinct(pair[go], new[:, go])
    return best, turns, shifts


def best_superposition(x: np.ndarray, y: np.ndarray, d0: float, norm: float, step: int = 1, cut: float = np.inf) -> tuple[float, np.ndarray, np.ndarray]:
    """(score, rotation, shift): the best of sum 1 / (1 + (d / d0)**2) / norm over matched points, those beyond cut not counted.

    Seeds are runs of all, a half, a quarter ... of the points, at least four, `step` apart; each is refined by what lies near."""
    best, turn, shift = _best(x.T[:, :, None], y.T[:, :, None], d0, norm, step, cut)
    return float(best[0]), turn[:, :, 0], shift[:, 0]


def match(score: np.ndarray, price: float = 0.0) -> np.ndarray:
    """Monotone matches (k, rows: place in the second or -1) of the greatest sum, of cell scores (k, rows, columns); leaving a match for a gap costs `price`, ends are free.

    The table is filled by diagonals, of all k at once; matches win ties, then gaps along a row."""
    return _match(np.ascontiguousarray(score.transpose(1, 2, 0)), price)


def _match(score: np.ndarray, price: float) -> np.ndarray:
    """match of cells (rows, columns, k); of the table only two diagonals are kept, by rows."""
    n, m, k = score.shape
    cells = score.reshape(n * m, k)
    hit, side = np.zeros((n + 1, m + 1, k), bool), np.zeros((n + 1, m + 1, k), bool)
    hits, sides = hit.reshape(-1, k), side.reshape(-1, k)
    before, last, left_last = (np.zeros((n + 1, k)) for _ in range(3))  # left_last: what leaving the last diagonal gives
    for t in range(2, n + m + 1):
        lo, hi = max(1, t - m), min(n, t - 1)
        diag = before[lo - 1 : hi] + cells[(lo - 1) * m + t - lo - 1 : (hi - 1) * m + t - hi : max(m - 1, 1)]
        up, left = left_last[lo - 1 : hi], left_last[lo : hi + 1]
        here = slice(lo * m + t, hi * m + t + 1, m)  # row i, column t - i of m + 1
        gap = np.maximum(up, left)
        h = diag >= gap
        hits[here], sides[here] = h, left >= up
        before, last = last, before  # its rows are overwritten, none outside them is read again
        np.maximum(diag, gap, out=last[lo : hi + 1])
        if price:
            left_last = last.copy()
            left_last[lo : hi + 1] += price * h
        else:
            left_last = last
    out, i, j, live = np.full((k, n), -1), np.full(k, n), np.full(k, m), np.arange(k)
    while len(live):
        a, b = i[live], j[live]
        h, s = hit[a, b, live], side[a, b, live]
        out[live[h], a[h] - 1] = b[h] - 1
        i[live] -= h | ~s
        j[live] -= h | s
        live = live[(i[live] > 0) & (j[live] > 0)]
    return out


def _under(x: np.ndarray, y: np.ndarray, turn: np.ndarray, shift: np.ndarray, d0: float, price: float) -> np.ndarray:
    """The matches (k, rows) of x (3, n, k), so laid, with y (3, m, k)."""
    cells = np.zeros((x.shape[1], *y.shape[1:]))
    for a, b in zip(_laid(x, turn, shift), y, strict=True):
        d = a[:, None] - b
        d *= d
        cells += d
    cells /= d0**2
    cells += 1
    return _match(np.divide(1, cells, out=cells), price)


def _matched(x: np.ndarray, y: np.ndarray, to: np.ndarray):
    """By the number of matches, from three on: which of the matches to (k, rows) have it, and their matched points of x and y (3, n, k), each (3, number, those)."""
    n = (to >= 0).sum(1)
    for c in np.unique(n[n >= 3]):
        k = np.flatnonzero(n == c)
        i = np.nonzero(to[k] >= 0)[1].reshape(-1, c)
        j = to[k[:, None], i]
        yield k, np.ascontiguousarray(x[:, i.T, k]), np.ascontiguousarray(y[:, j.T, k])


def _fast(x: np.ndarray, y: np.ndarray, to: np.ndarray, d0: float) -> np.ndarray:
    """The scores of matches after three rounds of superposition."""
    best = np.zeros(len(to))
    for k, p, q in _matched(x, y, to):
        on = np.ones(p.shape[1:], bool)
        for r in range(3):
            d2 = _apart(p, q, *_superposed(p, q, on))
            best[k] = np.maximum(best[k], (1 / (1 + d2 / d0**2)).sum(0))
            on = _near(d2, reach(d0) + (r > 0))
    return best


def _seed_matches(x: np.ndarray, y: np.ndarray, d0: float) -> np.ndarray:
    """The best match (pair, rows) under superposed fragments of the two chains of each pair; without any, -1 in all rows."""
    n, m, pairs = x.shape[1], y.shape[1], x.shape[2]
    best, out = np.zeros(pairs), np.full((pairs, n), -1)
    jump = [max(1, min(next(j for top, j in JUMPS if c > top or top == 0), c // 3)) for c in (n, m)]
    for most, part in FRAGMENTS:
        size = min(most, min(n, m) // part)
        if size < 1:
            continue
        starts = np.array([(a, b) for a in range(0, n - size + 1, jump[0]) for b in range(0, m - size + 1, jump[1])])
        run = np.arange(size)[:, None]
        for pair, k in _blocks(pairs, len(starts), n * m):
            a, b = starts[k].T
            turn, shift = _superposed(x[:, a + run, pair], y[:, b + run, pair], np.ones((size, len(k)), bool))
            p, q = x[:, :, pair], y[:, :, pair]
            to = _under(p, q, turn, shift, d0 + 1.5, 0.0)
            s = _fast(p, q, to, d0)
            top = _tops(pair, s)
            top = top[s[top] > best[pair[top]]]
            best[pair[top]], out[pair[top]] = s[top], to[top]
    return out


def path_of(to: np.ndarray, columns: int) -> str:
    """M, D (a place of the first alone) and I of a match."""
    out, j = [], 0
    for t in to.tolist():
        if t < 0:
            out.append("D")
        else:
            out.append("I" * (t - j) + "M")
            j = t + 1
    return "".join(out) + "I" * (columns - j)


def tm_align(x: np.ndarray, y: np.ndarray) -> tuple[float, float, int, str] | None:
    """(tm, rmsd, pairs, path) of chain x on chain y (place, axis), or None where no fragment matches.

    tm is a share of y's length, so it depends on which chain comes first."""
    return tm_aligns(x[None], y[None])[0]


def tm_aligns(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float, int, str] | None]:
    """tm_align of each pair of chains x (pair, place, axis) and y, which have one length on each side."""
    n, m, pairs = x.shape[1], y.shape[1], len(x)
    least = min(n, m)
    if least < 3:
        return [None] * pairs
    x, y = (np.ascontiguousarray(c.transpose(2, 1, 0)) for c in (x, y))
    d0, cut = search_scale(least), far(least)
    to = _seed_matches(x, y, d0)
    best, first = np.full(pairs, -1.0), (np.zeros((3, 3, pairs)), np.zeros((3, pairs)))
    for k, p, q in _matched(x, y, to):
        best[k], first[0][:, :, k], first[1][:, k] = _best(p, q, d0, least, SEARCH_STEP, cut)
    for price in GAP_PRICES:
        turn, shift = (c.copy() for c in first)
        live = np.flatnonzero(best >= 0)
        for _ in range(2):
            new = np.full((pairs, n), -1)
            for k, _ in _blocks(len(live), 1, n * m):
                at = live[k]
                new[at] = _under(x[:, :, at], y[:, :, at], turn[:, :, at], shift[:, at], d0, price)
            for k, p, q in _matched(x, y, new):
                s, turn[:, :, k], shift[:, k] = _best(p, q, d0, least, SEARCH_STEP, cut)
                up = s > best[k]
                best[k[up]], to[k[up]] = s[up], new[k[up]]
            live = live[(new[live] >= 0).sum(1) >= 3]
    # the matches stand; only pairs that come near enough count
    for k, p, q in _matched(x, y, to):
        _, turn, shift = _best(p, q, d0, least, 1, cut)
        row, i = np.nonzero(to[k] >= 0)
        apart = np.sqrt(_apart(p, q, turn, shift)).T.ravel() > cut
        to[k[row[apart]], i[apart]] = -1
    out: list = [None] * pairs
    for k, p, q in _matched(x, y, to):
        rmsd = np.sqrt(_apart(p, q, *_superposed(p, q, np.ones(p.shape[1:], bool))).mean(0))
        tm = _best(p, q, scale(m), m, 1)[0]
        for at, *row in zip(k.tolist(), tm.tolist(), rmsd.tolist(), strict=True):
            out[at] = (*row, p.shape[1], path_of(to[at], m))
    return out
