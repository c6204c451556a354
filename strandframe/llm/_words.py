"""Words of whole Arrow text columns as 64-bit hashes, by array operations on the UTF-8 bytes."""
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def _release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run):
    """run, for mapInArrow: what a task has freed goes back to the system when it ends, as its worker stays for other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(ranges) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and [^\x20\x09-\x0D]+ hold for bytes too: every byte of a non-ASCII code point is over 0x7F.
ALNUM = _class([(0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
NONSPACE = _class([(0x20, 0x20), (0x09, 0x0D)])


@functools.lru_cache(2)
def _powers(n: int):
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_P, _INV))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, most: int = 1 << 20):
    """(first row, rows, bytes, row offsets) of runs of rows of about `most` bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray):
    """Starts and ends of the words in the bytes, their hashes, and the first word of each row (rows + 1 values)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = LOWER[data]
    is_word = kind[low]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    prev = np.r_[False, is_word[:-1]]
    starts = np.flatnonzero(is_word & (~prev | cut[:-1]))
    ends = np.flatnonzero(is_word & (~np.r_[is_word[1:], False] | cut[1:])) + 1
    size = 1 << max(20, int(n).bit_length())
    pw, inv = _powers(size)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[:n], out=c[1:])
        h = mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, h, np.searchsorted(starts, off)


def word_hash(word: str, kind: np.ndarray = ALNUM) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]), kind)[2][0])
