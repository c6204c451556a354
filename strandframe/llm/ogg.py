"""Operator 7: Ogg. Payloads are muxed as one logical stream beside a small index stream, and demuxed with every check.

Null texts count as empty; each payload is the text's UTF-8 padded with bytes 255 to a positive multiple of 576, one
packet per 576 bytes. A page with a wrong checksum, a missing page or a packet left open raises ValueError. Equal
texts give equal bytes: serial numbers are fixed. Repeated rows and extra columns pass through; an empty table gives
no rows.
"""
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

UNIT, RATE, DATA, INDEX = 576, 8000, 0x53460001, 0x53460002
_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, not reflected, from 0: zlib's reflected one over bit-reversed bytes."""
    c = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, seq, 0) + bytes([len(lacing)]) + lacing
    raw = head + body
    return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets with the granule position at their end. A packet may run over pages."""
    segs: list[tuple] = []
    for p, g in packets:
        lace = _lacing(len(p))
        at = 0
        for j, v in enumerate(lace):
            segs.append((v, p[at : at + v], g if j == len(lace) - 1 else None))
            at += v
    out, seq, open_ = [], 0, False
    cut = [1, *range(1 + 255, len(segs), 255)] if len(_lacing(len(packets[0][0]))) == 1 else [*range(255, len(segs), 255)]
    for a, z in zip([0, *cut], [*cut, len(segs)], strict=True):
        part = segs[a:z]
        if not part:
            continue
        ends = [g for _, _, g in part if g is not None]
        kind = (1 if open_ else 0) | (2 if seq == 0 else 0) | (4 if z == len(segs) else 0)
        out.append(_page(kind, ends[-1] if ends else -1, serial, seq, bytes(v for v, _, _ in part), b"".join(x for _, x, _ in part)))
        open_ = part[-1][2] is None
        seq += 1
    return out


def mux(payload: bytes) -> bytes:
    n = len(payload) // UNIT
    data = pages(DATA, [(struct.pack("<8sIH", b"SFrawU8\0", RATE, UNIT), 0), *((payload[i * UNIT : (i + 1) * UNIT], (i + 1) * UNIT) for i in range(n))])
    index = pages(INDEX, [(b"SFindex\0", 0), (struct.pack("<QI", n, zlib.crc32(payload)), n)])
    return b"".join([data[0], index[0], *data[1:-1], *index[1:], data[-1]])


def demux(media: bytes) -> dict[int, dict]:
    """serial -> packets, granules (of each page that ends a packet) and pages; checksums, order and lacing are verified."""
    out: dict[int, dict] = {}
    at, end = 0, len(media)
    while at < end:
        magic, version, kind, granule, serial, seq, crc = struct.unpack_from("<4sBBqIII", media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        k = media[at + 26]
        lacing = media[at + 27 : at + 27 + k]
        body = at + 27 + k
        stop = body + sum(lacing)
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise ValueError(f"page {seq} of stream {serial}: wrong checksum")
        s = out.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if seq != s["pages"] or bool(kind & 2) != (seq == 0) or bool(kind & 1) != bool(s["open"]) or s["ended"]:
            raise ValueError(f"page {seq} of stream {serial}: out of order")
        s["pages"] += 1
        n = 0
        for v in lacing:
            n += v
            if v < 255:
                s["packets"].append(b"".join([*s["open"], media[body : body + n]]))
                s["open"], body, n = [], body + n, 0
        if n:
            s["open"].append(media[body : body + n])
        if granule >= 0:
            s["granules"].append(granule)
        s["ended"] = bool(kind & 4)
        at = stop
    for serial, s in out.items():
        if s.pop("open") or not s["ended"]:
            raise ValueError(f"stream {serial}: cut short")
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Ogg file of each whole text."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                ids, raws = b.column(0).slice(a, 256), [(t or "").encode() for t in b.column(1).slice(a, 256).to_pylist()]
                media = [mux(r + b"\xff" * (max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raws]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: bytes) -> tuple:
    """payload and feature string from the stored bytes."""
    s = demux(media)
    head, *units = s[DATA]["packets"]
    _, rate, unit = struct.unpack("<8sIH", head)
    payload = b"".join(units)
    n, crc = struct.unpack("<QI", s[INDEX]["packets"][1])
    if n != len(units) or crc != zlib.crc32(payload):
        raise ValueError("the index stream disagrees with the data")
    t = s[DATA]["granules"]
    return payload, f"streams={len(s)};pages={s[DATA]['pages'] + s[INDEX]['pages']};packets={len(units)};unit={unit};seconds={t[-1] / rate:.6f};first={t[min(1, len(t) - 1)] / rate:.6f};mean={sum(payload) / len(payload):.6f}"


def decode_media(media: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for m in b.column(2):
                raw = m.as_py()
                p, f = features(raw)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), f))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(table(spark, sf_dir, "documents")))
