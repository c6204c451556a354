"""Operator 1: token ids in seekable files.

File: one zstandard frame per group of documents (each decompresses alone), a skippable frame with the
document index, and a trailing seek table as in the public zstd seekable format (compressed size, raw size and the
low 32 bits of XXH64 of each frame, in a skippable frame that ends with its magic number). Every frame also carries
zstandard's own checksum. Nulls count as empty texts; an empty table gives no file; ties of doc_id stay in (doc_id,
text) order, nulls first.
"""
import functools
import io
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import parts_for, scratch, table
from ._words import trimmed

SKIP, INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
END_ID = 2


class ShardWriter:
    """Writes rows of ids to a binary file object."""

    def __init__(self, out, id_bytes: int = 2, frame_bytes: int = 1 << 20, level: int = 1):
        self.out, self.dtype, self.most = out, {2: "<u2", 4: "<u4"}[id_bytes], frame_bytes
        self.z = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.docs, self.buf, self.size, self.tokens = [], [], [], 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        if self.size and self.size + len(raw) > self.most:
            self._flush()
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(self.frames), self.size, len(ids)))
        self.buf.append(raw)
        self.size += len(raw)
        self.tokens += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.buf)
        packed = self.z.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.buf, self.size = [], 0

    def close(self) -> None:
        if self.buf:
            self._flush()
        a = np.array([(x[0], x[1], x[2], x[3], x[4]) for x in self.docs], dtype=_DOC)
        body = struct.pack("<B", np.dtype(self.dtype).itemsize) + self.z.compress(a.tobytes())
        self.out.write(struct.pack("<II", INDEX, len(body)) + body)
        table_ = b"".join(struct.pack("<III", *f) for f in [*self.frames, (8 + len(body), 0, _NOTHING)])  # the index is a skippable frame: it holds no data
        foot = struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIP, len(table_) + len(foot)) + table_ + foot)


_NOTHING = 0x51D8E999  # the low 32 bits of XXH64 of no bytes
_DOC = np.dtype([("doc_id", "<i8"), ("null", "?"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


class ShardReader:
    """Reads single documents; decompresses only the frames asked for and checks each one's checksum."""

    def __init__(self, f):
        self.f = f
        end = f.seek(0, io.SEEK_END)
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        f.seek(end - 9 - 12 * n)
        t = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
        self.table, self.at = t[:-1], np.r_[0, np.cumsum(t[:, 0].astype(np.int64))]
        f.seek(int(self.at[n - 1]) + 8)
        body = f.read(int(t[-1, 0]) - 8)
        self.dtype = {2: "<u2", 4: "<u4"}[body[0]]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), _DOC)
        self.kept = (None, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.kept[0] != k:
            self.f.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k}: wrong checksum")
            self.kept = (k, raw)
        return self.kept[1]

    def places(self, doc_id: int) -> range:
        """Places of the documents with this id; shards are in ascending order of ids, nulls first."""
        nulls = int(self.docs["null"].sum())
        known = self.docs["doc_id"][nulls:]
        return range(nulls + int(np.searchsorted(known, doc_id)), nulls + int(np.searchsorted(known, doc_id, "right")))

    def ids(self, i: int) -> np.ndarray:
        d = self.docs[i]
        return np.frombuffer(self.frame(int(d["frame"])), self.dtype, int(d["n"]), int(d["at"]))


#: the tokenizer's pattern for texts of ASCII and Latin-1 letters, digits, spaces and marks
LETTERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", " \\t\\n\\r\\f\\v"
PLAIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class Encoder:
    """The tokenizer, with the pieces it splits a text into kept once encoded: a piece's ids depend on the piece alone."""

    def __init__(self, tokenizer_path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(tokenizer_path)
        self.any_split, self.plain_split = regex.compile(public_tokenizers.PATTERN).findall, re.compile(PLAIN).findall
        self.plain = re.compile(f"[{LETTERS}0-9{SPACES}!-/:-@\\[-`{{-~]*").fullmatch
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers, so that a text's are joined without a loop
        self.keep = keep

    def pieces(self, text: str) -> list[str]:
        """The tokenizer's split; of plain letters by the faster of two engines, whose classes are the same there."""
        return self.plain_split(text) if self.plain(text) else self.any_split(text)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4")
        known, pieces = self.known, self.pieces(text)
        try:
            raw = b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            miss = [x for x in set(pieces) if x not in known]
            known.update(zip(miss, (np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(miss, add_special_tokens=False)), strict=True))
            raw = b"".join(map(known.__getitem__, pieces))
        return np.frombuffer(raw, "<u4")


@functools.lru_cache(1)
def encoder(tokenizer_path: str) -> Encoder:
    """One for all tasks of a worker, so that its known pieces last."""
    return Encoder(tokenizer_path)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID) -> DataFrame:
    """Encode every row's whole text and write one shard per range of doc_id under `out`; one row per shard."""
    n = parts_for(docs)

    def run(batches):
        from pyarrow import fs

        enc, part, writer = encoder(tokenizer_path), TaskContext.get().partitionId(), None
        where, base = fs.FileSystem.from_uri(out)
        name = f"{base}/shard-{part:06d}.zst"
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if writer is None:
                    where.create_dir(base)
                    f = where.open_output_stream(temp)
                    writer = ShardWriter(f)
                writer.add(i.as_py(), np.append(enc(t.as_py() or ""), np.uint32(end_id)))
        if writer:
            writer.close()
            f.close()
            where.move(temp, name)  # a task that runs twice leaves one whole file
            yield pa.RecordBatch.from_pydict({"shard": [part], "n_docs": [len(writer.docs)], "n_ids": [writer.tokens]}, schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(trimmed(run), "shard long, n_docs long, n_ids long")
    manifest.write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.parquet(f"{out}/manifest")


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    # one row per shard, so the running sum is over the number of files only
    starts = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids"))
    n = max(1, manifest.count())

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(out)
        for b in batches:
            for shard, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{base}/shard-{shard:06d}.zst") as f:
                    r = ShardReader(f)
                    crc = [zlib.crc32(r.ids(i).astype("<u4").tobytes()) for i in range(len(r.docs))]
                    n_ = r.docs["n"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs["doc_id"].astype(np.int64), mask=r.docs["null"]), pa.array(before + np.cumsum(n_) - n_), pa.array(n_), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("shard", "before").repartition(n, "shard").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), out), out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))
