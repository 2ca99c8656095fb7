"""Token ids in one compressed file per shard: a wavelet matrix (Claude, Navarro and Ordóñez, Inf. Syst. 2015).

A shard holds the ids of documents in ascending doc_id order. Its distinct ids get ranks; bit-plane k holds bit k of
every rank in the order that the planes above give, zeros before ones. With the counts of ones before each block,
any id is read, counted and located in one step per plane, touching one block of each.

File: MAGIC, length of the header (u64), header (JSON), sections. Every section is zstd-compressed. Planes are cut
into blocks of BLOCK bits with the ones before each, so that a lookup decompresses one small block a plane.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.llm.common import materialize, shared_dir
from voxelspan.llm.tokens import encoder, with_end

MAGIC = b"VXWM0001"
BLOCK = 1 << 15
#: Bytes of text that a shard should hold.
SHARD_BYTES = 24 << 20


def build(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """The file for ids; document i has ids[ends[i]:ends[i + 1]]."""
    ids = np.asarray(ids, np.uint32)
    present = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    rank_of = np.zeros(int(present[-1]) + 1 if len(present) else 0, np.uint32)
    rank_of[present] = np.arange(len(present))
    x = rank_of[ids].astype(np.uint16 if len(present) <= 1 << 16 else np.uint32) if len(ids) else ids
    levels = max(1, int(len(present) - 1).bit_length()) if len(present) else 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections, planes, at = [], [], 0

    def put(data: bytes) -> list[int]:
        nonlocal at
        sections.append(squeeze(data))
        at += len(sections[-1])
        return [at - len(sections[-1]), at]

    for level in range(levels - 1, -1, -1):
        bits = (x >> level & 1).astype(bool)
        blocks, ones = [], [0]
        for a in range(0, len(bits), BLOCK):
            part = bits[a : a + BLOCK]
            blocks.append(put(np.packbits(part, bitorder="little").tobytes()))
            ones.append(ones[-1] + int(np.count_nonzero(part)))
        planes.append({"blocks": blocks, "ones": ones})
        x = np.concatenate([x[~bits], x[bits]])
    header = {
        "n": len(ids), "levels": levels, "planes": planes,
        "alphabet": put(present.astype("<u4").tobytes()), "ends": put(np.asarray(ends, "<i8").tobytes()),
        "docs": put(json.dumps(doc_ids).encode()),
    }
    head = json.dumps(header, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *sections])


class Shard:
    """A shard's file, opened: read(offset, length) returns its bytes; only what a call needs is read."""

    def __init__(self, read):
        start = read(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<Q", start[8:])[0]
        self._read, self._base = read, 16 + size
        header = json.loads(read(16, size))
        self.n, self.levels, self._planes = header["n"], header["levels"], header["planes"]
        self.zeros = [self.n - p["ones"][-1] for p in self._planes]
        self._unzip = zstandard.ZstdDecompressor().decompress
        self.alphabet = np.frombuffer(self._section(header["alphabet"]), "<u4")
        self.ends = np.frombuffer(self._section(header["ends"]), "<i8")
        self.doc_ids = json.loads(self._section(header["docs"]))
        self._held: dict = {}
        self._sums: dict = {}

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda offset, length: data[offset : offset + length])

    def _section(self, span: list[int]) -> bytes:
        return self._unzip(self._read(self._base + span[0], span[1] - span[0]))

    def _block(self, level: int, k: int) -> np.ndarray:
        """Block k of a plane, eight bits a byte; the last few hundred blocks are kept."""
        if (level, k) not in self._held:
            if len(self._held) >= 512:
                self._held.pop(next(iter(self._held)))
            self._held[level, k] = np.frombuffer(self._section(self._planes[level]["blocks"][k]), np.uint8)
        return self._held[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        k, r = divmod(i, BLOCK)
        ones = self._planes[level]["ones"][k]
        if not r:
            return ones
        block, whole = self._block(level, k), r >> 3
        rest = int(block[whole]) & (1 << (r & 7)) - 1 if r & 7 else 0
        return ones + int(np.bitwise_count(block[:whole]).sum(dtype=np.int64)) + rest.bit_count()

    def _before(self, level: int, bit: int) -> np.ndarray:
        """How many of the bit a plane has before each of its blocks, and in all."""
        if (level, bit) not in self._sums:
            ones = np.array(self._planes[level]["ones"])
            self._sums[level, bit] = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        return self._sums[level, bit]

    def _select(self, level: int, bit: int, r: int) -> int:
        """Place of the bit's occurrence number r (from 0) in a plane."""
        before = self._before(level, bit)
        k = int(np.searchsorted(before, r, "right")) - 1
        bits = np.unpackbits(self._block(level, k), count=min(BLOCK, self.n - k * BLOCK), bitorder="little")
        return k * BLOCK + int(np.flatnonzero(bits == bit)[r - before[k]])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            k, r = divmod(i, BLOCK)
            bit, ones = int(self._block(level, k)[r >> 3]) >> (r & 7) & 1, self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _rank_of(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _interval(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.levels):
            p, q = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + p, self.zeros[level] + q) if value >> (self.levels - 1 - level) & 1 else (a - p, b - q)
        return a, b

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often token stands in places start to stop."""
        value = self._rank_of(token)
        if value is None:
            return 0
        a, b = self._interval(value, max(0, start), self.n if stop is None else min(stop, self.n))
        return max(0, b - a)

    def locate(self, token: int, k: int) -> int:
        """Place of occurrence number k (from 0) of token."""
        value = self._rank_of(token)
        if value is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._interval(value, 0, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each plane's order is undone by its own bits."""
        x = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            spans = self._planes[level]["blocks"]  # one after another in the file: a plane is read at once
            first = spans[0][0] if spans else 0
            raw = self._read(self._base + first, spans[-1][1] - first) if spans else b""
            plane = b"".join(self._unzip(raw[a - first : b - first]) for a, b in spans)
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(x)
            above[~bits] = x[: self.zeros[level]]
            above[bits] = x[self.zeros[level] :] | np.array(1 << (self.levels - 1 - level), x.dtype)
            x = above
        return self.alphabet[x].astype(np.uint32) if self.n else np.zeros(0, np.uint32)


def open_shard(uri: str) -> Shard:
    """The shard in any store that pyarrow reads, block by block."""
    store, path = pafs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    return Shard(lambda offset, length: file.read_at(length, offset))


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns their manifest: shard, uri, n_docs, n_tokens, and base, the ids before the shard.

    Shards are ranges of ascending doc_id, rows without doc_id first, rows of one doc_id in order of their texts. A
    file is written under another name and then renamed, so a task that is run again leaves the same one.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc_ids, ends = [], [], [np.zeros(1, np.int64)]
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                i, e = with_end(*encoder(tokenizer).encode(some.column(1)), end_id)
                ids.append(i)
                ends.append(e[1:] + ends[-1][-1])
                doc_ids += some.column(0).to_pylist()
        if not doc_ids:
            return
        shard, flat = TaskContext.get().partitionId(), np.concatenate(ids)
        ids.clear()
        store, path = pafs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.wm")
        draft = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(build(flat, doc_ids, np.concatenate(ends)))
        store.move(draft, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [f"{folder}/shard-{shard:06d}.wm"], "n_docs": [len(doc_ids)], "n_tokens": [len(flat)]}, pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(run, "shard int, uri string, n_docs bigint, n_tokens bigint"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(uri)
                data, ends = memoryview(shard.decode().tobytes()), shard.ends
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("uri", "base").repartition(max(1, manifest.count()))
    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """write() and read(): a row for each row of docs; a null or empty text is the end id alone."""
    return read(write(docs, tokenizer, end_id))
