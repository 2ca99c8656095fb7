"""Sum-of-squares packing of documents into sequences of bounded length.

A document longer than a sequence is cut into full pieces, its first piece taking the remainder; full pieces fill
sequences alone. The others are placed one by one where the sum, over the residual gaps, of the squared counts of open
sequences becomes smallest (Csirik et al., J. ACM 2006). Groups of pieces are packed apart, then the sequences that
stayed poorly filled are opened and packed again in fewer groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import give_back, materialize
from voxelspan.llm.tokens import encoder, with_end

#: Pieces that are packed together.
GROUP = 32_768
#: A sequence with more than this share of it empty is packed again with those of other groups.
LOOSE = 1 / 256


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, slot of each piece; slot is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                ids, ends = with_end(*encoder(tokenizer).encode(some.column(1)), end_id)
                total = np.diff(ends)
                count = -(-total // capacity)
                first = total - (count - 1) * capacity
                doc = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                view, a = memoryview(ids.tobytes()), (ends[:-1][doc] + start) * 4
                crc = [zlib.crc32(view[i:j]) for i, j in zip(a.tolist(), (a + 4 * length).tolist())]
                columns = [some.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(at + np.arange(len(doc)))]
                at += len(doc)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])
        give_back()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all from 1 to capacity, placed in order of falling length."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by residual gap; gap 0 is closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gaps = n[s:]  # gap s + r leaves r
        rise = 2 * (n[: len(gaps)] - gaps)  # of the sum, but for a constant
        rise[0] -= 1  # a bin that closes leaves the sum
        rise[gaps == 0] = 1 << 40
        r = int(rise.argmin())
        if gaps[r]:  # an open bin that fits is always used before a new one
            b = stacks[s + r].pop()
            n[s + r] -= 1
        else:
            r, b = capacity - s, count
            count += 1
        bins[i], offsets[i] = b, capacity - s - r
        if r:
            stacks[r].append(b)
            n[r] += 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces() with sequence_id and offset instead of slot."""
    cut = materialize(cut)
    full = cut.where(F.col("length") == capacity).select("*", F.col("slot").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint, sequence_id bigint, offset bigint, loose boolean"

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        filled = np.bincount(bins, lengths)
        # a sequence is named by its first piece in slot order; full pieces name their own
        _, first = np.unique(bins, return_index=True)
        rows["sequence_id"], rows["offset"] = rows["slot"].to_numpy()[first][bins], offsets
        rows["loose"] = (capacity - filled > LOOSE * capacity)[bins]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "slot", "sequence_id", "offset", "loose"]]

    done = [full]
    n = rest.count()
    while True:
        groups = max(1, -(-n // GROUP))
        keyed = rest.withColumn("g", F.pmod(F.xxhash64("slot", F.lit(groups)), F.lit(groups)))
        placed = keyed.groupBy("g").applyInPandas(group, schema)
        if groups == 1:
            done.append(placed.drop("loose"))
            break
        placed = materialize(placed)
        done.append(placed.where("not loose").drop("loose"))
        rest = placed.where("loose").select("doc_id", "piece", "start", "length", "ids_crc32", "slot")
        before, n = n, rest.count()
        if n > 0.8 * before:  # nothing to gain from further rounds
            done.append(placed.where("loose").drop("loose"))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("slot")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    A null or empty text is the end id alone. Each row is a document, repeated ones and those without doc_id too.
    Other columns of docs are not looked at.
    """
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)
