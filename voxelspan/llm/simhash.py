"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through pigeonhole blocks.

Fingerprints that differ in at most d bits agree on at least b - d of b blocks, so both stand in the bucket of some
choice of b - d blocks; b grows with the number of fingerprints, so that buckets don't. Buckets are verified by Hamming distance in tiles of bounded size; a tile returns a spanning forest
of the links it found, never all pairs, and connected components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.llm.common import connected_components, materialize

#: Fingerprints of a bucket that one tile's side holds; larger buckets are cut into tiles, all of which are verified.
TILE = 256


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a bigint) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def blocks_for(count: int, max_bits: int) -> int:
    """Blocks to cut fingerprints into: as few as keep the expected bucket of ``count`` fingerprints below a tile.

    Of b blocks at least b - max_bits agree, so a key has 64 * (b - max_bits) / b bits: 21 with 6 blocks and 15 keys, 27
    with 7 and 35, 32 with 8 and 70. Any number gives the same links.
    """
    b = max_bits + 2
    while b < 16 and count > TILE << int(64 * (b - max_bits) / b):
        b += 1
    return b


def block_masks(max_bits: int, blocks: int | None = None) -> list[int]:
    """One mask for each choice of all but max_bits of the blocks, as signed 64-bit numbers."""
    blocks = blocks or max_bits + 2
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    each = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(each, blocks - max_bits))]


def forest(points: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(point, root) for each point that is linked, directly or through others, to a smaller one."""
    if len(points) == 2:
        a, b = points
        return [(int(max(a, b)), int(min(a, b)))] if a != b and (int(a ^ b) & (1 << 64) - 1).bit_count() <= max_bits else []
    points = np.unique(points)
    near = np.bitwise_count((points[:, None] ^ points[None, :]).view(np.uint64)) <= max_bits
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(points[i]), int(points[j])) for i, j in enumerate(label) if i != j]


def links(distinct: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Column fp, each once, to a, b: links whose components are those of all pairs within max_bits bits."""
    blocks = blocks or blocks_for(distinct.count(), max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(max_bits, blocks))]))
    keyed = distinct.select("fp", keys.alias("k")).select("fp", "k.c", "k.v")
    sizes = materialize(keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1"))
    tiled = keyed.join(sizes, ["c", "v"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("fp", F.hash("c", "v", F.least("t", "o"), F.greatest("t", "o")).alias("h"), "c", "v", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last tile seen so far: at most 2 * TILE or so
        last = None

        def out(parts: list[np.ndarray]) -> list[tuple[int, int]]:
            return forest(np.concatenate(parts) if len(parts) > 1 else parts[0], max_bits)

        for batch in batches:
            fp = batch.column(0).to_numpy()
            cols = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(1, 5)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1, [len(fp)]])
            pairs: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = tuple(cols[a].tolist())
                if key != last and held:
                    pairs += out(held)
                    held = []
                last = key
                held.append(fp[a:b])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])
        if held and (pairs := out(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    spread = tiled.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")
    return spread.select("fp", "c", "v", "i", "j").mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """doc_id and fp of each row, and each fingerprint's group: fp, root, component_id (the group's smallest doc_id)."""
    marked = materialize(fingerprints(docs, shingle, seed))
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(firsts.select("fp"), max_bits))
    return marked, named_groups(firsts, parts)


def named_groups(firsts: DataFrame, parts: DataFrame) -> DataFrame:
    """fp, root and component_id from fp and first, and node and root of those fps that have links.

    Both sides of the join on root are written first, so that the partition of a large group can be cut up.
    """
    rooted = materialize(firsts.join(parts, firsts["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of docs.

    Null or wordless texts have fingerprint zero and are linked like any other. A row without doc_id keeps its row,
    its component the smallest doc_id that is there, null if there is none. Repeated rows each return a row. Columns
    of docs other than doc_id and text are not looked at.
    """
    marked, named = groups(docs, max_bits, shingle, seed)
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, marked: DataFrame, named: DataFrame, mark: Callable[[str | None], int]) -> DataFrame:
    """Of each group one row of docs stays: its smallest doc_id's.

    marked holds doc_id and fp of each row, named the groups of the fps, mark gives a text's fp. Of rows with that same
    doc_id in one group, the one whose other columns sort first stays. Rows without a doc_id can't be named by a result
    keyed on it and always stay.
    """
    named = materialize(named.where("component_id is not null"))
    there = marked.where("doc_id is not null").join(named, "fp")
    keep = there.groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_n"), F.max(F.col("doc_id") == F.col("component_id")).alias("_first"))
    keep = materialize(keep.where("_first").select("_keep", "_n"))
    out = docs.where("doc_id is not null").join(keep.where("_n = 1"), F.col("doc_id") == F.col("_keep"), "left_semi")
    if not keep.where("_n > 1").isEmpty():  # rows of one doc_id may belong to several groups: their texts tell which
        order = [F.col(f"`{c}`").cast("string") for c in docs.columns]
        again = docs.join(keep.where("_n > 1"), F.col("doc_id") == F.col("_keep"), "left_semi")
        again = again.withColumn("_mark", F.udf(mark, "bigint")(F.col("text").cast("string")))
        of = named.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_least"))
        again = again.join(of, (F.col("_mark") == F.col("_fp")) & (F.col("doc_id") == F.col("_least")))
        again = again.withColumn("_r", F.row_number().over(Window.partitionBy("_root", "doc_id").orderBy(*order)))
        out = out.unionByName(again.where("_r = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.unionByName(docs.where("doc_id is null"))


def deduplicate(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Of each group of near-duplicates one row of docs stays, chosen as survivors() says."""

    def mark(text: str | None) -> int:
        fp = fingerprint(text, shingle, seed)
        return fp - (1 << 64) if fp >> 63 else fp

    return survivors(docs, *groups(docs, max_bits, shingle, seed), mark)
