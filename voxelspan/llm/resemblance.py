"""Near copies by resemblance: texts whose sets of word shingles have a Jaccard similarity of at least some bound.

SimHash comes first: texts whose 64-bit fingerprints of those shingles differ in at most MAX_BITS bits are candidates. At
the bound 0.8 fingerprints differ in more bits than pigeonhole blocks can reach, so what SimHash leaves apart are
candidates if they agree on a band of MinHash values. Each candidate is verified on the whole shingle sets. A pair at the
bound shares none of the bands with a probability of 7 in 100,000, a more similar one with less. Candidates that
links already found connect are not verified again, so a large group costs some links a text and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import connected_components, discard, give_back, materialize, words_of
from voxelspan.llm.simhash import links, named_groups, survivors

SHINGLE, SIMILAR = 5, 0.8
#: Bits in which the fingerprints of SimHash's candidates may differ.
MAX_BITS = 4
BANDS, ROWS = 24, 5
#: Rounds in which the texts of a bucket are held against one of them, before those that are still apart are joined by
#: their rarest shingles.
STARS = 2
_RNG = np.random.default_rng(20)
_FLIP, _TIMES = (_RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def mark(text: str | None) -> int:
    """A signed 64-bit hash of the words, in which only A-Z have their case changed and only ASCII space splits."""
    h = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
    return h - (1 << 64) if h >> 63 else h


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, in their order and with repeats, and the place of each text's first (one more at the end).

    A text of fewer words has one shingle of all of them, one without words has none.
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower returns wrong offsets for a slice
    codes, offsets, words = words_of(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes]
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    left = np.repeat(offsets[1:], count) - at
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        out += np.where(k < left, padded[at + k] * _PLACE[k], np.uint64(0))
    return _mixed(out), ends


def bands(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The key of each text's bands; those of texts without shingles are all zero."""
    out = np.zeros((len(ends) - 1, BANDS), np.uint64)
    cuts = [0]
    while cuts[-1] < len(out):  # parts that stay in the processor's cache
        cuts.append(max(int(np.searchsorted(ends, ends[cuts[-1]] + 30_000, "right")) - 1, cuts[-1] + 1))
    for a, b in zip(cuts, cuts[1:]):
        some = np.flatnonzero(np.diff(ends[a : b + 1])) + a
        if not len(some):
            continue
        h, first = hashes[ends[a] : ends[b]], ends[some] - ends[a]
        for i in range(BANDS):
            key = np.full(len(some), i + 1, np.uint64)
            for flip, times in zip(_FLIP[i], _TIMES[i]):
                key = _mixed(key * _PLACE[-1] + np.minimum.reduceat((h ^ flip) * times, first))
            out[some, i] = key
    return out


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each text's SimHash: a bit is 1 if it is set in over half of its shingles' hashes; 0 for texts without shingles."""
    out = np.zeros(len(ends) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(2 * bits.sum(0, dtype=np.int64) > b - a).view(">u8")[0]
    return out


def _marked(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                h, ends = shingles(some.column(1), size)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * BANDS, pa.int32()), pa.array(bands(h, ends).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([mark(t.as_py()) for t in some.column(1)], pa.int64()), keys, pa.array(fingerprints(h, ends).view(np.int64))], ["doc_id", "fp", "keys", "sim"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint, keys array<bigint>, sim bigint")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and its shingles, each once, of the marks in wanted."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mark(t.as_py()) for t in batch.column(0)], pa.int64()), batch.column(0)], ["fp", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                h, ends = shingles(some.column(1), size)
                own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own, pa.list_(pa.int64()))], ["fp", "s"])
        give_back()

    texts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(marks, "fp bigint, text string")
    one = texts.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    return one.select("fp", "text").mapInArrow(run, "fp bigint, s array<bigint>")


def prefix_pairs(sets: DataFrame, similar: float) -> DataFrame:
    """a, b: pairs of ``sets`` (fp, s, root) with other roots, among them every one that is similar; by prefix filtering.

    Elements are ordered from the rarest, so what texts have of their own comes first. A similar pair shares one of the
    first elements of either text (of n elements, the smaller text's first n - ceil(2j / (1 + j) n) + 1 and the larger's
    first n - ceil(j n) + 1 for similarity j), at places that leave room for enough others; texts that only share what
    many do don't meet at all (Chaudhuri et al., ICDE 2006; Xiao et al., WWW 2008). Nothing is left out.
    """
    each = materialize(sets.select("fp", "root", F.size("s").alias("n"), F.explode("s").alias("e")))
    rare = each.groupBy("e").agg(F.count("*").alias("c"))
    ordered = each.join(rare, "e").groupBy("fp", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("l"))
    least = lambda share, n: F.ceil(n * F.lit(share) - 1e-9)
    both = 2 * similar / (1 + similar)
    first = ordered.select("fp", "root", "n", F.posexplode(F.slice("l", F.lit(1), (F.col("n") - least(similar, F.col("n")) + 1).cast("int"))).alias("p", "x"))
    first = materialize(first.where("x.c > 1").select("fp", "root", "n", "p", F.col("x.e").alias("e")))  # an element of one text meets none
    discard(each)
    small = first.where(F.col("p") <= F.col("n") - least(both, F.col("n"))).select("e", F.col("fp").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    large = first.select("e", F.col("fp").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("p").alias("pa"))
    fits = (F.struct("nb", "b") < F.struct("na", "a")) & (F.col("ra") != F.col("rb")) & (F.col("nb") >= least(similar, F.col("na")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least(both / 2, F.col("na") + F.col("nb"))
    return small.join(large, "e").where(fits & room).select("a", "b")


def simhash_pairs(firsts: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: SimHash's candidates among marks (fp) with their fingerprints (sim); of texts of one fingerprint, each with one of them."""
    worded = firsts.where(F.element_at("keys", 1) != 0).select("fp", "sim")
    one = materialize(worded.groupBy("sim").agg(F.min("fp").alias("least"), F.count("*").alias("n")))
    near = materialize(links(one.select(F.col("sim").alias("fp")), max_bits)).distinct()
    of = lambda n: one.select(F.col("sim").alias(n), F.col("least").alias(f"m{n}"))
    apart = near.join(of("a"), "a").join(of("b"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    same = worded.join(one.where("n > 1"), "sim").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return materialize(apart.unionByName(same))


def groups(docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """doc_id and mark (fp) of each row, and each mark's group: fp, root, component_id (the group's smallest doc_id).

    Texts of the same words are one mark. Null and wordless texts are alike, and like no other.
    """
    marked = materialize(_marked(docs, size))
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("sim").alias("sim")))
    keyed = firsts.select("fp", F.explode("keys").alias("key")).where("key <> 0")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = materialize(keyed.join(crowded, "key"))
    by_simhash = simhash_pairs(firsts)
    wanted = shared.select("fp").unionByName(by_simhash.select(F.col("a").alias("fp"))).unionByName(by_simhash.select(F.col("b").alias("fp")))
    sets = materialize(_sets(docs, wanted.distinct(), size))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        of = lambda n: sets.select(F.col("fp").alias(n), F.col("s").alias(f"s{n}"))
        both = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        held = both.join(of("a"), "a").join(of("b"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return held.where(F.col("i") / (F.size("sa") + F.size("sb") - F.col("i")) >= similar).select("a", "b")

    def rooted(parts: DataFrame) -> DataFrame:
        return shared.join(parts, shared["fp"] == parts["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))

    found = materialize(similar_pairs(by_simhash))
    parts = connected_components(found)
    for k in range(STARS + 1):
        here = rooted(parts)
        centres = here.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("x"), "fp", "root")).alias("c")).where("lo <> hi")
        if k < STARS:
            pairs = here.join(centres, "key").where("root <> c.root").select(F.col("fp").alias("a"), F.col("c.fp").alias("b"))
        else:
            apart = materialize(here.join(centres.select("key"), "key").select("fp", "root").distinct())
            pairs = prefix_pairs(sets.join(apart, "fp"), similar)
        new = materialize(similar_pairs(pairs))
        if new.isEmpty():
            continue
        found = found.unionByName(new)
        parts = connected_components(found)
    return marked.select("doc_id", "fp"), named_groups(firsts, parts)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Of each group of near copies one row of docs stays, chosen as simhash.survivors() says."""
    return survivors(docs, *groups(docs, **options), mark)
