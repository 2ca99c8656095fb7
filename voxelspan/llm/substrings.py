"""Substring dedup: words of passages that stand in the corpus more than once, by an FM-index per shard.

Every window of ``least`` words has a minimizer, the smallest hash of the grams in it; equal windows have equal ones.
Consecutive windows whose minimizer stands in the same place form a segment, so no segment holds a window twice. Only
segments whose minimizer the corpus has twice go on, each to the shard of its minimizer: two equal windows always meet
there, and each window goes to one shard only. Equal segments are one row with a count. A shard builds the suffix order of its segments, their Burrows-Wheeler transform,
and a wavelet matrix over it with sampled counts, and streams the segments against it: backward search extends a
match to the left while the index holds it twice; where it fails, the search starts again at the next window end that
could still succeed. What comes out are the intervals whose matching statistics reach ``least``.

Hashes only choose what goes to the index; the index compares words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import discard, materialize, spread, words_of

#: Words of a gram; windows of a segment at most, so that suffixes differ within 64 words; words of a shard.
GRAM, RUN, SHARD_WORDS = 7, 29, 800_000
#: Distinct segments of a minimizer above which those are cut down to their repeated windows before the shard.
CROWD = 64
#: Segments that a task remembers having given out the words of; more only means that words travel again.
SENT = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD + values[j : j + n]
    return _mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    done, m = 1, values
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments_of(hashes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, number of windows and minimizer of each segment; offsets bound the texts in hashes."""
    gram = min(GRAM, least)
    grams = rolling(hashes, gram)
    low = sliding_min(grams, least - gram + 1)
    count = np.maximum(0, np.diff(offsets) - least + 1)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if not len(text):
        return text, place, place, np.zeros(0, np.int64)
    h = low[offsets[text] + place]
    leaves = grams[offsets[text] + place] == h  # the window's first gram is its minimizer: the next window has another
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | leaves[:-1]])
    first = np.flatnonzero(new)
    since = np.arange(len(text)) - np.repeat(first, np.diff(np.concatenate([first, [len(text)]])))
    starts = np.flatnonzero(since % RUN == 0)
    return text[starts], place[starts], np.diff(np.concatenate([starts, [len(text)]])), h[starts].view(np.int64)


class FMIndex:
    """Over sequences of word numbers (from 0), none longer than 63; counts are exact, matches never cross sequences."""

    def __init__(self, sequences: np.ndarray, ends: np.ndarray):
        """sequences one after another, sequence i ending at ends[i]."""
        n, words = len(ends), len(sequences)
        at = np.arange(words) + np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
        text = np.zeros(words + n, np.int64)
        text[at] = sequences + n  # each sequence ends with a sign of its own, below all words
        text[ends + np.arange(n)] = np.arange(n)
        order = self._suffixes(text)
        last = text[order - 1]
        bwt = np.where(last < n, 0, last - n + 1)  # the signs are one letter here: no search asks for them
        self.size, sigma = len(text), int(sequences.max(initial=-1)) + 2
        self.levels = max(1, int(sigma - 1).bit_length())
        below = np.bincount(bwt, minlength=sigma)
        self.below = np.concatenate([[0], np.cumsum(below)])[:-1]
        self.planes, self.zeros = [], []
        start = np.zeros(sigma, np.int64)
        letters, x = np.arange(sigma), bwt
        for level in range(self.levels - 1, -1, -1):
            bits = (x >> level & 1).astype(bool)
            padded = np.zeros((len(bits) + 64) // 64 * 64, bool)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32)
            self.planes.append((packed, ones))
            self.zeros.append(len(bits) - int(bits.sum()))
            x = np.concatenate([x[~bits], x[bits]])
            start = self._down(len(self.planes) - 1, (letters >> level & 1).astype(bool), start)
        self.start = start

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        rank, k = text, 1
        while k < 64:
            after = np.zeros_like(rank)
            after[:-k or None] = rank[k:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
            rank, k = new, 2 * k
            if len(rank) and rank[order[-1]] == len(rank) - 1:
                break
        return np.argsort(rank, kind="stable")

    def _down(self, plane: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        packed, ones = self.planes[plane]
        word = i >> 6
        below = packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        rank = ones[word] + np.bitwise_count(below)
        return np.where(bit, self.zeros[plane] + rank, i - rank)

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of word + match from those of match."""
        letter = word + 1
        i = np.concatenate([low, high])
        twice = np.concatenate([letter, letter])
        for k in range(self.levels):
            i = self._down(k, (twice >> (self.levels - 1 - k) & 1).astype(bool), i)
        i += (self.below - self.start)[twice]
        return i[: len(low)], i[len(low) :]


def repeated_intervals(index: FMIndex, sequences: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, first word, end) of maximal matches of at least ``least`` words that the index holds twice; query i is sequences[starts[i]:ends[i]]."""
    found: list[np.ndarray] = []
    query, stop = np.arange(len(starts)), ends.copy()
    live = stop - starts >= least
    query, stop = query[live], stop[live]
    while len(query):
        low, high = np.zeros(len(query), np.int64), np.full(len(query), index.size)
        at = stop.copy()  # the match is sequences[at:stop]
        going = np.arange(len(query))
        while len(going):
            a, b = index.extend(sequences[at[going] - 1], low[going], high[going])
            good = b - a >= 2
            going, a, b = going[good], a[good], b[good]
            low[going], high[going] = a, b
            at[going] -= 1
            going = going[at[going] > starts[query[going]]]
        long = stop - at >= least
        found.append(np.stack([query[long], at[long], stop[long]]))
        # windows that start at or after at are decided; the next one that could match starts right before
        stop = np.minimum(stop - 1, at - 1 + least)
        more = stop - starts[query] >= least
        query, stop = query[more], stop[more]
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 3


def shard_intervals(texts: pa.Array, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the repeated intervals of a shard's distinct segments; counts say how often each stands in the corpus."""
    codes, offsets, words = words_of(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes] if len(words) else np.zeros(0, np.uint64)
    windows = np.maximum(0, np.diff(offsets) - least + 1)
    row = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    _, which, times = np.unique(rolling(hashes, least)[offsets[row] + place], return_inverse=True, return_counts=True)
    hot = (np.bincount(which, counts[row] >= 2) > 0) | (times >= 2)  # windows that may be repeated
    keep = hot[which]
    row, place = row[keep], place[keep]
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(cut)
    after = np.concatenate([first[1:], [len(row)]])
    row, begin, size = row[first], place[first], after - first + least - 1
    # a segment that the corpus has twice or more is in the index twice
    copies = np.where(counts[row] >= 2, 2, 1)
    runs = np.repeat(np.arange(len(row)), copies)
    ends = np.cumsum(size[runs])
    at = np.repeat(offsets[row[runs]] + begin[runs] - (ends - size[runs]), size[runs]) + np.arange(int(ends[-1]))
    used, text = np.unique(codes[at], return_inverse=True)
    index = FMIndex(text, ends)
    own = np.cumsum(copies) - copies  # the first copy of each run asks
    starts = (ends - size[runs])[own]
    query, a, b = repeated_intervals(index, text, starts, starts + size, least)
    return row[query], begin[query] + a - starts[query], begin[query] + b - starts[query]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same text share a key, 128 bits of its hash, and hence their result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_text": text, "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})


def intervals(docs: DataFrame, least: int = 35) -> DataFrame:
    """_k1, _k2 and spans, an array of (a, b) word ranges to remove, of every text that has any."""
    keyed = _keyed(docs.select("text")).select("_k1", "_k2", "_text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                codes, offsets, words = words_of(some.column(2))
                named = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
                text, place, windows, h = segments_of(named[codes], offsets, least)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(h), pa.array(place, pa.int32()), pa.array(windows, pa.int32())], ["_k1", "_k2", "h", "i", "n"])

    all_anchors = materialize(keyed.mapInArrow(anchors, "_k1 bigint, _k2 bigint, h bigint, i int, n int"))
    twice = materialize(all_anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    wanted = materialize(all_anchors.join(twice, "h", "left_semi").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("i", "n", "h")).alias("runs")))
    discard(all_anchors)
    discard(twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # segments whose words this task has given out already
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2)[k].as_py().encode("utf-8", "surrogatepass").split()
                runs = batch.column(3)[k].as_py()
                same = lambda c: pa.array([batch.column(c)[k].as_py()] * len(runs), pa.int64())
                texts = [b" ".join(words[r["i"] : r["i"] + r["n"] + least - 1]) for r in runs]
                s1, s2 = (np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in texts), np.uint64, len(texts)).view(np.int64) for seed in (0, 1))
                for j, x in enumerate(zip(s1.tolist(), s2.tolist())):
                    if x in sent:
                        texts[j] = None
                    elif len(sent) < SENT:
                        sent.add(x)
                columns = [same(0), same(1), pa.array([r["i"] for r in runs], pa.int32()), pa.array([r["h"] for r in runs], pa.int64()), pa.array(s1), pa.array(s2), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_k1", "_k2", "i", "h", "s1", "s2", "words"])

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in cut(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    joined = keyed.join(wanted, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "runs")
    cuts = materialize(joined.mapInArrow(batched, "_k1 bigint, _k2 bigint, i int, h bigint, s1 bigint, s2 bigint, words string"))
    discard(wanted)
    distinct = cuts.groupBy("h", "s1", "s2").agg(F.max("words").alias("words"), F.count("*").alias("n"))
    distinct = materialize(distinct.withColumn("o", F.lit(0)))
    placed = materialize(cuts.select("_k1", "_k2", "i", "s1", "s2"))
    discard(cuts)
    crowds = materialize(distinct.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("h"))
    crowded = distinct.join(crowds, "h", "left_semi")
    calm = distinct.join(crowds, "h", "left_anti")
    named = {"p1": F.xxhash64("words"), "p2": F.xxhash64(F.lit(1), "words")}
    cut_down = materialize(_repeated_parts(crowded, least).withColumns(named))
    # a piece may stand in several segments; in the index it is one text, as often as they stand together
    joint = cut_down.groupBy("h", "p1", "p2").agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    total = sum(x.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0 for x in (distinct, cut_down))
    shards = max(1, -(-total // SHARD_WORDS))
    whole = calm.withColumns({"p1": F.col("s1"), "p2": F.col("s2")}).select("h", "p1", "p2", "words", "n")
    pieces = whole.unionByName(joint).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        texts = table.column("words").combine_chunks()
        row, a, b = shard_intervals(texts, table.column("n").to_numpy(), least)
        at = pa.array(row)
        return pa.table({c: table.column(c).take(at) for c in ("h", "p1", "p2")} | {"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    hits = pieces.select("shard", "h", "p1", "p2", "words", "n").groupBy("shard").applyInArrow(search, "h bigint, p1 bigint, p2 bigint, a int, b int")
    hits = materialize(hits)
    by_piece = hits.join(cut_down.select("h", "p1", "p2", "s1", "s2", "o"), ["h", "p1", "p2"])
    by_piece = by_piece.select("s1", "s2", F.struct((F.col("a") + F.col("o")).alias("a"), (F.col("b") + F.col("o")).alias("b")).alias("x"))
    direct = hits.join(crowds, "h", "left_anti").select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.struct("a", "b").alias("x"))
    by_segment = direct.unionByName(by_piece)
    by_segment = materialize(by_segment.groupBy("s1", "s2").agg(F.collect_set("x").alias("x")))
    for done in (distinct, cut_down, hits, crowds):
        discard(done)
    spans = placed.join(by_segment, ["s1", "s2"]).select("_k1", "_k2", F.explode(F.transform("x", lambda x: F.struct((x["a"] + F.col("i")).alias("a"), (x["b"] + F.col("i")).alias("b")))).alias("x"))
    out = materialize(spans.groupBy("_k1", "_k2").agg(F.collect_set("x").alias("spans")))
    discard(placed)
    discard(by_segment)
    return out


def _repeated_parts(segments: DataFrame, least: int) -> DataFrame:
    """Segments of crowded minimizers, cut down to runs of windows whose hash their minimizer has twice.

    Passages that many texts share stand in as many contexts; without the contexts their segments are equal again.
    """
    words = F.split("words", " ")
    windows = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(words) - least), lambda p: F.xxhash64(F.slice(words, p + 1, least))))
    # dealt by segment: those of one minimizer come from few tasks
    one = segments.repartition(spread(segments), "s1", "s2").select("h", "s1", "s2", "n", windows.alias("p", "w"))
    twice = one.groupBy("h", "w").agg(F.sum("n").alias("c")).where("c > 1").select("h", "w")
    left = one.join(twice, ["h", "w"], "left_semi").groupBy("h", "s1", "s2").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    runs = left.join(segments.select("h", "s1", "s2", "words", "n"), ["h", "s1", "s2"])
    # where a run begins, its places minus their ranks stay the same
    grouped = runs.select("h", "s1", "s2", "n", F.split("words", " ").alias("ws"), "ps", F.transform("ps", lambda p, k: p - k).alias("g"))
    each = grouped.select("h", "s1", "s2", "n", "ws", "ps", "g", F.explode(F.array_distinct("g")).alias("d"))
    first = F.array_position("g", F.col("d")).cast("int")  # from 1
    size = F.size(F.filter("g", lambda x: x == F.col("d")))
    each = each.select("h", "s1", "s2", "n", "ws", F.element_at("ps", first).alias("o"), size.alias("z"))
    return each.select("h", "s1", "s2", "o", F.array_join(F.slice("ws", F.col("o") + 1, F.col("z") + least - 1), " ").alias("words"), "n")


def _mask(n: int, spans: list | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for s in spans or ():
        gone[s["a"] : s["b"]] = True
    return gone


def digest(docs: DataFrame, least: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs.

    A null text has no words. Rows with equal texts of at least ``least`` words lose them all. Rows without doc_id and
    repeated rows return a row each. Columns other than doc_id and text are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1), batch.column(2)):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                gone = _mask(len(words), s.as_py())
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = _keyed(own).join(intervals(own, least), ["_k1", "_k2"], "left")
    return joined.select("doc_id", "_text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, least: int = 35) -> DataFrame:
    """docs with repeated passages cut out of text: what is left of a changed text is joined by one space, n_chars follows."""
    names = docs.columns
    place, schema = names.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lengths = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for k, s in enumerate(batch.column(len(names)).to_pylist()):
                if s:
                    words = texts[k].encode("utf-8", "surrogatepass").split()
                    texts[k] = b" ".join([w for w, g in zip(words, _mask(len(words), s).tolist()) if not g]).decode("utf-8", "surrogatepass")
                    if lengths is not None:
                        lengths[k] = len(texts[k])
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(texts, columns[place].type)
            if lengths is not None:
                i = names.index("n_chars")
                columns[i] = pa.array(lengths, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    joined = _keyed(whole).join(intervals(docs.select("text"), least), ["_k1", "_k2"], "left")
    return joined.select("_row.*", F.col("spans").alias("_spans")).mapInArrow(run, schema)


#: DuckDB SQL for digest() over documents.
DIGEST_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT k, i, md5(array_to_string(w[i:i+34], ' ')) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
word AS (SELECT k, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
near AS (SELECT word.k, p, x, (SELECT 1) AS one, max(dup.i) OVER (PARTITION BY word.k ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS last
    FROM word LEFT JOIN dup ON word.k = dup.k AND word.p = dup.i),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM near WHERE last IS NULL GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
