"""Phrases of two to four words that belong together, by growing contiguous patterns to the right.

Words are counted first; a phrase can only be frequent if its words are. Then every occurrence of a frequent word is a
pointer that carries the words to its right, up to three, within its piece of the text. Pointers are grouped by prefix,
and one task extends a prefix depth-first: it counts what follows, and follows each frequent word with the pointers that
lead to it (as PrefixSpan does, for contiguous patterns). A prefix with more pointers than a task should hold hands each
of its extensions on as a prefix of its own, whose pointers are counted by Spark before they are grouped.

Words travel as 64-bit hashes; if two words of a corpus shared one, which the count of words would show, other hashes
are used. Which words are frequent and which prefixes are large is told by bitmaps of a fixed size. Two prefixes may
share a bit: a rare one is then dropped later, by its exact count, and a small one is treated as a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspan.llm.common import byte_slices, discard, give_back, materialize

#: Words in a phrase, occurrences of a candidate, and the percentage of them at which a longer phrase replaces it.
LONGEST, LEAST, COVERED = 4, 30, 80
#: Pointers of a prefix beyond which it is extended by Spark instead of in one task.
LARGE = 1 << 20
#: Bytes of text whose words are counted, and whose pointers are grouped, at once.
COUNTED, GROUPED = 4 << 20, 4 << 20
#: Bits of a bitmap: 2 MB.
BITS = 24
#: A byte's kind: 0 belongs to a word, 1 parts words, 2 parts pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ROWS = "lang string, prefix binary, spot int, n bigint, block binary"


def split_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts without nulls: each word's code, the words by code, the number of its piece (rising), that of its text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _KINDS[data]
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = kinds == 0
    begins, ends = letter.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~letter[:-1]
    heads = offsets[:-1]
    begins[heads] |= letter[heads]
    ends[1:] = letter[:-1] & ~letter[1:]
    ends[heads[heads > 0]] |= letter[heads[heads > 0] - 1]
    starts, lengths = np.flatnonzero(begins), np.flatnonzero(ends)
    lengths = lengths - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[letter[:-1]]])])
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    marks = np.flatnonzero(kinds == 2)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(marks, starts) + text, text


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """None is 0: 0 stands for no word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words.to_pylist()), np.uint64, len(words))


def spots(langs: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """Bits of prefixes: of hashes of language and words."""
    mixed = langs
    with np.errstate(over="ignore"):
        for w in words:
            mixed = (mixed ^ w) * np.uint64(0x9E3779B97F4A7C15)
            mixed = mixed ^ (mixed >> np.uint64(29))
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def _tests(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The bits of ``spot``: at most 512 parts of 4 KB reach the driver."""
    part = rows.select((F.col("spot").bitwiseAND(F.lit(32767))).cast("bigint").alias("p"), F.shiftright("spot", 15).alias("b"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in part.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect():
        out[r["b"] * 4096 : r["b"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Words of some MB of text: code, dictionary, piece, code of the language; the languages and their hashes."""
    held, size = [], 0

    def words():
        table = pa.Table.from_batches(held).combine_chunks()
        texts, langs = table.column(1).combine_chunks(), table.column(0).combine_chunks().dictionary_encode()
        code, dictionary, piece, text = split_words(texts)
        names = langs.dictionary.to_pylist()
        seeds = np.fromiter((xxhash.xxh64_intdigest(n.encode(), 7) for n in names), np.uint64, len(names))
        return code, dictionary, piece, langs.indices.to_numpy().astype(np.int64)[text], names, seeds

    for batch in batches:
        for some in byte_slices(batch, "text", most):
            plain = pa.RecordBatch.from_arrays([some.column(0).cast(pa.large_string()), pc.fill_null(some.column(1).cast(pa.large_string()), "")], ["lang", "text"])
            held.append(plain)
            size += pc.sum(pc.binary_length(plain.column("text"))).as_py() or 0
            if size >= most:
                yield words()
                give_back()
                held, size = [], 0
    if held:
        yield words()


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, prefix (the word's hash), spot, word, f of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, dictionary, _, lang, names, seeds in _stretches(batches, COUNTED):
            n = len(dictionary)
            key, counts = np.unique(lang * n + code, return_counts=True)
            lang, code = key // max(n, 1), key % max(n, 1)
            own = hashes(dictionary, seed)[code]
            prefix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
            word = dictionary.take(pa.array(code)).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), prefix, pa.array(spots(seeds[lang], own), pa.int32()), pa.array(counts), word], ["lang", "prefix", "spot", "n", "word"])
        give_back()

    each = docs.mapInArrow(run, "lang string, prefix binary, spot int, n bigint, word string")
    return each.groupBy("lang", "prefix", "spot", "word").agg(F.sum("n").alias("f"))


def clash(words: DataFrame) -> bool:
    """Whether two words of a language share a hash."""
    return not words.groupBy("lang", "prefix").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _rows(langs: pa.Array, seeds: np.ndarray, depth: int, columns: list[np.ndarray], weights: np.ndarray) -> pa.RecordBatch:
    """One row for each prefix of ``depth`` words among sorted pointers: columns are hashes of up to LONGEST words."""
    new = np.ones(len(weights), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in [seeds, *columns[:depth]]], axis=0)
    first = np.flatnonzero(new)
    prefix = np.ascontiguousarray(np.stack([c[first] for c in columns[:depth]], 1))
    block = np.stack([*columns[depth:], weights.astype(np.uint64)], 1)
    ends = np.append(first, len(weights)).astype(np.int64)
    blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends * block.shape[1] * 8), pa.py_buffer(np.ascontiguousarray(block))]).cast(pa.binary())
    prefixes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * depth), len(first), [None, pa.py_buffer(prefix)]).cast(pa.binary())
    n = np.add.reduceat(weights, first) if len(first) else weights
    return pa.RecordBatch.from_arrays([langs.take(pa.array(first)), prefixes, pa.array(spots(seeds[first], *prefix.T), pa.int32()), pa.array(n.astype(np.int64)), blocks], ["lang", "prefix", "spot", "n", "block"])


def project(docs: DataFrame, seed: int, frequent: np.ndarray, large: np.ndarray) -> DataFrame:
    """Pointers by prefix: one frequent word, or two where the first is a large prefix. Words end at a rare one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, dictionary, piece, lang, names, seeds in _stretches(batches, GROUPED):
            if not len(code):
                continue
            own, v = hashes(dictionary, seed), len(dictionary) + 1
            spot = spots(seeds[lang], own[code])
            words = [np.where(_tests(frequent, spot), code + 1, 0)]
            for k in range(1, LONGEST):  # the k-th word to the right, 0 beyond the piece's end or a rare word
                far = np.zeros_like(code)
                far[:-k or None] = np.where((piece[k:] == piece[:-k]) & (words[-1][:-k] > 0), words[0][k:], 0)
                words.append(far)
            big = _tests(large, spot)
            names = pa.array(names, pa.string())
            own = np.concatenate([[np.uint64(0)], own])
            for depth, keep in ((1, (words[1] > 0) & ~big), (2, (words[1] > 0) & big)):
                a = (lang[keep] * v + words[0][keep]) * v + words[1][keep]
                b = words[2][keep] * v + words[3][keep]
                order = np.argsort(b, kind="stable")
                order = order[np.argsort(a[order], kind="stable")]
                a, b = a[order], b[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                a, b, weights = a[first], b[first], np.diff(np.append(first, len(a)))
                l = a // (v * v)
                columns = [own[c] for c in (a // v % v, a % v, b // v, b % v)]
                yield _rows(names.take(pa.array(l)), seeds[l], depth, columns, weights)
        give_back()

    return docs.mapInArrow(run, _ROWS)


def _matrix(blocks: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All blocks' pointers one after another, and the end of each block."""
    sizes = pc.binary_length(blocks).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.frombuffer(b"".join(blocks.to_pylist()), np.uint64).reshape(-1, words + 1)
    return joined, np.cumsum(sizes // (8 * (words + 1)))


def small(rows: DataFrame, frequent: np.ndarray, large: np.ndarray) -> DataFrame:
    """Rows of prefixes that are frequent and not large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy().astype(np.int64)
            yield batch.filter(pa.array(_tests(frequent, at) & ~_tests(large, at)))

    return rows.mapInArrow(run, _ROWS)


def handed_on(rows: DataFrame, depth: int, large: np.ndarray) -> DataFrame:
    """Rows of large prefixes of ``depth`` words as rows of prefixes of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_tests(large, batch.column("spot").to_numpy().astype(np.int64))))
            if not batch.num_rows:
                continue
            pointers, ends = _matrix(batch.column("block"), LONGEST - depth)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            keep = pointers[:, 0] > 0
            pointers, row = pointers[keep], row[keep]
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64).reshape(-1, depth)[row]
            langs = batch.column("lang").dictionary_encode()
            seeds = np.fromiter((xxhash.xxh64_intdigest(n.encode(), 7) for n in langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))[langs.indices.to_numpy()][row]
            yield _rows(batch.column("lang").take(pa.array(row)), seeds, depth + 1, [*prefix.T, *pointers[:, :-1].T], pointers[:, -1].astype(np.int64))

    return rows.mapInArrow(run, _ROWS)


def extend(pointers: np.ndarray, at: np.ndarray, place: int, prefix: bytes, least: int, out: list) -> None:
    """Depth-first: the frequent words at ``place`` behind the prefix whose pointers are ``at``, then what follows each."""
    following = pointers[at, place]
    order = np.argsort(following, kind="stable")
    at, following = at[order], following[order]
    first = np.flatnonzero(np.concatenate([[True], following[1:] != following[:-1]]))
    counts = np.add.reduceat(pointers[at, -1], first)
    stops = np.append(first[1:], len(at))
    for i in np.flatnonzero((counts >= least) & (following[first] > 0)).tolist():
        longer = prefix + following[first[i]].tobytes()
        out.append((longer, int(counts[i])))
        if place + 2 < pointers.shape[1]:
            extend(pointers, at[first[i] : stops[i]], place + 1, longer, least, out)


def grow(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a of every frequent phrase that is longer than the prefix it grows from; a prefix is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = None, []

        def grown():
            found: list = []
            if own is not None:
                words = LONGEST - len(own[1]) // 8
                pointers = np.frombuffer(b"".join(blocks), np.uint64).reshape(-1, words + 1)
                if len(pointers) and pointers[:, -1].sum() >= least:
                    extend(pointers, np.arange(len(pointers)), 0, own[1], least, found)
            return pa.RecordBatch.from_arrays([pa.array([own[0] if own else None] * len(found), pa.string()), pa.array([p for p, _ in found], pa.binary()), pa.array([a for _, a in found], pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            made = []
            for lang, prefix, block in zip(*[batch.column(c).to_pylist() for c in ("lang", "prefix", "block")]):
                if own != (lang, prefix):
                    made.append(grown())
                    own, blocks = (lang, prefix), []
                blocks.append(block)
            yield from pa.Table.from_batches(made, made[0].schema).combine_chunks().to_batches() if made else []
        yield grown()
        give_back()

    dealt = rows.select("lang", "prefix", "block").repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(run, "lang string, phrase binary, a bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(words: lang, prefix, f, word of every word; phrases: lang, phrase, a of two to LONGEST words, a >= least)."""
    for seed in range(42, 142):
        words = materialize(count_words(docs, seed))
        if not clash(words):
            break
        discard(words)
    else:
        raise RuntimeError("words clash under a hundred hashes")
    bits = lambda counts, name: (_bitmap(counts.where(F.col(name) >= least)), _bitmap(counts.where(F.col(name) > large)))
    often, many = bits(words, "f")
    rows = materialize(project(docs, seed, often, many))
    cold, found, written = [rows.where(F.octet_length("prefix") == 8)], [], [rows]
    hot = rows.where(F.octet_length("prefix") == 16)
    for depth in range(2, LONGEST + 1):
        counts = materialize(hot.groupBy("lang", "prefix").agg(F.sum("n").alias("a"), F.min("spot").alias("spot")).where(F.col("a") >= least))
        found.append(counts.select("lang", F.col("prefix").alias("phrase"), "a"))
        if depth == LONGEST:
            break
        often, many = bits(counts, "a")
        cold.append(small(hot, often, many))
        if not many.any():
            break
        hot = materialize(handed_on(hot, depth, many))
        written.append(hot)
    every = cold[0]
    for c in cold[1:]:
        every = every.unionByName(c)
    phrases = grow(every, least)
    for f in found:
        phrases = phrases.unionByName(f)
    phrases = materialize(phrases)
    for t in written:
        discard(t)
    return words.drop("spot"), phrases


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = 2000, large: int = LARGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    A null language is ``und``, a null text has no words; repeated rows count each. Other columns aren't looked at.
    Scores are whole numbers, computed in decimals of 38 digits.
    """
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, phrases = frequent_phrases(given, least, large)
    phrases = phrases.withColumn("m", (F.octet_length("phrase") / 8).cast("int"))
    part = lambda a, n: F.substring(F.col("phrase"), a * 8 + 1, n * 8)
    known = words.where(F.col("f") >= least).select("lang", F.col("prefix").alias("p"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("p"), F.col("a").alias("f")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumns({"_l": part(F.lit(0), F.col("k")), "_r": part(F.col("k"), F.col("m") - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("p").alias("_l"), F.col("f").alias("l")), ["lang", "_l"]).join(known.select("lang", F.col("p").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    score = F.expr("cast(2000000 * cast(a as decimal(28, 0)) as decimal(38, 0)) div (cast(l as decimal(28, 0)) + cast(r as decimal(28, 0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("m").alias("m"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    # a longer candidate over the percentage holds one that is a word longer: its parts are candidates, and as frequent
    long = phrases.where("m > 2")
    inside = long.select("lang", part(F.lit(0), F.col("m") - 1).alias("phrase"), "a").unionByName(long.select("lang", part(F.lit(1), F.col("m") - 1).alias("phrase"), "a"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(28, 0)") < covered * F.col("a").cast("decimal(28, 0)")))
    by = [F.col("c.score").desc(), F.col("a").desc()]
    first = kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("_rank") <= top).drop("_rank", "longer")
    first = materialize(first)
    spelled = first.select("lang", "phrase", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: part(k, F.lit(1)))).alias("k", "prefix")).join(words.select("lang", "prefix", "word"), ["lang", "prefix"])
    spelled = spelled.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda s: s["word"]), " ").alias("_text"))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = first.join(spelled, ["lang", "phrase"]).join(total, "lang").drop("phrase").withColumnRenamed("_text", "phrase")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")).cast("bigint")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLLOCATIONS_SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (l.a + r.a) AS BIGINT) AS score FROM k JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(ws[:k], ' ') JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
e AS (SELECT b.*, n.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b JOIN n USING (lang) ANTI JOIN o ON o.lang = b.lang AND o.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM e WHERE rank <= 2000"""
