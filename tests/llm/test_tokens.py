import random
import string
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelspan.llm import packing, wavelet
from voxelspan.llm.tokens import Encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " a", "a ", "a  b", "a\n b", "a \nb", "it's a's b  c", "x　 y", "a  b", "a<|endoftext|> b", "Ünï <|startoftext|>", "é ́x", "İstanbul ΣΑΣ", "a\x0bb b", "a\x0b b", "\ta b\t", "#%% %%", "1 22 a1", "𝄞 x\x85 y", "plain Words only"]
ODD += [t.replace("@", m) for m in ("<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>") for t in ("@", "@ at the start", "in the @ middle", "at the end @", "in@side", "@@ twice", "two @ and @", " @ ", "a\n@\n b", "<@>", "word@", "@word")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    rng = random.Random(1)
    alphabet = list("ab Z é'\n\t.1") + ["  ", " the ", "　", "ß", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    e = Encoder(public_tokenizers.path(name))
    ids, ends = e.encode(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_every_latin_letter_with_marks(name):
    rng = random.Random(2)
    letters, marks = [chr(k) for k in range(0x41, 0x250)], list(string.punctuation) + ["...", "'s", "***!", "'re.", "́", "̸"]
    texts = [a + c + b + m for c in letters for a, b, m in (("", "", ""), ("x", "Y", ","), ("É", "ñ", rng.choice(marks)))]
    texts = [" ".join(rng.choices(texts, k=6)) for _ in range(3000)] + texts + [w + m for w in ("Word", "naïve", "ª", "ß") for m in marks]
    e = Encoder(public_tokenizers.path(name))
    ids, ends = e.encode(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def library_ids(texts, name, end=2):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice("the of Straße and 12 x. naïve".split()) for _ in range(n)) for n in (3, 900, 1023, 1024, 2500, 20000)]
    data = [(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)]
    rng.shuffle(data)
    data += [data[0], (None, "no id", None, None, None)]
    return data, spark.createDataFrame(data, DOCS).withColumns({"start": F.lit("clash"), "piece": F.lit("x")})


def test_wavelet_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 20000)
    data, docs = documents(spark)
    got = wavelet.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0))
    ids = library_ids([d[1] for d in order], "word_bpe_49k.json")
    starts = np.cumsum([0] + [len(x) for x in ids])
    assert sorted(map(tuple, got), key=str) == sorted(((d[0], int(s), len(x), crc(x)) for d, s, x in zip(order, starts, ids)), key=str)


def test_wavelet_empty(spark):
    assert wavelet.round_trip(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (50, 1), (3000, 2), (5000, 700), (4000, 70000)])
def test_shard_access_count_locate(n, sigma, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % sigma * 3).astype(np.uint32)
    shard = wavelet.Shard.of(wavelet.build(ids, [7], np.array([0, n])))
    assert (shard.decode() == ids).all() and shard.n == n and shard.doc_ids == [7]
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert shard.access(i) == ids[i]
        where = np.flatnonzero(ids == ids[i])
        assert shard.count(int(ids[i])) == len(where) and shard.count(int(ids[i]), 5, i) == int(((where >= 5) & (where < i)).sum())
        k = int(rng.integers(len(where)))
        assert shard.locate(int(ids[i]), k) == where[k]
    assert shard.count(1) == 0 and shard.count(10**6) == 0
    with pytest.raises(IndexError):
        shard.access(n)


@pytest.mark.parametrize("group", [16, 10**6])
def test_packing(spark, group, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", group)
    data, docs = documents(spark)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = {}
    for d, ids in zip(data, library_ids([d[1] for d in data], "byte_bpe_50k.json")):
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (d[0], k, a, b - a, crc(ids[a:b]))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-tokens // 1024) + 2


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_sum_of_squares_is_near_the_bound():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1024, 1500), rng.choice([100, 300, 512, 640], 1500), np.full(100, 600)):
        bins, offsets = packing.sum_of_squares(lengths, 1024)
        filled = np.bincount(bins, lengths)
        assert filled.max() <= 1024
        gaps = []  # best fit, falling lengths
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [(g, i) for i, g in enumerate(gaps) if g >= x]
            if fits:
                gaps[min(fits)[1]] -= x
            else:
                gaps.append(1024 - x)
        assert len(filled) <= 1.02 * len(gaps) + 2


def test_placement_is_the_least_sum_of_squares():
    """Against sums computed anew for each open bin that fits, the fullest of equals."""
    rng = np.random.default_rng(3)
    for capacity, n in ((12, 200), (50, 400), (101, 300)):
        lengths = rng.integers(1, capacity + 1, n)
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        filled, total = [], {}
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            s, choices = int(lengths[i]), []
            gaps = np.bincount([capacity - f for f in filled if f < capacity], minlength=capacity + 1)
            for gap in {capacity - f for f in filled if capacity - f >= s}:
                after = gaps.copy()
                after[gap] -= 1
                if gap > s:
                    after[gap - s] += 1
                choices.append((int((after**2).sum()), gap - s))
            if choices:
                rest = min(choices)[1]
                assert capacity - offsets[i] - s == rest, (capacity, i)
                b = bins[i]
                assert filled[b] == offsets[i]
                filled[b] += s
            else:
                assert bins[i] == len(filled) and offsets[i] == 0
                filled.append(s)
        assert max(filled) <= capacity
