import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_tokens import crc
from voxelspan.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " a", "a ", "a  b", "   ", "a\nb\tc", "𝄞 𓀀x", "é ́x", "日本語 テスト", "<s> </s> <unk> <0x41>", "x" * 200, "ab" * 100, "the cat's  tail"]


def texts():
    rng = random.Random(0)
    alphabet = list("ab the in g1.,éß日𝄞\n ") + ["tion", "ing "]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(600)]


def test_merge_model_is_the_librarys():
    m, library = S.Pieces.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    some = texts()
    ids, ends = m.encode(pa.array(some))
    for t, a, b in zip(some, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == library.encode(t or "") and m.decode(ids[a:b]) == (t or "") == library.decode(ids[a:b].tolist())


@pytest.mark.parametrize("seed", range(4))
def test_best_sum_of_scores_against_all_cuts(seed):
    rng = random.Random(seed)
    pieces = {p: -rng.uniform(1, 9) for p in ["a", "b", "ab", "ba", "aab", "bba", "abab", "▁", "▁a", "▁ab", "b▁"]}
    m = S.Pieces(list(pieces.items()), {b: 1000 + b for b in range(256)}, 999, merges=False)
    for _ in range(60):
        t = "▁" + "".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 9)))
        cuts = ([t[i:j] for i, j in zip((0, *at), (*at, len(t)))] for k in range(len(t)) for at in itertools.combinations(range(1, len(t)), k))
        best = max(sum(pieces[p] for p in cut) for cut in cuts if all(p in pieces for p in cut))
        assert sum(pieces[p] for p in m.path(t)) == pytest.approx(best) and "".join(m.path(t)) == t
    assert m.ids_of("é") == [1000 + 0xC3, 1000 + 0xA9]
    assert S.Pieces(list(pieces.items()), {}, 999, merges=False).ids_of("éxa") == [999, 0]


def test_rows(spark):
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts()[:60])] + [(70, "long words " * 15000, "en", "s", 0)]
    data += [data[5], (None, "no id", None, None, None)]
    docs = spark.createDataFrame(data, DOCS).withColumn("ids", F.lit("clash"))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(((d[0], len(i := library.encode(d[1] or "")), crc(i), hashlib.sha256((d[1] or "").encode()).hexdigest(), True) for d in data), key=str)
    assert sorted(map(tuple, S.round_trip(docs, PATH).collect()), key=str) == want
    encoded = S.encode(docs, PATH)
    assert sorted((r["doc_id"], crc(r["ids"])) for r in encoded.where("doc_id is not null").collect()) == sorted((w[0], w[2]) for w in want if w[0] is not None)
    assert {(r["doc_id"], r["text"]) for r in S.decode(encoded, PATH).collect()} == {(d[0], d[1] or "") for d in data}


def test_empty(spark):
    assert S.round_trip(spark.createDataFrame([], DOCS), PATH).collect() == []
    assert S.Pieces.load(PATH).decode(np.zeros(0, int)) == ""


def test_decode_of_ids_without_text():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), S.model(path)
    some = library.encode("the cat")
    for ids in ([0], [1, *some, 2], [*some, 0, *some], [some[0], 1, some[1]], []):
        assert mine.decode(np.array(ids, np.int64)) == library.decode(ids), ids
    bare = S.Pieces([("▁a", -1.0), ("b", -2.0)], {}, 0, False, [1, 2])
    assert bare.decode(np.array([1, 0, 2, 77])) == "a ⁇ b"
