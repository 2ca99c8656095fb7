import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.llm import substrings as S

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(texts, least):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + least]) for d in docs for i in range(len(d) - least + 1))
    out = []
    for d in docs:
        gone = {i + k for i in range(len(d) - least + 1) if seen[tuple(d[i : i + least])] > 1 for k in range(least)}
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, exact = fresh(60), fresh(35)
    out = [None, "", "one", " ".join(exact), "a " * 400, "a b " * 60, "solo " * 41, " ".join(w for x in fresh(9) for w in [x] * 50), " ".join(fresh(34))]
    for _ in range(90):  # more contexts of one passage than CROWD
        out.append(" ".join(fresh(rng.randrange(30)) + passage + fresh(rng.randrange(30))))
    base = fresh(150)
    for _ in range(40):  # near copies
        other = list(base)
        other[rng.randrange(150)] = "changed" + str(rng.random())
        out.append("\n".join(other))
    out += [" ".join(fresh(20) + exact + fresh(20)), " ".join(fresh(20) + exact[:34] + fresh(20)), " ".join(fresh(70) + base[20:56] + fresh(5) + passage[3:39])]
    out += ["été \x1c " + " ".join(exact) + " 　", " ".join(fresh(20000)), " ".join(fresh(300))]
    return out + [out[-1]]


@pytest.mark.parametrize("shard,crowd", [(1_500_000, 64), (500, 3)])
def test_against_brute_force(spark, monkeypatch, shard, crowd):
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    monkeypatch.setattr(S, "CROWD", crowd)
    data = [(i if i != 3 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts(1))]
    docs = spark.createDataFrame(data, DOCS)
    want = brute([d[1] for d in data], 35)
    got = S.digest(docs.withColumns({"h": F.lit(1), "words": F.lit("x"), "n_words": F.lit(2)})).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d[0], *w) for d, w in zip(data, want)), key=str)
    left = S.remove(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        if r["doc_id"] is not None:
            n, gone, sha = want[r["doc_id"]]
            assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == sha
            assert r["n_chars"] == len(r["text"] or "") and (gone or r["text"] == data[r["doc_id"]][1])


def test_empty(spark):
    assert S.digest(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_and_intervals(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, [2, 5, 40, 300][seed], rng.integers(1, 60)) for _ in range(40)]
    text, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    index = S.FMIndex(text, ends)
    for _ in range(60):
        p = parts[rng.integers(len(parts))]
        a = rng.integers(len(p))
        q = p[a : a + rng.integers(1, 6)]
        low, high = np.array([0]), np.array([index.size])
        for w in q[::-1]:
            low, high = index.extend(np.array([w]), low, high)
        assert high[0] - low[0] == sum((x[i : i + len(q)] == q).all() for x in parts for i in range(len(x) - len(q) + 1))
    least = 3
    starts = ends - [len(p) for p in parts]
    query, a, b = S.repeated_intervals(index, text, starts, ends, least)
    mine = {(q, p) for q, x, y in zip(query, a, b) for p in range(x, y - least + 1)}
    seen = Counter(tuple(x[i : i + least]) for x in parts for i in range(len(x) - least + 1))
    assert mine == {(k, starts[k] + i) for k, x in enumerate(parts) for i in range(len(x) - least + 1) if seen[tuple(x[i : i + least])] > 1}
