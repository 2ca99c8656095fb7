import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelspan.llm import resemblance, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points, ids, bits):
    n = len(points)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(n)]


def rows(seed):
    rng = random.Random(seed)
    vocabulary = ["Ä" + str(i) if i % 7 == 0 else "W" + str(i) for i in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "a b c d e", "İ x y \x1c z"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\n".join(other))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30000)))
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[9], (None, "a lone text with no id", None, None, None), (None, texts[9], None, None, None)]


def test_against_brute_force(spark):
    data = rows(1)
    got = simhash.near_duplicates(spark.createDataFrame(data, DOCS).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))).collect()
    points = [brute(r[1]) for r in data]
    want = sorted(zip([r[0] for r in data], [f"{p:016x}" for p in points], components(points, [r[0] for r in data], 4)), key=str)
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_keep_components_of_all_pairs(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)  # so that buckets are cut into tiles
    rng = random.Random(bits)
    points = set()
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            points.add(p)
            for _ in range(rng.choice([1, 2, 3, 5, 6])):
                p ^= 1 << rng.randrange(64)
    points = sorted(points)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp bigint")
    found = simhash.connected_components(simhash.links(frame, bits)).collect()
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in found}
    groups = {}
    for p, c in zip(points, components(points, list(range(len(points))), bits)):
        groups.setdefault(c, set()).add(p)
    mine = {}
    for p in points:
        mine.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_deduplicate_keeps_one_of_each_group(spark):
    data = rows(2)
    kept = simhash.deduplicate(spark.createDataFrame(data, DOCS)).collect()
    points = [brute(r[1]) for r in data]
    groups = components(points, [r[0] for r in data], 4)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({g for g in groups if g is not None})
    assert sum(r["doc_id"] is None for r in kept) == 2


@pytest.mark.parametrize("operator", [simhash, resemblance])
def test_groups_that_share_their_smallest_doc_id_each_keep_one(spark, operator):
    one, two, three = (" ".join(f"{a}{i}" for i in range(60)) for a in "abc")
    data = [(1, one), (2, one), (1, two), (3, two), (0, three), (1, three)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in operator.deduplicate(docs).collect()) == sorted([(1, one), (1, two), (0, three)])
