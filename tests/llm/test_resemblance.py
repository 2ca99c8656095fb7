import random

import pyarrow as pa

import corpus_pipeline
from voxelspan.llm import resemblance

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def brute(texts):
    """The first text of each text's group."""
    sets = [shingles(t) for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if first[i] != first[j] and alike(sets[i], sets[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    return first


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "W" + str(rng.randrange(5000))
    out = [None, "", " \t\n", "one", "ONE", "a b c d", "A b\nc d", "a b c d e"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([12, 60, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            other = list(base)
            for _ in range(rng.choice([1, len(base) // 60 + 1, len(base) // 45 + 1, len(base) // 30 + 1])):
                other[rng.randrange(len(other))] = word()
            out.append(" ".join(other))
    base = [word() for _ in range(200)]
    out += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 200, 2)]
    rng.shuffle(out)
    return out


def test_pipeline_stage_finds_every_pair_of_similarity_08(spark):
    some = texts(1)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(some)], DOCS)
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()
    first = brute(some)
    assert sorted(r["doc_id"] for r in kept) == sorted(set(first)) and len(set(first)) < len(some) - 100


def test_bands_recall_at_the_bound():
    """Pairs between 0.80 and 0.82: 99.9 % are candidates."""
    rng = random.Random(3)
    a = [[str(rng.random()) for _ in range(104)] for _ in range(1500)]
    b = [w[:93] + [str(rng.random()) for _ in range(11)] for w in a]  # 89 of 111 shingles
    keys = [resemblance.bands(*resemblance.shingles(pa.array([" ".join(w) for w in x]))) for x in (a, b)]
    assert all(0.8 <= len(x & y) / len(x | y) < 0.82 for x, y in zip(map(shingles, map(" ".join, a[:50])), map(shingles, map(" ".join, b[:50]))))
    assert (keys[0] == keys[1]).any(1).mean() >= 0.999
    assert not (keys[0][:-1] == keys[1][1:]).any()


def test_shingles_of_a_slice():
    some = ["É à B c d e f g %d" % i for i in range(3000)]
    whole, ends = resemblance.shingles(pa.array(some))
    part, cut = resemblance.shingles(pa.array(some).slice(1000, 1000))
    assert (part == whole[ends[1000] : ends[2000]]).all() and (cut == ends[1000:2001] - ends[1000]).all()


def test_empty_table(spark):
    assert resemblance.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def frame_of(spark, sets, roots=None):
    return spark.createDataFrame([(i, roots[i] if roots else i, sorted(s)) for i, s in enumerate(sets)], "fp bigint, root bigint, s array<bigint>")


def test_prefix_pairs_hold_every_similar_pair(spark):
    rng = random.Random(11)
    sets = [set(rng.sample(range(40), rng.randint(1, 30))) for _ in range(120)]
    for _ in range(120):
        other = set(rng.choice(sets))
        for _ in range(rng.randint(0, 6)):
            other ^= {rng.randrange(60)}
        sets.append(other or {1})
    roots = [i // 3 for i in range(len(sets))]
    found = {tuple(sorted(r)) for r in resemblance.prefix_pairs(frame_of(spark, sets, roots), 0.8).collect()}
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if roots[i] != roots[j] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])}
    assert similar <= found and len(similar) > 50 and len(found) < len(sets) ** 2 / 8


def test_template_texts_make_no_more_pairs_each_as_they_grow(spark):
    """Texts of one template with a word of their own, at similarity 0.79 or less: candidates stay within a few a text."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(30)]
    for n in (400, 800, 1600):
        some = []
        for i in range(n):
            words = list(base)
            words[rng.randrange(2, 28)] = f"own{i}"
            some.append({hash(x) for x in shingles(" ".join(words))})
        assert resemblance.prefix_pairs(frame_of(spark, some), 0.8).count() <= n


def test_a_crowd_of_near_copies_is_one_group(spark):
    """More copies in a bucket than the star rounds link: each differs from the base, and two of them by more than 0.2."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    some = []
    for i in range(300):
        words = list(base)
        for p in rng.sample(range(200), 4):
            words[p] = f"x{i}_{p}"
        some.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(some)], DOCS)
    kept = {r["doc_id"] for r in resemblance.deduplicate(docs).collect()}
    assert kept == {f for f in set(brute(some))}
