import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspan.llm import toxicity as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n, seed):
    rng = random.Random(seed)
    stems = ["lar", "mo", "ten", "vi", "ka", "ri", "so", "ne"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.choice([1, 2, 3])))
    texts, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.choice([6, 40, 150]))], int(rng.random() < 0.25)
        for _ in range(toxic * (1 + len(words) // 40)):
            words[rng.randrange(len(words))] = rng.choice(["grobs", "schuft" + word(), "Zwurm,"])
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return T.fit(*corpus(600, 0))


def test_held_out_accuracy(model):
    texts, labels = corpus(400, 1)
    assert np.mean((model.score(pa.array(texts)) >= 0.5) == labels) >= 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = T.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, T.FEATURES))
    lengths = np.array([T.WINDOW, 5, 1, 0])
    index = rng.integers(0, 9, (4, T.WINDOW))
    y, w = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.5, 1.0, 2.0, 1.0])

    def loss():
        z = net.run(net.project(x), index, lengths)
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    grad = net.gradients(x, index, lengths, y, w)
    for k, v in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(3)]:
            old = v[at]
            v[at] = old + 1e-2
            up = loss()
            v[at] = old - 1e-2
            down = loss()
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3), (k, at)


def test_windows_overlap_and_cover_every_word():
    lengths = np.array([0, 1, T.WINDOW, T.WINDOW + 1, 1000])
    text, start, length = T.windows_of(lengths)
    for i, n in enumerate(lengths):
        spans = [(s, s + k) for t, s, k in zip(text, start, length) if t == i]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] < a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:]))


def test_long_text_is_read_to_its_end(model):
    texts, _ = corpus(300, 2)
    clean = [t for t, s in zip(texts, model.score(pa.array(texts))) if s < 0.1]
    whole = " ".join(clean * 3)
    low, high = model.score(pa.array([whole, whole + " grobs Zwurm, grobs"]))
    assert low < 0.5 <= high


def test_score_rows(spark):
    texts, toxic = corpus(300, 3)
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*data, (900, None, None, None, None), (901, "", None, None, None), (None, texts[0], None, None, None), data[5]], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (900, None, None), (5, 0, toxic[5])], LABELS)
    model = T.train(docs, labels)
    rows = T.score(docs, model).collect()
    assert len(rows) == len(data) + 4
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_held_out_labels_are_not_learned_from(spark):
    texts, toxic = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    turned = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in enumerate(toxic)]
    a, b = (sorted(map(tuple, T.score(docs, T.train(docs, spark.createDataFrame(x, LABELS))).collect())) for x in (turned, [(i, 1, t) for i, t in enumerate(toxic)]))
    assert a == b


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    none = T.train(docs, spark.createDataFrame([], LABELS))
    assert none is None and [tuple(r)[2:] for r in T.score(docs, none).collect()] == [(0.0, 0)]
    assert T.score(spark.createDataFrame([], DOCS), T.fit(*corpus(50, 5), epochs=1)).collect() == []


def naive_score(model, text):
    """Window by window and word by word, from the definition of the network."""
    H, p = T.HIDDEN, {k: v.astype(float) for k, v in model.network.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    best = None
    starts = [0]
    while starts[-1] + T.WINDOW < len(words):
        starts.append(starts[-1] + T.STRIDE)
    for s in starts:
        some = words[s : s + T.WINDOW]
        xs = [model.inputs(pa.array([w], pa.large_string()))[0].astype(float) for w in some]
        states = {}
        for d, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
            h = np.zeros(H)
            for t in order:
                g = xs[t] @ p[f"W{d}"] + p[f"b{d}"]
                z = sig(g[:H] + h @ p[f"U{d}"][:, :H])
                r = sig(g[H : 2 * H] + h @ p[f"U{d}"][:, H : 2 * H])
                n = np.tanh(g[2 * H :] + (r * h) @ p[f"U{d}"][:, 2 * H :])
                h = (1 - z) * h + z * n
                states[d, t] = h
        if xs:
            both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(xs))])
            e = np.tanh(both @ p["A"] + p["a"]) @ p["v"]
            w = np.exp(e - e.max())
            pooled = (w / w.sum()) @ both
        else:
            pooled = np.zeros(2 * H)
        logit = pooled @ p["o"] + p["c"][0]
        best = logit if best is None else max(best, logit)
    return sig(model.scale * best + model.shift)


def test_scores_are_the_naive_ones(model):
    texts, _ = corpus(25, 8)
    texts += [None, "", "one", " ".join(["grobs lar"] * 16), " ".join(["mo ten"] * 60) + "\n\tZwurm,"]
    assert np.allclose(model.score(pa.array(texts)), [naive_score(model, t) for t in texts], atol=2e-4)


def test_embeddings_are_learned():
    one, more = (T.fit(*corpus(120, 6), epochs=n).embeddings for n in (1, 4))
    assert not np.allclose(one.words, more.words, atol=0.01) and not np.allclose(one.chars, more.chars, atol=0.01)


def test_fitting_is_bounded_by_bytes_and_repeats(spark, monkeypatch):
    texts, toxic = corpus(200, 9)
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 0)] * 500 + [(2, "long " * 50000, "en", "s", 0)]
    seen = []
    monkeypatch.setattr(T, "fit", lambda t, y: seen.append((list(t), list(y))))
    T.train(spark.createDataFrame(data, DOCS), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS), sample_bytes=40_000)
    got, labels = seen[0]
    assert sum(len(t.encode()) for t in got) <= 40_000 and max(map(len, got)) <= 2500 and got.count(texts[1]) <= 1 and 0 < sum(labels) < len(labels)


def test_parts_cover_all_texts(monkeypatch):
    monkeypatch.setattr(T, "PART_BYTES", 50)
    texts = pa.array(["x" * n for n in (0, 10, 200, 49, 1, 1, 0)] + [None])
    assert [t for p in T.parts(texts, 3) for t in p.to_pylist()] == texts.to_pylist() and max(len(p) for p in T.parts(texts, 3)) <= 3
