import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxelspan.llm import cotraining as C

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n, seed):
    """Poor documents have symbols; their source tells it too, but not always."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("lar mo ten vi ka ri".split()) for _ in range(rng.choice([1, 2, 3])))
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        text = " ".join(word() + ("" if good or rng.random() < 0.5 else "%%%") for _ in range(rng.choice([10, 50, 200])))
        rows.append((i, text, rng.choice(["en", None]), ("fine" if good else "poor") if rng.random() < 0.9 else "any", len(text), int(good)))
    return rows


def views(rows):
    return C.text_view(pa.array([r[1] for r in rows])), C.meta_view(*(pa.array([r[k] for r in rows]) for k in (2, 3, 4)))


def test_held_out_accuracy_and_exchange():
    a, pool, b = corpus(300, 0), corpus(600, 1), corpus(400, 2)
    m = C.co_train(views(a), np.array([r[5] for r in a]), views(pool))
    assert len(m.exchanged) == C.ROUNDS and all(x > 60 and y > 60 for x, y in m.exchanged)  # both views, in every round
    text, meta, both = m.scores(*views(b))
    y = np.array([r[5] for r in b]) == 1
    accuracy = [np.mean((s >= 0.5) == y) for s in (text, meta, both)]
    assert accuracy[2] >= 0.97 and accuracy[2] >= max(accuracy[:2]) - 0.01 and accuracy[1] > 0.8


def test_pseudo_labels_help_a_view_with_few_labels():
    """With 24 labels, over ten corpora: the exchange raises the text view and the combination."""
    gains = []
    for seed in range(10):
        a, pool, b = corpus(24, 300 + seed), corpus(800, 400 + seed), corpus(400, 500 + seed)
        few, y = np.array([r[5] for r in a]), np.array([r[5] for r in b]) == 1
        right = lambda m: [np.mean((s >= 0.5) == y) for s in m.scores(*views(b))]
        with_rounds, without = C.co_train(views(a), few, views(pool)), C.co_train(views(a), few, views(pool), rounds=0)
        if with_rounds is not None:
            gains.append(np.subtract(right(with_rounds), right(without)))
    mean = np.mean(gains, 0)
    assert len(gains) >= 8 and mean[0] > 0 and mean[2] > 0, mean


def plain_co_train(labelled, y, pool, rounds):
    """The same rounds over rows in memory, with explicit rows and weights; returns both views' logits of the pool."""
    y = np.asarray(y, float)
    part = np.arange(len(y)) % 4 == 3

    def fit(x, t, w, ridge, mean=None, scale=None):
        mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if mean is None else (mean, scale)
        z = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], 1)
        b, r = np.zeros(z.shape[1]), np.r_[1e-3, np.full(z.shape[1] - 1, ridge)]
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ b))
            step = np.linalg.solve((z * (w * (p * (1 - p) + 1e-12))[:, None]).T @ z + np.diag(r), z.T @ (w * (p - t)) + r * b)
            b = b - np.clip(step, -4, 4)
        return lambda q: b[0] + np.clip((q - mean) / scale, -8, 8) @ b[1:]

    ones = lambda n: np.ones(n)
    pair = [fit(x[~part], y[~part], ones((~part).sum()), 1.0) for x in labelled]
    every = [np.concatenate([x[~part], q]) for x, q in zip(labelled, pool)]
    moments = [(e.mean(0), np.maximum(e.std(0), 1e-6)) for e in every]
    prior = y[~part].mean()
    for _ in range(rounds):
        given = []
        for v in (0, 1):
            logit = pair[v]
            calibrated = fit(logit(labelled[v][part])[:, None], y[part], ones(part.sum()), 0.1)
            p = 1 / (1 + np.exp(-calibrated(logit(pool[v])[:, None])))
            step = np.minimum(p * C.STEPS, C.STEPS - 1).astype(int)
            high = next(k for k in range(C.STEPS - 1, -1, -1) if (step >= k).sum() >= C.SHARE * prior * len(p)) / C.STEPS
            low = next(k for k in range(C.STEPS) if (step <= k).sum() >= C.SHARE * (1 - prior) * len(p)) / C.STEPS + 1 / C.STEPS
            ok = (p >= min(high, C.SURE)) | (p < max(low, 1 - C.SURE))
            given.append((ok, p))
        new = []
        for v in (0, 1):
            ok, p = given[1 - v]
            x = np.concatenate([labelled[v][~part], pool[v][ok]])
            weight = np.r_[ones((~part).sum()), np.full(ok.sum(), 0.5 * min(1, (~part).sum() / max(ok.sum(), 1)))]
            new.append(fit(x, np.r_[y[~part], p[ok]], weight, 1.0, *moments[v]))
        pair = new
    return [f(q) for f, q in zip(pair, pool)]


def test_rounds_are_those_of_a_plain_version():
    a, pool = corpus(160, 31), corpus(500, 32)
    y = np.array([r[5] for r in a])
    for rounds in (1, 3):
        m = C.co_train(views(a), y, views(pool), rounds=rounds)
        for view, x, plain in zip(m.views, views(pool), plain_co_train(views(a), y, views(pool), rounds)):
            assert np.abs(view.logit(x) - plain).max() < 0.02


def test_one_labelled_document_on_many_rows_is_one_row(spark):
    rows = [r[:5] for r in corpus(60, 8)]
    docs = spark.createDataFrame(rows + [(3, f"copy {i}", "en", "s", i) for i in range(500)], DOCS)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in corpus(60, 8)], LABELS)
    assert C.train(docs, labels) is not None


def test_rows(spark):
    rows = corpus(200, 6)
    data = [r[:5] for r in rows]
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "a b", "en", "s", -5), data[3], (902, "w " * 40000, "en", "s", 80000)]
    docs = spark.createDataFrame(data + odd, DOCS).withColumns({"score": F.lit("clash"), "y": F.lit(1), "x": F.lit(2)})
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows[:120]] + [(None, 1, 0), (901, None, 0)], LABELS)
    got = C.score(docs, C.train(docs, labels)).collect()
    assert len(got) == len(data) + len(odd)
    for r in got:
        assert all(0 <= r[c] <= 1 for c in ("score_text", "score_meta", "score")) and r["kept"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame(corpus(3, 7), DOCS + ", g int"), spark.createDataFrame([], LABELS)
    assert C.train(docs, none) is None and {r["kept"] for r in C.score(docs, None).collect()} == {True}
    assert C.train(docs.limit(0), none) is None and C.score(docs.limit(0), None).collect() == []


def test_every_unlabelled_document_takes_part(spark):
    """6,000 unlabelled documents: as many are handed over as by the same rounds over all of them in memory."""
    rows = corpus(6200, 9)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS).repartition(3)
    few = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 5]
    got = C.train(docs, spark.createDataFrame([(r[0], r[5], 0) for r in rows[:200]], LABELS))
    want = C.co_train(views(few), np.array([r[5] for r in few]), views(rows[200:]))
    assert min(map(min, got.exchanged)) > 1500
    assert len(got.exchanged) == len(want.exchanged) and np.allclose(got.exchanged, want.exchanged, atol=20)
    a, b = (m.scores(*views(rows[:500]))[2] for m in (got, want))
    assert np.abs(a - b).max() < 0.2 and ((a >= 0.5) == (b >= 0.5)).mean() > 0.99
