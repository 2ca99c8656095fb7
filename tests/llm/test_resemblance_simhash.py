import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from voxelspan.llm import resemblance

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def some_texts():
    rng = random.Random(5)
    out = []
    for _ in range(30):
        base = ["w" + str(rng.randrange(9000)) for _ in range(400)]
        out += [" ".join(base), " ".join([*base, "more"])]
    return out


def test_fingerprints_by_hand():
    h, ends = resemblance.shingles(pa.array(["a b c d e f g h", "", None, "one two", "a b c d e f g h i j k l m"]))
    for fp, a, b in zip(resemblance.fingerprints(h, ends).tolist(), ends, ends[1:]):
        own = [int(v) for v in h[a:b]]
        assert fp == sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in own) > len(own))


def test_the_stage_takes_its_candidates_from_simhash(spark, monkeypatch):
    """Without a single band in common, near copies within the fingerprints' reach are still found; unlike texts are not."""
    monkeypatch.setattr(resemblance, "_marked", lambda docs, size, own=resemblance._marked: own(docs, size).withColumn("keys", F.array(F.col("fp"))))
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()}
    assert {i for i in range(60) if i % 2 == 0} <= kept and len(kept) < 40
