import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_quality_rules import brute as rules
from tests.llm.test_resemblance import brute as first_of_group
from tests.llm.test_substrings import brute as passages
from tests.llm.test_tokens import crc, library_ids
from voxelspan.llm import toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("lar mo ten vi ka ri so ne".split()) for _ in range(3))
    passage = [word() + "q" for _ in range(50)]
    texts = [None, "", "few words"]
    for i in range(120):
        words = [word() for _ in range(rng.choice([12, 60, 200]))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "grobs"
        if i % 5 == 1:
            words[6:6] = passage
        texts.append(" ".join(words))
        if i % 10 == 3:
            texts += [texts[-1], texts[-1] + " end"]
        if i % 10 == 7:
            texts.append(" ".join(w + "%%%" for w in words))
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, DOCS).write.parquet(f"file://{path}/documents.parquet")
    labels = [(i, 1, int("grobs" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    step = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(step) == ["toxicity", "quality rules", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    a = corpus_pipeline.materialize(step["toxicity"](spark, docs, folder))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert set(rows(a)) == clean and 60 < len(clean) < 200
    b = corpus_pipeline.materialize(step["quality rules"](spark, a, folder))
    assert rows(b) == {i: t for i, t in rows(a).items() if rules(t)[-1]}
    c = corpus_pipeline.materialize(step["SimHash near-dedup"](spark, b, folder))
    ids = sorted(rows(b))
    groups = {ids[k] for k in first_of_group([rows(b)[i] for i in ids])}  # 5-word shingles, similarity 0.8
    assert set(rows(c)) == groups and len(groups) < len(ids)
    d = corpus_pipeline.materialize(step["substring dedup"](spark, c, folder))
    ids = sorted(rows(c))
    want = passages([rows(c)[i] for i in ids], 35)
    assert {i: len(t.split()) for i, t in rows(d).items()} == {i: w[0] - w[1] for i, w in zip(ids, want)} and any(w[1] for w in want)
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    e = step["best-fit packing"](spark, d, folder).collect()
    ids = sorted(rows(d))
    tokens = dict(zip(ids, library_ids([rows(d)[i] for i in ids], "byte_bpe_50k.json")))
    assert all(crc(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in e)
    assert sum(r["length"] for r in e) == sum(map(len, tokens.values()))
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[k] for k in key) for r in whole.collect()) == sorted(tuple(r[k] for k in key) for r in e)


def test_empty_and_strange_rows(spark, folder):
    empty = spark.createDataFrame([], DOCS)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x " * 30, "en", "s", 1), (7, "y " * 30, "en", "s", 1), (7, "y " * 30, "en", "s", 1)], DOCS).withColumns({"score": F.lit(1), "fp": F.lit("x"), "spans": F.lit(2)})
    # the labels know no word of these; repeats fail a quality rule; rows without doc_id are no one's copies; a row for each piece
    left = {"toxicity": [7, 7, None, None], "quality rules": [], "SimHash near-dedup": [7, None, None], "substring dedup": [7, 7, None, None], "best-fit packing": [7, 7, None, None]}
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, folder).collect() == [], name
        out = f(spark, odd, folder)
        assert name == "best-fit packing" or out.columns == odd.columns
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == left[name], name
