import hashlib
import random

from pyspark.sql import functions as F

from voxelspan.llm import infill

SCHEMA = "doc_id bigint, text string, output string, form string, h1 string, row string"


def by_hand(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = random.Random(4)
    letters = "ab <>PSM\n\té́\U0001f469‍\U0001f680中\x00  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 17, 90)))) for _ in range(150)]
    texts += ["", None, " ", "  ", "x" * 3000, "\U0001f680" * 1025, "a<", "<P", "S>", "<P>", "a <S> b", "words " * 40_000, "same", "same", "<" * 30, "\n"]
    made = [(i, t, "x", "y", "z", None) for i, t in enumerate(texts)]
    return [*made, (None, "no id at all", None, None, None, None), (7, texts[7], None, None, None, None), (7, texts[8], None, None, None, None)]


def test_against_a_plain_version_and_back(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA)
    made = infill.transform(df).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    expected = sorted(map(repr, [(i, *by_hand(i, t), t or "") for i, t, *_ in given]))
    assert sorted(repr(tuple(r)) for r in made) == expected
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_offsets_are_the_librarys():
    points = infill.CodePoints()
    long = "á\U0001f469" * 700
    assert points.offsets(long).tolist() == list(range(2100)) and long not in points.seen
    assert points.offsets("").tolist() == [] and points.offsets("é ").tolist() == [0, 1]
