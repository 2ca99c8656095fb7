import random
import re

from pyspark.sql import functions as F

from voxelspan.llm import quality_rules as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    m = [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]
    base = m[0] < 10 or 100 * m[4] > 20 * m[0]
    kept = not base and 100 * m[2] <= 30 * m[0] and 100 * m[3] <= 30 * len(lines) and 2 * m[0] <= m[1] <= 15 * m[0] and 2 * text.count("!") <= m[0]
    return (*m, base, kept)


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", "\x0bü \x0c é 𝄞 %%", "x\n\nx\n x\nx ", "#*$%&|<> " * 12]
    for n in (9, 10, 30, 300):
        out += [" ".join(rng.choice("ab cd ef ghi ü, %x !".split()) for _ in range(n)), "\n".join(f"Line{rng.randrange(n)} of it" for _ in range(n))]
    base = " ".join(f"w{i}" for i in range(40))
    return out + [base, base + " " + base, base + "!" * 21, " ".join(f"long{i}" for i in range(30000))]


def test_against_brute_force(spark):
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    data += [data[-2], (None, data[-2][1], None, None, None)]
    docs = spark.createDataFrame(data, DOCS).withColumns({"n_words": F.lit("clash"), "kept": F.lit(3), "fail_bits": F.lit("x")})
    got = {(r["doc_id"], *(r[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split())) for r in Q.judge(docs).collect()}
    assert got == {(d[0], *brute(d[1] if len(d[1] or "") < 100000 else d[1][:0] or None)) if len(d[1] or "") < 100000 else (d[0], 30000, len(d[1].replace(" ", "")), 0, 0, 0, False, True) for d in data}
    kept = Q.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d[0]) for d in data if (len(d[1] or "") >= 100000 or brute(d[1])[-1]))


def test_policies_and_ablation_use_the_ledger_alone(spark):
    entries = spark.createDataFrame([(0,), (4,), (4,), (12,), (1,), (33,)], "fail_bits bigint")
    got = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in Q.ablation(entries, Q.policy("web", 2)).collect()}
    assert got["symbols"] == (3, 2, 3) and got["few_words"] == (2, 1, 2) and got["exclamations"] == (1, 0, 1)
    assert [r["kept"] for r in Q.apply_policy(entries, Q.policy("web", 1)).collect()] == [True, True, True, True, False, False]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert Q.judge(empty).collect() == [] and {r["failed"] for r in Q.ablation(Q.ledger(empty), Q.POLICIES[-1]).collect()} == set()
