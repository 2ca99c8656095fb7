import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelspan.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n string, score int"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least, covered=80, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "of", "and", "to", "é", "É", "\U0001f680", "a\x00b", "naïve", *[f"w{i}" for i in range(25)]]
    weights = [9, 2, 6, 5, 5, 3, 2, 2, 1, 1, *[1] * 25]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?", " ; "]
    rows = []
    for i in range(260):
        some = rng.choices(words, weights, k=rng.choice((0, 1, 2, 5, 30, 200)))
        text = "".join(w + rng.choice(ends) for w in some)
        if i % 5 == 0:
            text += " one fixed Phrase here. of the of the of the of the " * rng.randint(1, 4)
        rows.append((text, rng.choice(("en", "en", "en", "fr", None, "und", ""))))
    return [*rows, (None, "en"), ("", "en"), (" \t ", None), ("...", "xx"), ("same words " * 3000, "en"), *[("copied line of words", "fr")] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(7)


@pytest.mark.parametrize("large", [1 << 18, 120, 1])
def test_against_a_plain_version(spark, large):
    rows = corpus()
    found = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=12, large=large).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == brute(rows, 12) and len(found) > 50


def test_report_ends_at_its_length_and_ties_go_by_the_phrase(spark):
    rows = [(f"a{i} b{i}. c{i} d{i} e{i}", "en") for i in range(30)] * 3
    found = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=3, top=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == brute(rows, 3, top=7) and len(found) == 7


def test_hashes_that_clash_are_replaced(spark, monkeypatch):
    rows = corpus()
    tried = []
    real = C.count_words
    monkeypatch.setattr(C, "count_words", lambda docs, seed: tried.append(seed) or real(docs, seed))
    monkeypatch.setattr(C, "clash", lambda words, real=C.clash: real(words) or len(tried) == 1)
    assert C.clash(spark.createDataFrame([("en", b"1", "a"), ("en", b"1", "b")], "lang string, prefix binary, word string"))
    words, _ = C.frequent_phrases(frame(spark, rows).selectExpr("coalesce(lang, 'und') lang", "text"), 12)
    assert tried == [42, 43] and words.count() == len({(w.translate(LOWER), lang or "und") for t, lang in rows for p in re.split("[.,;:!?\n\x0b\x0c\r]", t or "") for w in re.split("[ \t]+", p) if w and lang != ""} | {(w.translate(LOWER), lang) for t, lang in rows if lang == "" for p in re.split("[.,;:!?\n\x0b\x0c\r]", t) for w in re.split("[ \t]+", p) if w})


def test_empty_table(spark):
    assert C.collocations(frame(spark, [])).count() == 0


def test_a_bit_for_each_prefix():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 1000).astype(np.uint64)
    langs = np.full(1000, 5, np.uint64)
    assert (C.spots(langs, h) == C.spots(langs.copy(), h.copy())).all() and len(np.unique(C.spots(langs, h))) > 990
    assert (C.spots(langs, h, h[::-1]) != C.spots(langs, h)).mean() > 0.99
