"""Fill-in-the-middle: a text is cut into prefix, middle and suffix over its code points, and the three are reordered.

Code points come from the tokenizers library: its Split step with a pattern of any one code point, matches isolated,
gives one offset each. The offsets' count is the text's length, and the offsets at two ranks are the cuts. Nothing is
trained. Offsets of a chunk (what stands between spaces, with the space behind it) are asked for once a batch and laid
one after another for the text, as chunks repeat; a long chunk is split some code points at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import byte_slices, give_back
from voxelspan.llm.tokens import gather

# Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that the library splits at once, and those of the longest chunk that a worker remembers.
BLOCK, SHORT = 512, 48
#: Chunks a Python worker remembers, some 40 MB.
REMEMBERED = 200_000


class CodePoints:
    """offsets(chunk): where each code point of it starts, by the library's Split."""

    def __init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(r"[\s\S]"), "isolated")
        self.seen: dict[str, np.ndarray] = {}

    def offsets(self, chunk: str) -> np.ndarray:
        found = self.seen.get(chunk)
        if found is None:
            parts = [np.fromiter((a for _, (a, _) in self.split.pre_tokenize_str(chunk[i : i + BLOCK])), np.int64) + i for i in range(0, len(chunk), BLOCK)]
            found = np.concatenate(parts) if parts else np.empty(0, np.int64)
            if len(chunk) <= SHORT and len(self.seen) < REMEMBERED:
                self.seen[chunk] = found
        return found

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of all texts, each text's from 0, and where each text's begin (one more at the end)."""
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, codes, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), ends - ends[0]
        last = ends[1:] - 1  # a text's last chunk has no space behind it
        tails, codes[last] = np.unique(codes[last], return_inverse=True)
        codes[last] += len(names)
        runs = [self.offsets(f"{c} ") for c in names] + [self.offsets(names[i]) for i in tails]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        flat, stops = gather(np.concatenate(runs) if runs else np.empty(0, np.int64), np.cumsum(lengths) - lengths, lengths, codes)
        starts = np.concatenate([[0], stops])[ends]
        own = np.repeat(np.arange(len(starts) - 1), np.diff(ends))
        flat += np.repeat(stops - lengths[codes] - starts[own], lengths[codes])
        return flat, starts


_CODE_POINTS: list[CodePoints] = []


def _draws(doc_id: Column, salt: str) -> list[Column]:
    """The first four groups of eight digits of a hash of the id, as numbers."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(docs: DataFrame, salt: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output of each row of docs.

    Cuts and forms depend on the id and the text's length alone, so repeated rows come out alike and a null id is a
    number without digits. A null text is empty. A text is plain if it is empty, holds a mark or is drawn to be; its
    counts of code points are null then. Other columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CODE_POINTS:
            _CODE_POINTS.append(CodePoints())
        for batch in batches:
            for some in byte_slices(batch, "text", 4 << 20):
                texts = pc.fill_null(some.column("text").cast(pa.large_string()), "")
                offsets, starts = _CODE_POINTS[0].of_texts(texts)
                out = [[], [], [], [], []]
                draws = zip(*[some.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)])
                for i, (text, (h1, h2, h3, h4)) in enumerate(zip(texts.to_pylist(), draws)):
                    own = offsets[starts[i] : starts[i + 1]]
                    n = len(own)
                    if not n or h3 % 100 >= 100 - plain_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        row = n, "plain", None, None, text
                    else:
                        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a, b = (int(own[r]) if r < n else n for r in (first, second))
                        prefix, middle, suffix = text[:a], text[a:b], text[b:]
                        if h4 % 100 < spm_percent:
                            row = n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                        else:
                            row = n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    doc_id = F.col("doc_id").cast("bigint")
    given = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(_draws(doc_id, salt), 1)])
    return given.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone. Marks can't arise where parts meet: each starts with a letter of its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    whole = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(whole, output)


def digest(docs: DataFrame) -> DataFrame:
    """transform() with hashes in place of texts."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"
DIGEST_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, n, least({_H(1)} % (n + 1), {_H(2)} % (n + 1)) AS a, greatest({_H(1)} % (n + 1), {_H(2)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H(3)} % 100 >= 90 THEN 'plain' WHEN {_H(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
