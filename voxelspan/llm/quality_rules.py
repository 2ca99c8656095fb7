"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once and keeps a failure bit for each together with the measurements. ``record`` writes
it as a table. Policies are versioned bit masks over that ledger: ``apply_policy`` and ``ablation`` never look at a text
again, and a new version of a policy reads the table that is there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspan.llm.common import materialize

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails``, SQL over the measurements in whole numbers, is true."""

    bit: int
    name: str
    fails: str
    base: bool = False


#: Bits are never reused: a new rule gets the next one.
RULES = (
    Rule(0, "few_words", "n_words < 10", base=True),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words", base=True),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    Rule(5, "exclamations", "100 * n_exclaim > 50 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = (
    Policy("web", 1, ("few_words", "repeated_words")),
    Policy("web", 2, ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "exclamations")),
)
BASE_MASK = sum(1 << r.bit for r in RULES if r.base)


def policy(name: str, version: int) -> Policy:
    return next(p for p in POLICIES if (p.name, p.version) == (name, version))


def _gram(i: Column, join: bool) -> Column:
    words = [F.get("_w", i + k) for k in range(5)]
    return F.concat_ws(" ", *words) if join else F.xxhash64(*words)


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaim (bigint).

    A null text measures like an empty one. Windows are first compared by hash; only texts in which two hashes agree
    compare the windows themselves, so equal hashes of different windows do no harm. Words hold no spaces, hence
    windows are equal if and only if their joined strings are.
    """
    own = [c for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in own], text.alias("_t"))
    df = df.withColumns({
        "_w": F.filter(F.split("_t", f"{SPACE}+"), lambda x: x != ""),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    df = df.withColumns({"_n": F.size("_w"), "_chars": F.length(F.array_join("_w", ""))})
    places = F.sequence(F.lit(0), F.greatest(F.col("_n") - 5, F.lit(0)))
    df = df.withColumn("_h", F.when(F.col("_n") >= 5, F.transform(places, lambda i: _gram(i, False))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_same", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_g", F.when(F.col("_same"), F.array_sort(F.transform(places, lambda i: F.struct(_gram(i, True).alias("g"), i.alias("i"))))))
    twice = F.filter("_g", lambda x, k: F.coalesce(F.get("_g", k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_g", k + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    steps = F.transform("_p", lambda x, k: F.least(F.lit(5), F.get("_p", k + 1) - x))  # least() skips the null after the last
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    count = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    df = df.withColumns({
        "n_words": F.col("_n").cast("bigint"),
        "word_chars": F.col("_chars").cast("bigint"),
        "n_symbols": count(SYMBOLS).cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": covered.cast("bigint"),
        "n_lines": F.size("_l").cast("bigint"),
        "n_exclaim": count("!").cast("bigint"),
    })
    return df.drop("_t", "_w", "_l", "_n", "_chars", "_h", "_same", "_g", "_p")


def ledger(docs: DataFrame) -> DataFrame:
    """measure(docs) with fail_bits (bigint): bit r.bit is 1 where rule r fails.

    An input column whose name is one of the measurements' or fail_bits is replaced. Rows are never dropped; repeated
    rows are measured each.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total.cast("bigint"))


def record(docs: DataFrame) -> DataFrame:
    """The ledger of docs as a table in the shared folder: doc_id, measurements and fail_bits, not the texts."""
    return materialize(ledger(docs.select("doc_id", "text")).drop("text"))


def apply_policy(entries: DataFrame, p: Policy, column: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy, and no base rule, fails."""
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(p.mask | BASE_MASK)) == 0)


def ablation(entries: DataFrame, p: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that stay without it.

    One aggregation over the distinct bit masks, at most 2 ** len(RULES) rows whatever the corpus.
    """
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if p.mask >> r.bit & 1]
    each = masks.select("m", "n", F.explode(F.array(*rules)).alias("r")).select("m", "n", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("rule").agg(
        total(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("m") == F.col("bit")).alias("failed_alone"),
        total(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def compare(docs: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, version, n_kept and, for each of its rules, rule, failed, failed_alone, kept_without: all from one recorded ledger."""
    entries, out = record(docs), None
    for p in policies:
        kept = apply_policy(entries, p).agg(F.count(F.when(F.col("kept"), 1)).alias("n_kept"))  # one row
        one = ablation(entries, p).join(F.broadcast(kept)).select(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), "n_kept", "rule", "failed", "failed_alone", "kept_without")
        out = one if out is None else out.unionByName(one)
    return out


def judge(docs: DataFrame, p: Policy = POLICIES[-1]) -> DataFrame:
    """doc_id, the measurements, fail_bits, base_failed and kept of each row of docs, from its recorded ledger."""
    entries = apply_policy(record(docs), p)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), "kept",
    )


def keep(docs: DataFrame, p: Policy = POLICIES[-1]) -> DataFrame:
    """The rows of docs that the policy keeps, with docs' own columns.

    The verdict is unpacked from an array of one, which keeps the filter above the measurements: pushed into them, it
    would repeat each step's expressions in the next's.
    """
    marked = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    judged = apply_policy(marked, p, "_kept").select("_row", F.explode(F.array("_kept")).alias("_kept"))
    return judged.where("_kept").select("_row.*")


#: DuckDB SQL for judge() over documents.
JUDGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(5)) AS o) GROUP BY k),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaim
    FROM w LEFT JOIN cov USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_exclaim > 50 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
    CAST(n_exclaim AS BIGINT) AS n_exclaim, CAST(fail_bits AS BIGINT) AS fail_bits, fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
"""

#: DuckDB SQL for compare() over documents.
COMPARE_SQL = f"""WITH j AS ({JUDGE_SQL}),
p AS (SELECT * FROM (VALUES {", ".join(f"('{p.name}', {p.version}, {p.mask})" for p in POLICIES)}) AS p(policy, version, mask)),
r AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)}) AS r(rule, bit)),
k AS (SELECT policy, version, count(*) FILTER (fail_bits & (mask | {BASE_MASK}) = 0) AS n_kept FROM j, p GROUP BY policy, version)
SELECT policy, version, any_value(n_kept) AS n_kept, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS failed_alone,
    count(*) FILTER (fail_bits & mask & ~bit = 0) AS kept_without
FROM j, p JOIN k USING (policy, version), r WHERE mask & bit <> 0 GROUP BY policy, version, rule"""
