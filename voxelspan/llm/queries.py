"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelspan.llm import collocations, cotraining, infill, packing, quality_rules, sentencepieces, sharding, simhash, substrings, topk, toxicity, warc, wavelet
from voxelspan.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op1_warc"] = warc.ROUND_TRIP_SQL


@query
def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


ORACLES["op3_quality_rules"] = quality_rules.JUDGE_SQL


@query
def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of the policy and what each of their rules costs, from the ledger of op3."""
    return quality_rules.compare(table(spark, sf_dir, "documents"))


ORACLES["quality_policies"] = quality_rules.COMPARE_SQL


@query
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"), least=35)


ORACLES["op5_substring_dedup"] = substrings.DIGEST_SQL


@query
def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


ORACLES["op6_pivot_topk"] = topk.SEARCH_SQL


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), shards=40)


ORACLES["op11_sharding"] = sharding.DIGEST_SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = collocations.COLLOCATIONS_SQL


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))


ORACLES["op13_fill_in_middle"] = infill.DIGEST_SQL
