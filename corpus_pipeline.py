"""The corpus pipeline: toxic documents go, then those that fail the quality rules, then all but one of each group of
near-duplicates, then passages that documents share; what is left is packed into sequences of tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages keep to what their operators
say of nulls, empty tables, repeated rows and further columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelspan.llm import packing, quality_rules, resemblance, substrings, toxicity
from voxelspan.llm.common import materialize, table

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove(docs, least=35)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and the packing order are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
