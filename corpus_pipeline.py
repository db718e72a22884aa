"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID: documents whose language can't be told are rejected;
2. SimHash near-duplicates: one document of each group stays, that with the smallest doc_id;
3. benchmark decontamination: contaminated documents are rejected;
4. mixing to target weights: documents are taken whole, repeated or left out, in training order;
5. sharding: every remaining row gets its shard.

Stages 1 to 4 return the columns of ``documents``; stage 5 adds the shard's bits, depth, bytes and
documents. Null or empty texts are rejected by stage 1; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triskele.llm import op3_mix, op4_shard, op6_langid, op8_decontaminate, op10_simhash
from triskele.llm.common import shared_root, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op6_langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op10_simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op8_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op3_mix.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op4_shard.sharded(docs)[0]


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Language ID and SimHash components can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
