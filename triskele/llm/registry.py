"""One query per operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_html, op2_exact_dedup, op3_mix, op4_shard, op5_tokens, op6_langid, op7_warc, op8_decontaminate, op9_toxicity, op10_simhash,
)
from .common import crc_part, shared_root, table


def vocabulary(name: str) -> str:
    """Where the installed vocabulary file lies; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, text = op1_html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op2_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix.ordered_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_extendible_sharding(spark: SparkSession, sf_dir: str, limit: int = op4_shard.LIMIT) -> DataFrame:
    shared_root(spark)
    out, names = op4_shard.sharded(table(spark, sf_dir, "documents"), limit)
    return out.select("doc_id", *[F.col(names[n]).alias(n) for n in ("shard", "shard_depth", "shard_bytes", "shard_docs")])


def op4_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of 64 KiB, so that small tables split too."""
    return op4_extendible_sharding(spark, sf_dir, 64 << 10)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_tokens.token_output(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op6_langid.train(op6_langid.training_rows(docs))
    out, pred, score = op6_langid.predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_part("doc_id", 5), F.lit(0)) == 0
    return out.select("doc_id", held.alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_root(spark)
    return op8_decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op9_toxicity.train(docs, op9_toxicity.learnable(table(spark, sf_dir, "labels")))
    out, score = op9_toxicity.score(docs, model)
    held = F.coalesce(crc_part("doc_id", 3), F.lit(0)) == 1
    return out.select("doc_id", held.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.7).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_simhash.simhash_components(table(spark, sf_dir, "documents"))


SQL = {"op2_grace_exact_dedup": op2_exact_dedup.SQL, "op7_warc_round_trip": op7_warc.SQL, "op3_curriculum_mix": op3_mix.SQL, "op4_extendible_sharding": op4_shard.sql(), "op4_small_shards": op4_shard.sql(64 << 10), "op8_decontamination": op8_decontaminate.sql()}


def queries():
    every = (
        op1_html_extraction, op2_grace_exact_dedup, op3_curriculum_mix, op4_extendible_sharding, op4_small_shards, op5_token_output, op6_language_id,
        op7_warc_round_trip, op8_decontamination, op9_toxicity_scores, op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
