"""The production query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmark.llm import chunkdedup, decontam, jaccard, langid, mixing, ngramlm, ogg, secrets, tokenids, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).findings


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeats(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, by a lexicon that the labels extend."""
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_from(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, lexicon).where(f"score >= {toxicity.THRESHOLD}")


def op4_ogg_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media, so each document is first written as an Ogg file of two logical streams."""
    return ogg.streams(ogg.text_media(_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train_on(docs))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_ids(_table(spark, sf_dir, "documents"))


def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scores(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_toxicity, op4_ogg_streams, op5_language_id, op6_decontaminate, op7_token_ids, op8_ngram_scores, op9_jaccard_join, op10_mix_sources)}

ORACLES = {"op1_secret_scan": secrets.scan_sql(), "op4_ogg_streams": ogg.streams_sql(), "op9_jaccard_join": jaccard.links_sql(), "op10_mix_sources": mixing.sample_sql()}
