"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_ann, chosen_path, language_id, mixing, phrase_tiles, piece_codec, quality_rules,
    quality_trees, secret_scan, simhash_balls, token_counts, toxicity, variant_trie,
)
from .common import crc_remainder, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_quality_rules", quality_rules.judge_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op2_piece_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumn(
            "over_limit", F.col("n_tokens") > 1024)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labels whose id's crc32 is no multiple of 5; remainder
    4 sets the threshold."""
    fold = crc_remainder("doc_id", 5)
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                          learn=fold != 0, calibrate=fold == 4)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "distance")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_remainder("doc_id", 3)
    named = language_id.name_documents(docs, language_id.train(docs, learn=fold != 1))
    return named.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "accepted")


@query("op3_source_mix", mixing.mix_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_secret_scan", secret_scan.scan_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@query("op8_chosen_path_join", chosen_path.similar_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_documents(table(spark, sf_dir, "documents")).drop("set_key")


@query("op4_block_neighbours", block_ann.nearest_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op6_quality_trees")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels whose id's crc32 leaves 0, 1 or 3 modulo 4;
    remainder 3 decides when to stop."""
    docs, fold = table(spark, sf_dir, "documents"), crc_remainder("doc_id", 4)
    trees = quality_trees.train(docs, table(spark, sf_dir, "labels"), learn=fold != 2, hold=fold == 3)
    return quality_trees.score_documents(docs, trees).select(
        "doc_id", (fold == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_simhash_balls")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_balls.near_documents(table(spark, sf_dir, "documents"))


@query("op13_variant_trie", variant_trie.variants_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_trie.variants(table(spark, sf_dir, "documents"))


@query("op12_phrase_tiles", phrase_tiles.collocations_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tiles.collocations(table(spark, sf_dir, "documents"))
