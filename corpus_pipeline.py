"""A corpus pipeline of five stages over ``documents``.

1. toxicity: documents that the compression-distance classifier rejects go.
2. near duplicates: of each class of linked documents one row stays, the one
   with the smallest id (then the smallest remaining columns).
3. secrets: every span that the secret scan finds is replaced by a mark.
4. source mix: each document is repeated as often as the mix takes it (words
   taken over its size, rounded half up); documents it takes less than half of
   go.  A document without words stays once, having nothing to mix.
5. SentencePiece: texts are encoded and decoded again.

Each stage reads all that the stage before it kept.  Stages 1 to 4 return the
columns of ``documents``; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcart.llm import chosen_path, mixing, piece_codec, queries, secret_scan, toxicity
from loomcart.llm.common import DOC_COLUMNS, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the tables in ``sf_dir``, applied to ``docs`` row by row."""
    model = queries.toxicity_model(spark, sf_dir)
    return toxicity.without_toxic(docs.select(*DOC_COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_of_each(docs.select(*DOC_COLUMNS), order=("doc_id", "source", "lang", "n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` is the length of the new text where the text changed."""
    kept = ("text", "lang", "source", "n_chars")
    found = secret_scan.scan(docs.select(*DOC_COLUMNS), keep=kept)
    text = F.when(F.col("text").isNotNull(), secret_scan.redacted(F.col("text")))
    return found.select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*DOC_COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    return piece_codec.encode_documents(
        docs.select(*DOC_COLUMNS), queries.vocabulary("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256", "round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_texts),
]

# SQL can express neither the classifier, the join's classes nor the encoder;
# the tests spot-check the stages' rows on a small table.  The operators have
# tests of their own (brute force, held-out accuracy or a library).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read
    again before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
