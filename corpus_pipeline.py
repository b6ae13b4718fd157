"""Training-data pipeline: toxicity, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to
the shared folder and hands it to the next as its docs.  All but the last return the columns that
they were given.  A stage sees only the rows that the stages before it kept, and its decisions take
effect: toxic documents go, one of equal documents stays (the smallest doc_id), one of near duplicates
stays (five-word shingles, similarity 0.8 or more), secrets are replaced by a mark, and what is left is
packed into sequences.

Null and empty texts pass the toxicity stage, are equal to each other, and are packed as an end id.
Columns may hold nulls, documents may have more columns than needed, and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.llm import packing, radix_dedup, secrets, setsketch_dedup, toxicity
from tallyscope.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; the model is learned from the labelled ones among them."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the smallest doc_id."""
    return radix_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id."""
    return setsketch_dedup.deduplicated(docs, size=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark; n_chars follows where a text was changed."""
    others = F.struct(*[c for c in docs.columns if c != "text"])
    masked = secrets.redact(docs.select(others.alias("_doc"), F.xxhash64("text").alias("_before"), F.col("text").alias("_text")), text_col="_text")
    own = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        size = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.xxhash64("_text") != F.col("_before"), size).otherwise(F.col("_doc.n_chars"))
    return masked.select(*[own[c].alias(c) if c in own else F.col("_doc")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The learned and iterative stages cannot be expressed in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
