"""Registered queries of the corpus operators: thin, with the columns of their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.llm import anchor_codes, byte_bpe, hmm, licences, maxscore, packing, radix_dedup, secrets, sentencepiece_codec, setsketch_dedup, source_audit, suffix_dedup, toxicity
from tallyscope.llm.common import held_out, table


def op1_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = hmm.score(docs, ~held_out("doc_id", 10)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    done = sentencepiece_codec.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = setsketch_dedup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = radix_dedup.duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, folder, "embeddings"))
    return maxscore.search(vectors, F.col("id") % 50 == 0, k=5)


_MAXSCORE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), folds=5)
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, folder, "documents"), length=200)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = [rule.kind for rule in secrets.BASE]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(kind).__eq__)).cast("bigint").alias(f"n_{kind}") for kind in base]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(_span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents"))
    notices = F.array_join(F.transform("notices", lambda s: F.concat_ws(":", s["line"], s["licence"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), "text_digest", "licence", F.size("notices").cast("bigint").alias("n_notices"), notices.alias("notices")
    )


def op11_anchor_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = anchor_codes.compress(table(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return anchor_codes.with_label_errors(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(anchor_codes.digest(books)).alias("codebooks_sha256")
    )


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(table(spark, folder, "documents"), least_docs=30, most_terms=50)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return done.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


_QUERIES = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_maxscore": op5_maxscore,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_licence_scan": op10_licence_scan,
    "op11_anchor_codes": op11_anchor_codes,
    "op12_source_audit": op12_source_audit,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return {
        "op4_exact_dedup": radix_dedup.DUPLICATES_SQL,
        "op5_maxscore": _MAXSCORE_SQL,
        "op10_licence_scan": licences.scan_sql(),
        "op11_anchor_codes": anchor_codes.codes_sql(),
        "op12_source_audit": source_audit.AUDIT_SQL,
    }
