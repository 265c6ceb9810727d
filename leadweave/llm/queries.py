"""The opN queries: each applies an operator to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, gam, jaccard, langid, lines, pii, quality, repeats, resampling, simhash, token_files, vectors
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    n = [count(kind) for kind in pii.BASE]
    added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    whole = F.size("spans").cast("bigint").alias("n_spans")
    return found.select("doc_id", *n, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), added, whole)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.col("text").isNull() | ((F.col("text") == "") & (F.col("_n_removed") > 0))
    n = F.when(none, F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return out.select("doc_id", F.col("_n_removed").alias("n_removed"), n.alias("n_lines_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digests(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op10_substring_dedup": repeats.ORACLE_SQL,
    "op11_importance_resampling": resampling.ORACLE_SQL,
    "op12_vector_codes": vectors.ORACLE_SQL,
    "op13_ngram_jaccard": jaccard.ORACLE_SQL,
}
