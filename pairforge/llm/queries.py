"""The queries of this package: thin wrappers that apply each operator to its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.llm import (
    ann, bpe, embed_dedup, langid, line_dedup, minhash, packing, quality, resampling, suffix_dedup,
    token_files, warc, whitening,
)
from pairforge.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op9_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.octet_length(text).alias("kept_bytes"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nn_descent, op2_suffix_dedup, op3_concat_packing, op4_word_bpe, op5_chosen_path, op6_rule_quality,
        op7_capture_index, op8_language_id, op9_sorted_passes, op10_line_templates, op11_token_files,
        op12_polarisation_whitening, op13_prefix_crc_resampling,
    )
}
#: None of the queries can be said in SQL over whole tables; tests compare each with a plain version.
ORACLE: dict[str, str] = {}
