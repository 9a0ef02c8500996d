"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, html_extract, kneser_ney, langid, merkle, packing, pii, quality_rules, simhash, substring, topk
from .util import documents, stored


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(documents(spark, sf_dir), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(quality_rules.features(documents(spark, sf_dir)).drop("text"), "features")
    out = quality_rules.judged(rows, stored(quality_rules.thresholds(quality_rules.sketches(rows)), "limits"))  # of known size
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, langid.reference_texts(docs.filter(~langid.held_out())))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("id") % 20 == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneser_ney.perplexities(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kneser_ney.classify(scored).drop("text_hash")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.main_text(pages, html_extract.learn(pages))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_topk_search": op8_exact_topk_search,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op8_exact_topk_search": topk.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_filter_audit": audit.ORACLE,
}
