"""A corpus cleaned and packed in stages, each one an operator of statloom.llm over all that the stage before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A row is told by its id and its text's hash, so rows that repeat an id with other texts get verdicts of their own.
Empty tables go through every stage and give no rows; null text, language, source or id are no errors (a null text
has too few words for the quality rules); extra columns stay, whatever their names, up to the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, kneser_ney, packing, quality_rules, simhash, substring
from statloom.llm.util import documents, stored

#: No DuckDB SQL computes SimHash components or packing; the stages are tested against brute force.
ORACLE_SQL = None
#: Of packing: about 60 MB less a Python worker than with 250,000, for more CPU seconds.
MEMO = 30_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = kneser_ney.classify(kneser_ney.perplexities(docs, labels))
    rejected = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    rejected = stored(rejected, "rejected")  # so its size is known before texts meet it
    return docs.join(rejected, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    keyed = docs.withColumn("_h", F.xxhash64("text", "lang", "source"))
    rows = stored(quality_rules.features(keyed.select("doc_id", "_h", "text", "lang", "source")).drop("text"), "features")
    limits = stored(quality_rules.thresholds(quality_rules.sketches(rows)), "limits")
    rejected = quality_rules.judged(rows, limits).filter(~F.col("kept")).select("doc_id", "_h").distinct()
    return _met(keyed, stored(rejected, "rejected"), "left_anti").drop("_h")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: of the smallest id, and among rows that repeat it of the smallest text hash.

    A row without an id stays only if its component has no other row; of rows alike in id and text, one stays."""
    groups = simhash.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("_h")), keep=("_h",))
    rows = stored(groups.groupBy("doc_id", "_h").agg(F.first("component").alias("component"), F.first("component_id").alias("component_id"), F.count("*").alias("n")), "groups")
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = heads.groupBy("component").agg(F.min("_h").alias("least"))
    gone = rows.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "_h").unionByName(heads.join(least, "component").filter("_h <> least").select("doc_id", "_h"))
    repeated = stored(rows.filter("n > 1").select("doc_id", "_h"), "repeated")
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    kept = _met(keyed, stored(gone, "gone"), "left_anti")
    return _met(kept, repeated, "left_anti").unionByName(_met(kept, repeated, "left_semi").dropDuplicates(["doc_id", "_h"])).drop("_h")


def _met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """`rows` that meet (or don't) a row of `keys` by id and hash."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"))
    return rows.join(keys, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_h"] == F.col("_k")), how)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; documents of which nothing is left go."""
    out = substring.remove_repeats(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    out = out.filter((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document left; a small memo, as executors also hold what stages before have left in memory."""
    return packing.pack(packing.pieces(docs, bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")), memo=MEMO))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
