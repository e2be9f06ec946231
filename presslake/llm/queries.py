"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm import (chat, clustering, decontaminate, htmltree, langid, license_scan, mixing, neardup, quality, search, sharding,
                           suffixes, urlfilter)
from presslake.llm.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = htmltree.extract(_table(spark, sf_dir, "pages"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = suffixes.deduplicate(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       _sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_shingles", "component_id", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = license_scan.scan(_table(spark, sf_dir, "documents"))
    places = F.transform("places", lambda p: p["at"].cast("long"))
    return told.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
                       F.array_max(places).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join("labels", ",").alias("labels"), "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rules = quality.learn_from(documents, _table(spark, sf_dir, "labels"))
    return quality.judge(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed", "rule", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(0)), F.lit(4)) == 2
    model = langid.train_on(documents.where(~held_out))
    return langid.identify(documents.withColumn("held_out", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sharding.shard(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    log = turns.union(planted).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    return chat.digests(chat.format_chats(log))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract_html": op1_extract_html,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_language": op9_language,
    "op10_shard": op10_shard,
    "op11_chat_format": op11_chat_format,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_ranked_search": op13_ranked_search,
}
