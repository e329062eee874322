"""The queries of the subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfold.llm import decontamination, image_copies, language_id, lm_scoring, mixing, oracles, prefix_trie, setsketch, sharding, suffix_dedup, toxicity, url_filter, vector_codes, warc
from larkfold.llm.common import table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the labelled document of the same id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op2_image_descriptor_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is the byteplot of each page's html."""
    images = table(spark, sf_dir, "pages").select("page_id", image_copies.byteplot(F.col("html")).alias("image"))
    return image_copies.image_copies(images, key="page_id")


def op3_setsketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op4_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = mixing.fair_queue(table(spark, sf_dir, "documents"))
    return queue.select("doc_id", "size", "source_size", "target", (F.size("finish") * F.col("size")).cast("long").alias("taken"))


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.archive_digest(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_sha256")


def op7_merge_sorted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled as good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op10_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations take their first turns from the one their group of five is named by."""
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_image_descriptor_copies": op2_image_descriptor_copies,
    "op3_setsketch_near_dups": op3_setsketch_near_dups,
    "op4_weighted_fair_mix": op4_weighted_fair_mix,
    "op5_hash_tree_shards": op5_hash_tree_shards,
    "op6_content_addressed_warc": op6_content_addressed_warc,
    "op7_merge_sorted_suffixes": op7_merge_sorted_suffixes,
    "op8_string_kernel_language": op8_string_kernel_language,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_aho_corasick_decontamination": op10_aho_corasick_decontamination,
    "op11_counterfactual_toxicity": op11_counterfactual_toxicity,
    "op12_segment_mean_codes": op12_segment_mean_codes,
    "op13_prefix_doubling_trie": op13_prefix_doubling_trie,
}

#: The other queries can't be put in SQL; tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": oracles.OP1,
    "op3_setsketch_near_dups": oracles.OP3,
    "op4_weighted_fair_mix": oracles.OP4,
    "op6_content_addressed_warc": oracles.OP6,
    "op10_aho_corasick_decontamination": oracles.OP10,
    "op12_segment_mean_codes": oracles.OP12,
    "op13_prefix_doubling_trie": oracles.OP13,
}
