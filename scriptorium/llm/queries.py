"""The queries opN_<name>: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm import conversation_repair, fill_middle, media, mixing, near_dup, packing, quality_rules, site_style, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter
from scriptorium.llm.common import read

#: Where tokenizer files lie; a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.evaluate(url_filter.page_captures(pages), url_filter.page_list(pages))
    return judged.select("page_id", "url", "blocked", "matched_pattern", "n_matches")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), WORD_BPE)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", *media.FACTS, "pos", "caption", *media.WHOLE)


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over whole pages, a row for each item."""
    return media.page_media(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.compression_bands(docs, quality_rules.fit_bands(docs, read(spark, sf_dir, "labels")))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_style.main_text(read(spark, sf_dir, "pages"))
    counts = [F.col(c) for c in ("n_blocks", "n_by_markup", "n_by_tree")]
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *counts)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(read(spark, sf_dir, "conversations"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_token_counts, op4_suffix_dedup, op5_substring_dedup, op6_near_duplicates, op7_toxicity, op8_packing, op9_media_columns, op10_quality_rules, op11_html_extraction, op12_conversation_repair, op13_fill_middle, page_media)}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
