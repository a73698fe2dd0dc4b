"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, bpe, brown, chat, collocations, exact_dedup, html, mixing, simhash, substring, toxicity, trie, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 4).alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, url_filter.RULES))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "html"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.preference_pairs(chat.adjacent_pairs(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(c)
    return found.select(F.col("_pair").alias("pair_id"), "n_prompt_turns", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES = {f.__name__: f for f in (op1_hilbert_ann, op2_source_mixing, op3_url_filter, op4_html_extraction, op5_chat_formatting, op6_exact_dedup, op7_substring_dedup, op8_simhash_near_dedup, op9_toxicity, op10_bpe, op11_brown_classes, op12_collocations, op13_prefix_trie)}
SQL = {"op2_source_mixing": mixing.ORACLE_SQL, "op3_url_filter": url_filter.ORACLE_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL, "op7_substring_dedup": substring.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_prefix_trie": trie.ORACLE_SQL}
