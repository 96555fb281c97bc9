"""Registered queries of the operators: each over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (chunk_bpe, filter_audit, fuzzy_lines, language, leak_search, licenses, pseudonyms,
                            signature_trees, simhash, spelling, target_ratio, trie_counts, url_templates)
from cohortlens.llm.common import table, tokenizer_file


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.replace_private(table(spark, sf_dir, "documents"))


def op4_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_ratio.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_leak_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_classes(table(spark, sf_dir, "documents"))


def op11_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.near_copies(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_simhash_dedup, op3_pseudonyms, op4_trie_counts, op5_url_templates, op6_chunk_bpe, op7_target_ratio, op8_leak_search, op9_language,
    op10_fuzzy_lines, op11_signature_join, op12_filter_audit, op13_spelling_groups)}

ORACLES = {"op1_license_scan": licenses.scan_sql(), "op5_url_templates": url_templates.judge_sql(),
           "op11_signature_join": signature_trees.near_copies_sql(), "op12_filter_audit": filter_audit.audit_sql()}
