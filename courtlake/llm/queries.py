"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm import decontamination, html_text, language, mixing, near_dup, neighbours, phrases, quality, ranking, repeats, statements, token_counts, token_store, url_filter
from courtlake.llm.common import table

QUALITY_SCORE = 0.7
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = quality.train(documents, labels.where(~held_out))
    rows = quality.quality_scores(documents.withColumn("held_out", held_out), net, ["doc_id", "held_out"])
    return rows.select("kept.*", "score", F.when(F.col("score") >= QUALITY_SCORE, 1).otherwise(0).alias("predicted"))


def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    field = language.train(documents.where(~held_out))
    return language.languages(documents.withColumn("held_out", held_out), field, ["doc_id", "held_out"]).select("kept.*", "lang_pred", "score")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=4, threshold=30, covered=80, first=2000)


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeated_spans(table(spark, sf_dir, "documents"), ["doc_id"], span=35)
    removed = F.aggregate(F.col("spans.length"), F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.select("kept.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_duplicates,
    "op2_page_texts": page_texts,
    "op3_token_ids": token_ids,
    "op4_nearest_vectors": nearest_vectors,
    "op5_url_rules": url_rules,
    "op6_benchmark_contamination": benchmark_contamination,
    "op7_quality_scores": quality_scores,
    "op8_piece_counts": piece_counts,
    "op9_languages": languages,
    "op10_source_mix": source_mix,
    "op11_phrase_collocations": phrase_collocations,
    "op12_ranked_search": ranked_items,
    "op13_repeated_passages": repeated_passages,
}

ORACLE = {name: text for name, text in statements.STATEMENTS.items() if name in QUERIES}
