"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seektrail.llm import (
    language_id,
    lexical_search,
    mixing,
    neighbours,
    packing,
    quality_classifier,
    quality_rules,
    simhash_groups,
    spelling_groups,
    suffix_dedup,
    token_counts,
    url_filter,
)
from seektrail.llm.near_duplicates import near_duplicates
from seektrail.sources.tables import read_table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_table(spark))
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), weights)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = language_id.held_out(read_table(spark, sf_dir, "documents"))
    model = language_id.fit(documents.filter("not held_out"))
    return language_id.held_out(language_id.identify(documents, model))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(read_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    ratings = quality_classifier.grades(read_table(spark, sf_dir, "labels"))
    model = quality_classifier.train(documents, ratings)
    return quality_classifier.classify(documents, model, at_least=2)


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    return lexical_search.search(read_table(spark, sf_dir, "documents"), items)


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.simhash_groups(read_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_url_filter,
    op2_best_fit_packing,
    op3_quality_rules,
    op4_language_id,
    op5_mix_sources,
    op6_suffix_dedup,
    op7_token_counts,
    op8_nearest_neighbours,
    op9_near_duplicates,
    op10_quality_classifier,
    op11_spelling_groups,
    op12_lexical_search,
    op13_simhash_groups,
)

# A term's weight is taken in doubles; all else of op12 is whole numbers.
_LEXICAL_SEARCH = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), tfs AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs CROSS JOIN corpus GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf)
        // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
    FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
    CROSS JOIN corpus GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank,
    doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

# DuckDB SQL by query. Encoding, learned models, curves, hashes of runs and shingle groups are not
# SQL's; op6 would be a self join of every 100 bytes of the corpus. Those are tested against brute
# force.
ORACLE_SQL: dict[str, str] = {"op12_lexical_search": _LEXICAL_SEARCH}
