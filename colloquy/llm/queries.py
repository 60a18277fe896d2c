"""The operators' queries over the tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language, licenses, media, mixing, quality, ranked_search, runs, simhash, token_count, toxicity, url_filter
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


#: Path of the tokenizer's file on driver and executors.
TOKENIZER = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), TOKENIZER)


#: (host, path, verdict), fixed by the query's contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), rules)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    return toxicity.toxicity_scores(docs, model)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.quality_scores(docs, labels.where(~quality.held_out()))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(read_table(spark, sf_dir, "documents"), prepare=runs.rebuilt))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_url_filter, op4_media_columns, op5_mix_sources, op6_toxicity, op7_decontaminate, op8_html_text, op9_language, op10_simhash, op11_ranked_search, op12_quality, op13_periodic_runs)}

ORACLE_SQL = {"op3_url_filter": url_filter.ORACLE_SQL, "op5_mix_sources": mixing.ORACLE_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL}
