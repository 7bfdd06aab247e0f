"""One thin query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenql.llm import audio, chaining, langid, lexicon, licences, mixing, ngram_join, quality, repair, suffix_dedup
from lumenql.llm.oracles import ORACLES


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(documents(spark, sf_dir, "doc_id", "lang", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), with_text=False)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.stored_features(documents(spark, sf_dir)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encoded(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir)).select("doc_id", "licence", F.round("dice", 6).alias("dice"), "n_matches")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(documents(spark, sf_dir, "doc_id", "source", "text"), mixing.size_of(), mixing.quality_of())
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return langid.identify(pages, documents(spark, sf_dir, "lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
