"""Queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, collocations, repeats, source_mix, warc
from .shared import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op3_token_counts"] = op3_token_counts


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(documents(spark, sf_dir))


QUERIES["op10_secret_scan"] = op10_secret_scan


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


QUERIES["op4_simhash"] = op4_simhash


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    from .chat_windows import read_back, windows

    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return read_back(windows(convs.unionByName(extra)))


QUERIES["op5_chat_windows"] = op5_chat_windows
ORACLE["op5_chat_windows"] = chat_windows.ORACLE_SQL.replace("{conversations}", "conversations")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(documents(spark, sf_dir))


QUERIES["op7_quality_rules"] = op7_quality_rules


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix

    return mix(documents(spark, sf_dir))


QUERIES["op2_source_mix"] = op2_source_mix
ORACLE["op2_source_mix"] = source_mix.ORACLE_SQL.format(documents="documents")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES["op8_toxicity"] = op8_toxicity


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))


QUERIES["op6_language_id"] = op6_language_id


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each overlapping pair of a document and a benchmark item; clean documents have no row."""
    from .decontaminate import overlaps

    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op9_decontaminate"] = op9_decontaminate


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.convert(pages, fresh_path(spark, "warc")).withColumnRenamed("key", "page_id")


QUERIES["op1_warc"] = op1_warc
ORACLE["op1_warc"] = warc.ORACLE_SQL.format(pages="pages")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, those that repeated passages cover, and the digest of the rest."""
    return repeats.cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES["op11_substring_dedup"] = op11_substring_dedup
ORACLE["op11_substring_dedup"] = repeats.ORACLE_SQL


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_tokens

    return align_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


QUERIES["op12_cross_tokenizer_alignment"] = op12_cross_tokenizer_alignment


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


QUERIES["op13_phrase_collocations"] = op13_phrase_collocations
ORACLE["op13_phrase_collocations"] = collocations.ORACLE_SQL
