"""A training corpus from ``documents``: five stages, each one operator of ``tesserae.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's input. All but the last return the columns of
``documents``; the last one adds copies and taken to them. Extra columns are left behind by the first
stage, whatever their names. An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontaminate, secret_scan, shared, simhash, source_mix
from tesserae.llm import toxicity as toxic_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones among them, calls toxic go.

    Null and empty texts have no hit and stay, as long as labels make the larger part of texts clean.
    Repeated rows stay or go together; rows without a key are judged like others but never learned from.
    """
    docs = shared.document_columns(docs)
    return toxic_words.clean(docs, toxic_words.fit(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays, the one with the least doc_id.

    Null and empty texts are copies of each other. Of rows that repeat a key and text one stays. Rows
    without a key stay, as nothing names them.
    """
    return simhash.deduplicate(shared.document_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing and stay; null and empty items are looked for nowhere.
    Repeated rows stay or go together, with or without a key.
    """
    return decontaminate.clean(shared.document_columns(docs), _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; documents stay, with n_chars counted anew.

    Null texts stay null, with a null n_chars. Repeated rows are masked alike.
    """
    return secret_scan.with_length(secret_scan.redact(shared.document_columns(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with their texts, copies and words taken.

    Null and empty texts have no words and are never taken. A null source is a source. Rows that
    repeat a key, source and text are one document, with the copies of all of them.
    """
    return source_mix.chosen(shared.document_columns(docs))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: SQL can express neither the toxicity model nor SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    A stage's table is deleted when the next one's is written.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name, even=False)
        if before is not None:
            shared.dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
