"""A training corpus from `documents` in five stages, each a Spark job over all its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from weftline.session import ship, table, written


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _those(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id and text are (left_semi) or are not (left_anti) among `decided` (doc_id, text_key).

    Rows that repeat both are decided alike; rows of one doc_id and other texts each by its own text.
    """
    keys = decided.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_key("text") == F.col("__key"))
    return docs.join(keys, same, how)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are. Null and empty texts fail on length; an empty table stays empty."""
    return _those(docs, quality_rules.quality_rules(docs).filter("kept"), "left_semi")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that lost lines and have no word left go.

    n_chars, where there is such a column, follows the text. Null texts stay null.
    """
    columns = docs.columns
    kept = {c: f"__{c}" for c in ("n_lines", "n_removed") if c in columns}  # the operator counts under these names
    found = line_dedup.line_dedup(docs.withColumnsRenamed(kept))
    gone = F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]") & (F.col("n_removed") > 0)
    left = found.filter(~gone).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in kept.items()})
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, with all rows that repeat it and its text.

    Rows without a word or a doc_id stay. Texts are compared whole; an empty table stays empty and
    columns of any name are kept.
    """
    return _those(docs, near_dedup.near_duplicates(docs).filter("kept"), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts, and all documents where the benchmark is empty, stay. Rows that repeat an id
    and a text are decided alike, rows of one id and other texts, or without an id, each by its
    own text, whole. An empty table stays empty; columns of any name are kept.
    """
    return _those(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences.

    A null or empty text is one piece of one token. Rows that repeat an id or a text are packed each on
    its own, null ids too; pieces of one length are interchangeable and which goes where is fixed by
    their values. An empty table gives an empty one.
    """
    return packing.pack_documents(docs)


def _shipped(stage):
    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return call


STAGES = [
    ("quality_rules", _shipped(quality_rules_stage)),
    ("line_dedup", _shipped(line_dedup_stage)),
    ("near_dedup", _shipped(near_dedup_stage)),
    ("decontamination", _shipped(decontamination_stage)),
    ("packing", _shipped(packing_stage)),
]

#: SQL cannot express weighted sampling or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
