"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and its result, stored, is the next one's docs.

Every stage but the last keeps the columns of its input, whatever they are called. An empty table gives an empty result.
Texts of any length are read whole. Rows that repeat a doc_id share their verdicts in near-dedup; elsewhere rows are judged
by id and text, so repeated rows alike. Rows without an id are judged by their text, but near-dedup keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import decontaminate, langid, linededup, neardup, packing
from callweave.llm.common import WORD, fresh, materialise, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of; the model learns from the documents' own lang. Null texts and
    texts without a letter go, and without any labelled row all documents do."""
    return langid.accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier lines match; n_chars follows. A document that had words and loses them all
    (a copy, whose lines all stand in earlier documents) goes; null, empty and blank texts stay as they are."""
    before = fresh("before")
    out = linededup.dedup_lines(docs.withColumn(before, F.col("text").rlike(WORD)), short=True)
    out = out.filter(~F.coalesce(F.col(before) & ~F.col("text").rlike(WORD), F.lit(False))).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Documents without words (null, empty or
    blank, or emptied by line dedup) are near-duplicates of nothing and stay, as do those without an id."""
    key = fresh("gone")
    gone = materialise(neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(key)).distinct(), "near-duplicates")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none."""
    doc, text_hash = fresh("doc"), fresh("hash")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).filter("contaminated")
    gone = materialise(found.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).distinct(), "contaminated")
    return docs.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences, one row a power-of-two piece, with its ids. Null and empty texts are an end id."""
    return packing.decompose(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Tokenizing and a trained model are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
