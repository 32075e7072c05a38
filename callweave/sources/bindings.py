"""Logical call-centre tables bound to the test tables, so that every job has rows that grow with them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for "today" in every query.
AS_OF = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor("value").cast("long")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("customer_id"),
        (F.col("k") % 20).alias("agent_id"),
        F.col("event_type").alias("category_raw"),
        F.col("event_type").alias("category_sub"),
        F.to_date("ts").alias("call_date"),
        F.col("ts").alias("call_ts"),
        F.format_string("%02d:%02d", (seconds / 60).cast("long"), seconds % 60).alias("call_duration"),
        F.lit("completed").alias("status"),
        "k",
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("department"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "department")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grade"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("downloaded_by"), F.col("k").alias("consultation_id"), F.col("ts").alias("downloaded_at"))


def simulation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.floor("value").cast("long") % 101
    return _events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("employee_id"), score.alias("overall_score"), (score >= 70).alias("passed"),
        (F.col("k") % 5).alias("scenario_id"), F.floor("value").cast("long").alias("call_seconds"), F.col("ts").alias("started_at"),
        F.when(F.col("k") % 2 == 0, "practice").otherwise("exam").alias("kind"), F.concat(F.lit("c"), F.col("k") % 4).alias("category"),
        (F.col("k") % 10 / 10).alias("similarity"), F.when(F.col("k") % 7 > 0, F.col("k") % 100 / 100).alias("completion"),
    )


def personality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("N1", "N2", "N3", "S1", "S2", "S3")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"), "ts", F.get(codes, (F.col("k") % 6).cast("int")).alias("label"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("k") % 3 == 0, F.col("event_type")).alias("value"), (F.col("k") % 4).alias("hits"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "agent")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), speaker.alias("speaker"), F.col("text").alias("message")).filter("speaker IS NOT NULL")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of utterances: consecutive rows of one speaker."""
    rows = utterances(spark, sf_dir).select("session_id", "seq", "speaker", F.posexplode(F.split("message", "\n")).alias("pos", "message"))
    return rows.filter(F.trim("message") != "").select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "speaker", "message")


def guide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.col("source").alias("category"), F.col("lang").alias("document_type"))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.col("n_chars").cast("long")
    speed = (F.col("doc_id") % 100 / 100).alias("ttft"), (tokens % 50).cast("double").alias("tps"), F.when(F.col("doc_id") % 5 > 0, tokens).alias("tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"), *speed)
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), "model", F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("res"), "ttft", "tps", "tokens")
