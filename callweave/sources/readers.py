"""Readers and sinks of call-centre files. Parsers take rows of raw text or structs, so any source can feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.sources.stored import shared_folder

UTTERANCES = "array<struct<speaker string, message string>>"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each. A file is one task's work, so exports come as many files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def chat_examples(rows: DataFrame) -> DataFrame:
    """rows: messages (array of role, content). Adds system, user (without its `Raw Stream` header line) and utterances
    (the assistant's JSON; null where it is none). Of several messages of a role the first counts."""

    def content(role: str) -> Column:
        return F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]

    user = F.regexp_replace(content("user"), r"^\s*Raw Stream[^\n]*(\n|$)", "")
    return rows.withColumns({"system": content("system"), "user": T.strip(user), "utterances": F.from_json(content("assistant"), UTTERANCES)}).drop("messages")


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return chat_examples(spark.read.schema("id long, messages array<struct<role string, content string>>").json(path))


def read_eval_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and perhaps a byte-order mark. Malformed lines are left out, whichever columns are read."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("columnPruning", False).option("escape", '"').csv(path)


def append_results_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_where(rows: DataFrame, equal: dict[str, object], limit: int | None = None) -> DataFrame:
    """Rows that meet every equality (they reach the scan); as in SQL, a null condition meets none."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows if limit is None else rows.limit(limit)


def case_blocks(rows: DataFrame) -> DataFrame:
    """rows: value (a whole text of `[case n]` blocks) and others. case_id (place from 1), script, stt; blocks without
    both parts are left out."""
    blocks = rows.select("*", F.posexplode(F.split("value", r"\[case \d+\]")).alias("case_id", "block")).filter("case_id > 0")
    parts = F.split("block", r"\[script\]|\[stt\]")
    return blocks.filter(F.size(parts) >= 3).withColumns({"script": T.strip(parts[1]), "stt": T.strip(parts[2])}).drop("value", "block")


def read_case_text(spark: SparkSession, path: str) -> DataFrame:
    return case_blocks(spark.read.text(path, wholetext=True))


def dialogue_map(rows: DataFrame) -> DataFrame:
    """rows: value (JSON object of case to utterances) and others. case, seq, speaker, message."""
    cases = rows.select("*", F.explode(F.from_json("value", f"map<string, {UTTERANCES}>")).alias("case", "turns")).drop("value")
    turns = cases.select("*", F.posexplode("turns").alias("seq", "turn")).drop("turns")
    return turns.select(*(c for c in turns.columns if c != "turn"), "turn.speaker", "turn.message")


def scratch(spark: SparkSession) -> str:
    """A new folder that every executor sees."""
    return shared_folder(spark, "files")
