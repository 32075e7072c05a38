"""Load checks and small joins: expected rows, expiring cards, unused agents, synonym bags; and the parser of model output."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from callweave.functions import text as T
from callweave.operators.ingest import spelling_variants


def missing_expected(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that are not present, each once."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def unused_agents(pool: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the pool whose key nobody used."""
    return pool.join(used.select(key).distinct(), key, "left_anti")


def expiring_cards(cards: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Cards whose expiry is from as_of to `days` later, both included."""
    return cards.filter(F.col("expiry").between(F.lit(as_of), F.lit(as_of + dt.timedelta(days=days))))


def load_states(tables: dict[str, DataFrame], expected: dict[str, int], own: dict[str, Column], least: int = 10, share: float = 0.8) -> DataFrame:
    """name, rows, skip: whether a load can be left out. A table with an expected count must have `least` rows and `share` of
    that count, any other one a row; where `own` names a condition, a row must meet it (not only default rows are there)."""
    out = None
    for name, df in tables.items():
        rows, real = F.count(F.lit(1)), F.count_if(own.get(name, F.lit(True)))
        enough = (rows >= max(least, share * expected[name])) if name in expected else rows > 0
        one = df.agg(rows.alias("rows"), (enough & (real > 0)).alias("skip")).select(F.lit(name).alias("name"), "rows", "skip")
        out = one if out is None else out.unionByName(one)
    return out


def synonym_bags(entries: DataFrame) -> DataFrame:
    """category, terms: the distinct terms of a category and their spellings, sorted. entries: keyword, category, synonyms."""
    words = F.filter(F.concat(F.array("keyword"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda t: t.isNotNull() & (T.strip(t) != ""))
    rows = entries.select("category", F.explode(F.array_distinct(words)).alias("term")).distinct()
    rows = rows.select("category", F.explode(F.concat(F.array("term"), spelling_variants(F.col("term")))).alias("term"))
    return rows.groupBy("category").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _salvaged(text: str | None) -> str | None:
    """JSON of the complete objects of an answer's first list, which other words may surround or a cut may end."""
    if text is None:
        return None
    reader = json.JSONDecoder()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    try:
        whole, _ = reader.raw_decode(text, min(starts))
        items = whole.get("items") if isinstance(whole, dict) else whole
        if isinstance(items, list):
            return json.dumps(items)
    except ValueError:
        pass
    at = text.find("[", max(text.find('"items"'), 0))
    items = []
    while at >= 0:
        at += 1
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            item, at = reader.raw_decode(text, at)
        except ValueError:
            break
        items.append(item)
        at -= 1
    items = [x for x in items if isinstance(x, dict)]
    return json.dumps(items) if items else None


@F.pandas_udf(StringType())
def _salvage(texts: pd.Series) -> pd.Series:
    return texts.map(_salvaged, na_action="ignore")


def parse_model_output(rows: DataFrame, column: str) -> DataFrame:
    """rows with items (array<struct<speaker, message>>) and failed. Code fences go; a text that is JSON (a list, or an object
    with `items`) is read by the engine, only the others go through Python; without any list the row has failed."""
    kind = "array<struct<speaker: string, message: string>>"
    bare = F.regexp_replace(F.regexp_replace(T.strip(F.coalesce(F.col(column), F.lit(""))), r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")
    fine = F.try_parse_json(bare).isNotNull()

    def read(text: Column) -> Column:
        return F.when(text.startswith("["), F.from_json(text, kind)).otherwise(F.from_json(text, f"struct<items: {kind}>")["items"])

    items = F.coalesce(F.when(fine, read(bare)), read(_salvage(F.when(~fine, bare))))
    return rows.withColumn("items", items).withColumn("failed", F.col("items").isNull())
