"""Conforming documents, agents and customers."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import text as T


def remap_document_ids(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs: id, consultation_id. mapping: old_id (unique), new_id. consultation_id is rewritten to its old form, or to id
    where it is empty, and then to the new id; unmatched rows keep the old form."""
    raw = F.coalesce("consultation_id", F.lit(""))
    old = F.when(raw.startswith("CS-HANA-"), F.replace(raw, F.lit("CS-HANA-"), F.lit("hana_consultation_"))).when(raw != "", raw).otherwise(F.col("id").cast("string"))
    rows = docs.withColumn("old_id", old).join(mapping.select("old_id", "new_id"), "old_id", "left")
    return rows.withColumn("consultation_id", F.coalesce("new_id", "old_id")).select(docs.columns)


def overlay(metadata: Column, entries: dict[str, Column]) -> Column:
    """metadata with the entries put over it."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(F.map_filter(F.coalesce(metadata, empty), lambda k, _: ~k.isin(*entries)), F.create_map(*pairs))


def unify_source_docs(cards: DataFrame, guides: DataFrame) -> DataFrame:
    """cards: id, name, main_benefits, performance_condition, card_type, brand, metadata. guides: id, title, content,
    category, document_type, metadata. Both as id, content, metadata (map of text)."""
    content = F.concat_ws("\n\n", *(F.coalesce(c, F.lit("")) for c in ("name", "main_benefits", "performance_condition")))
    card = {"title": F.col("name"), "card_name": F.col("name"), "category": F.col("card_type"), "category1": F.col("card_type"), "category2": F.col("brand"), "source_table": F.lit("card_products")}
    guide = {"title": F.col("title"), "category": F.col("category"), "category1": F.col("document_type"), "source_table": F.lit("service_guide_documents")}
    left = cards.select(F.col("id").cast("string").alias("id"), content.alias("content"), overlay(F.col("metadata"), card).alias("metadata"))
    return left.unionByName(guides.select(F.col("id").cast("string").alias("id"), "content", overlay(F.col("metadata"), guide).alias("metadata")))


def hallucination_filter(rows: DataFrame, phrases: list[str], text: str = "message") -> DataFrame:
    """Rows whose text holds none of the phrases and is not empty."""
    found = [F.contains(text, F.lit(p)) for p in phrases]
    kept = rows.filter(T.strip(F.col(text)) != "")
    return kept.filter(~reduce(Column.__or__, found)) if found else kept


def active_agents(employees: DataFrame, default_id: object, prefix: str = "상담") -> DataFrame:
    """Agents with status active, in a department whose name starts with the prefix, but for the default one."""
    return employees.filter((F.col("status") == "active") & (F.col("id") != F.lit(default_id)) & F.col("department").startswith(prefix))


def customer_update(customers: DataFrame, outcomes: DataFrame, as_of: dt.date) -> DataFrame:
    """customers: id, type_history, current_type_code, last_consultation_date, total_consultations, resolved_first_call.
    outcomes: customer_id, ord, type_history, type_code, fcr, one row a call. As if applied one by one in order of ord:
    the total grows by each, the other columns hold the last (resolved_first_call is set, not added to)."""
    last = F.max_by(F.struct("type_history", "type_code", "fcr"), "ord")
    new = outcomes.groupBy(F.col("customer_id").alias("id")).agg(last.alias("new"), F.count(F.lit(1)).alias("calls"))
    hit = F.col("calls").isNotNull()
    put = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    changed = {
        "type_history": put(F.col("new.type_history"), "type_history"), "current_type_code": put(F.col("new.type_code"), "current_type_code"),
        "last_consultation_date": put(F.lit(as_of), "last_consultation_date"), "resolved_first_call": put(F.col("new.fcr"), "resolved_first_call"),
        "total_consultations": F.when(hit, F.coalesce("total_consultations", F.lit(0)) + F.col("calls")).otherwise(F.col("total_consultations")),
    }
    return customers.join(new, "id", "left").withColumns(changed).select(customers.columns)


def agent_pools(calls: DataFrame, agents: DataFrame, sizes: dict[str, int], default: int = 5, catch_all: str = "기타") -> DataFrame:
    """calls: category. agents: id, created_order. category, slot (from 0), agent_id: categories by descending number of
    calls (ties by name) take the next agents that no larger one has; the catch-all has every agent.

    The windows without a partition run over one row a category and one an agent, after the calls are counted."""
    wanted = F.coalesce(_size_of(sizes), F.lit(default))
    counts = calls.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "category").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.filter(F.col("category") != catch_all).withColumn("size", wanted).withColumn("low", F.coalesce(F.sum("size").over(order), F.lit(0)))
    ranges = ranges.select("category", "low", (F.col("low") + F.col("size")).alias("high"))
    ranges = ranges.unionByName(counts.filter(F.col("category") == catch_all).select("category", F.lit(0).alias("low"), F.lit(1 << 40).alias("high")), allowMissingColumns=True)
    numbered = agents.select(F.col("id").alias("agent_id"), (F.row_number().over(Window.orderBy("created_order", "id")) - 1).alias("at"))
    pools = numbered.join(ranges, (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return pools.select("category", (F.col("at") - F.col("low")).cast("long").alias("slot"), "agent_id")


def _size_of(sizes: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for category, size in sizes.items():
        out = F.when(F.col("category") == category, size).otherwise(out)
    return out


def valid_patterns(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(category, pattern) rules whose pattern compiles."""
    out = []
    for category, pattern in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append((category, pattern))
    return out
