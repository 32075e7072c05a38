"""Loading and conforming: upserts, keyword dictionaries, document conforming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import text as T


def latest_rows(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key in load order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert_latest(target: DataFrame, batch: DataFrame, key: Sequence[str], order: str, overwrite: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """target with the batch merged in: of equal keys the last row counts, only `overwrite` columns change, and those of
    keep_if_null keep the old value where the new one is null."""
    new = latest_rows(batch, key, order).withColumn("__new", F.lit(True))
    old = target.withColumn("__old", F.lit(True)).alias("o")
    joined = old.join(new.alias("n"), list(key), "full_outer")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.col(c))
            continue
        fresh = F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        kept = F.col(f"o.{c}")
        if c in overwrite:
            value = F.when(F.col("__new"), F.coalesce(fresh, kept) if c in keep_if_null else fresh).otherwise(kept)
        else:
            value = F.when(F.col("__old"), kept).otherwise(fresh)
        out.append(value.alias(c))
    return joined.select(*out)


def insert_ignore(target: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """target and the first batch row of each key that it doesn't have."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    first = batch.withColumn("__place", place).filter("__place = 1").drop("__place")
    return target.unionByName(first.join(target.select(*key), list(key), "left_anti").select(target.columns))


def map_category(rows: DataFrame, mapping: DataFrame, column: str = "category_raw") -> DataFrame:
    """category_main, category_sub, normalized: the mapping by normalised text, else by the raw one, else the first main
    and sub category one of whose terms occurs. mapping: category_raw, category_main, category_sub."""
    out = rows.withColumn("normalized", T.normalize_category(F.col(column)))
    for i, on in enumerate(("normalized", column)):
        side = mapping.select(F.col("category_raw").alias(f"__k{i}"), F.col("category_main").alias(f"__m{i}"), F.col("category_sub").alias(f"__s{i}"))
        out = out.join(F.broadcast(side), F.col(on) == F.col(f"__k{i}"), "left")
    lower = F.lower("normalized")
    main = F.coalesce("__m0", "__m1", T.first_with(lower, T.MAIN_TERMS, T.OTHER))
    sub = F.coalesce("__s0", "__s1", T.first_with(lower, T.SUB_TERMS, T.OTHER))
    return out.withColumn("category_main", main).withColumn("category_sub", sub).drop(*[f"__{c}{i}" for c in "kms" for i in (0, 1)])


def flatten_keywords(dictionary: DataFrame) -> DataFrame:
    """One row a keyword and category. dictionary: keyword, canonical, categories array<struct<category, priority, urgency, weight>>."""
    rows = dictionary.select(F.coalesce("canonical", "keyword").alias("keyword"), F.explode("categories").alias("c"))
    return rows.select("keyword", "c.category", F.coalesce("c.priority", F.lit(5)).alias("priority"), F.coalesce("c.urgency", F.lit("medium")).alias("urgency"), F.coalesce("c.weight", F.lit(1.0)).alias("weight"))


def flatten_synonyms(dictionary: DataFrame) -> DataFrame:
    """synonym, canonical, category; blanks and the word itself left out. dictionary also has synonyms array<string>."""
    rows = dictionary.select(F.coalesce("canonical", "keyword").alias("canonical"), F.explode("synonyms").alias("synonym"), F.col("categories.category").alias("categories"))
    rows = rows.select("synonym", "canonical", F.explode("categories").alias("category"))
    return rows.filter((F.trim("synonym") != "") & (F.col("synonym") != F.col("canonical"))).distinct()


def dictionary_priority(entries: DataFrame) -> DataFrame:
    """Primary category of each keyword: one equal to the keyword, else the highest priority, the first on ties."""
    order = Window.partitionBy("keyword").orderBy((F.col("category") == F.col("keyword")).desc(), F.desc("priority"), "pos")
    return entries.withColumn("__p", F.row_number().over(order)).filter("__p = 1").select("keyword", "category")


def spelling_variants(name):
    """A name with spaces, dashes and dots removed or exchanged, itself left out, sorted."""
    forms = [F.replace(name, F.lit(a), F.lit(b)) for a, b in ((" ", ""), (" ", "-"), ("-", ""), ("-", " "), (".", ""), (".", " "))]
    return F.array_sort(F.array_except(F.array_distinct(F.array(*forms)), F.array(name)))


def card_synonyms(products: DataFrame, guides: DataFrame) -> DataFrame:
    """name, variants: the card names of products and of guides' metadata, each once, blank ones left out."""
    names = products.select("name").union(guides.select("name")).filter(F.trim("name") != "").distinct()
    return names.select("name", spelling_variants(F.col("name")).alias("variants"))


def conform_documents(rows: DataFrame) -> DataFrame:
    """content from content or text, keyword text split at commas, clause number from the title."""
    words = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), T.strip), lambda w: w != "")
    number = F.nullif(F.regexp_extract("title", r"(제\d+조)", 1), F.lit(""))
    return rows.withColumn("content", F.coalesce(F.nullif("content", F.lit("")), "text")).withColumn("keywords", words).withColumn("document_number", number).drop("text")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """id and first id of documents whose normalised content an earlier one has."""
    key = F.sha2(T.normalize_query(F.col("content")), 256)
    rows = docs.select("id", key.alias("key"))
    first = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first.select("key", "first_id"), "key").filter("id <> first_id").select("id", "first_id")


def skip_if_loaded(target: DataFrame, expected: int, least: int = 10, share: float = 0.8) -> bool:
    """Whether the target has enough rows for a load to be left out."""
    n = target.limit(max(least, int(share * expected)) + 1).count()
    return n >= least and n >= share * expected
