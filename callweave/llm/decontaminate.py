"""Benchmark decontamination on a distributed positional inverted index, in DataFrame functions alone.

The index stores postings (word, document, place) of training words. A query is a window of consecutive benchmark words.
From corpus counts of the benchmark's words each window knows its rarest terms; only those are indexed for all documents
(index()). The rarest term's list, shifted by its offset in the window, gives candidate starts; the next rarest one's
list, shifted likewise, is intersected with them; the documents that remain give the postings of all other terms, and a
match needs every term's shifted list to hold the start (slack 0, exact phrase) or a place within `slack` words of it
(proximity match).

Tables that are broadcast (a window's terms, the words looked for) come from the benchmark; above `BROADCAST_ROWS` rows
the same joins are shuffled.

Defined cases: null text has no words; an item of fewer words than the window is one window, one without words none;
repeated rows are each judged (rows are told apart by id and text hash), null doc_ids too; empty tables give no matches;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import computed, likely, lower_ascii, materialise, read_table

#: What separates words once A-Z are lower-cased, and what makes words before that.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
ROW = ["doc", "text_hash"]  # what tells rows apart


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def row_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def occurrences(rows: DataFrame) -> DataFrame:
    """doc, text_hash, place, word: every word of every row. rows: of row_keys()."""
    return rows.select(*ROW, F.posexplode(words_of(F.col("text"))).alias("place", "word"))


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few enough rows. df is a stored table, so that counting is cheap."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """item_id, window (hash of its terms), size, offset, word: one row a term. Rows that repeat an item_id are one item."""
    rows = computed(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), ["item_id"], words=words_of(F.col("text"))).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(width), F.lit(0)))
    rows = rows.select("item_id", "words", F.explode(starts).alias("at"))
    rows = rows.select("item_id", F.slice("words", F.col("at") + 1, width).alias("terms")).withColumn("window", F.xxhash64(F.array_join("terms", " ")))
    rows = rows.dropDuplicates(["item_id", "window"])
    return rows.select("item_id", "window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "word"))


def rank_terms(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """terms with `frequency` in the rows and `rank` in their window, rarest first; windows with a term that never occurs go."""
    vocabulary = materialise(terms.select("word").distinct(), "vocabulary")
    counts = occurrences(rows).select("word").join(_small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    known = terms.join(counts, "word", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    listed = known.groupBy("item_id", "window", "size").agg(F.sort_array(F.collect_list(F.struct("frequency", "word", "offset"))).alias("terms"))
    return listed.filter(F.col("terms")[0]["frequency"] > 0).select("item_id", "window", "size", F.posexplode("terms").alias("rank", "t")).select("item_id", "window", "size", "rank", "t.frequency", "t.word", "t.offset")


def index(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Postings of `words` (a stored table): word, doc, text_hash, place."""
    return occurrences(rows).join(_small(words), "word").select("word", *ROW, "place")


def matches(rows: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """item_id, window, size, doc, text_hash, start of every match. rows: of row_keys(). ranked: stored, of rank_terms()."""
    anchors = materialise(ranked.filter(F.col("rank") < 2).select("word").distinct(), "anchor-words")
    postings = materialise(index(rows, anchors), "postings")
    window = ["item_id", "window"]
    first = ranked.filter(F.col("rank") == 0).select(*window, "size", "word", F.col("offset").alias("first_offset"))
    second = ranked.filter(F.col("rank") == 1).select(*window, F.col("word").alias("next_word"), "offset")
    shifted = materialise(first.join(second, window, "left"), "anchors")
    starts = postings.join(_small(shifted), "word").withColumn("start", F.col("place") - F.col("first_offset")).filter(F.col("start") >= 0 if slack == 0 else F.lit(True)).select(*window, "size", *ROW, "start", "next_word", "offset")
    others = postings.select(F.col("word").alias("next_word"), *ROW, "place")
    if slack:
        near = starts.join(others, ["next_word", *ROW]).filter(F.abs(F.col("place") - F.col("offset") - F.col("start")) <= slack).select(*window, "size", *ROW, "start").distinct()
    else:
        near = starts.withColumn("place", F.col("start") + F.col("offset")).join(others, ["next_word", *ROW, "place"]).select(*window, "size", *ROW, "start")
    candidates = materialise(near.unionByName(starts.filter(F.col("next_word").isNull()).select(*window, "size", *ROW, "start")), "candidates")
    some = candidates.select(*ROW).distinct()
    held = likely(rows.select(*ROW, "text"), candidates, ROW).join(some.hint("shuffle_merge"), ROW, "left_semi")
    wanted = candidates.join(ranked.select(*window, "offset", "word"), window)
    words = materialise(ranked.select("word").distinct(), "window-words")
    there = index(held, words)
    if slack:
        found = wanted.join(there, ["word", *ROW]).filter(F.abs(F.col("place") - F.col("offset") - F.col("start")) <= slack)
    else:
        found = wanted.withColumn("place", F.col("start") + F.col("offset")).join(there, ["word", *ROW, "place"])
    return found.groupBy(*window, "size", *ROW, "start").agg(F.count_distinct("offset").alias("terms")).filter(F.col("terms") == F.col("size")).drop("terms")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n_words, n_hit, n_items, item_ids (sorted), contaminated, and its keys."""
    rows = row_keys(docs)
    ranked = materialise(rank_terms(windows(items, width), rows), "ranked-terms")
    hits = materialise(matches(rows, ranked), "matches")
    covered = hits.select(*ROW, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")).distinct().groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_hit"))
    by_item = hits.groupBy(*ROW).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    base = rows.select("doc_id", *ROW, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(covered.join(by_item, ROW), ROW, "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", *ROW, "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document against every benchmark item."""
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
