"""Nearest vectors of a stated query set, by blocks.

Rows are packed into blocks of vectors inside the tasks that read them, queries into blocks of their own. Each block of rows
meets each block of queries, a task multiplies the two and keeps k rows a query, and what is left of a task's blocks is
merged before anything is shuffled: one pass of the vectors, k rows a task and query, nothing through the driver. Blocks of
queries are broadcast where their measured size allows it; beyond, the blocks are joined on the number of the query block
and a salt, so that no query block is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.sources.stored import stored

#: Numbers of a block of rows or of queries, and of all queries that are broadcast.
BLOCK_VALUES, BROADCAST_VALUES = 1 << 18, 1 << 24
SALTS = 64
#: Scores of rows and queries that a task holds at once.
TILE_VALUES = 1 << 20
_BLOCK = "ids binary, vectors binary, width int, tags array<array<string>>"
_NONE = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
_HITS = "query_id long, id long, score double"


def _packed(rows: DataFrame, id: str, tags: str | None) -> DataFrame:
    """Blocks of vectors of one width: ids and vectors as bytes. Null vectors and those with a null component go."""
    columns = [F.col(id).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col(tags) if tags else F.array()).cast("array<string>").alias("tags")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            for width in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == width)
                step = max(1, BLOCK_VALUES // max(width, 1))
                for a in range(0, len(at), step):
                    part = batch.take(pa.array(at[a : a + step]))
                    ids = part.column("id").to_numpy().astype("<i8").tobytes()
                    values = part.column("embedding").flatten().to_numpy().astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([values], pa.binary()), pa.array([width], pa.int32()), pa.array([part.column("tags").to_pylist()], pa.list_(pa.list_(pa.string())))], ["ids", "vectors", "width", "tags"])

    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.col("id").isNotNull()
    return rows.select(*columns).filter(fine).mapInArrow(run, _BLOCK)


def _best(query: np.ndarray, id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by score and id."""
    order = np.lexsort((id, -score, query))
    query, id, score = query[order], id[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    kept = place < k
    return query[kept], id[kept], score[kept]


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries; -inf where a vector is zero."""
    if metric == "cosine":
        n, m = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x @ q.T) / np.outer(n, m)
        return np.where(np.outer(n > 0, m > 0), out, -np.inf)
    near = np.maximum((x**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * x @ q.T, 0)
    return np.where((np.linalg.norm(x, axis=1) > 0)[:, None], 1 - np.sqrt(near), -np.inf)


def _allowed(tags: list, wanted: list) -> np.ndarray | None:
    """Which rows have one of the tags that a query wants; a query that wants none takes all. None: nothing is forbidden."""
    if not any(w for w in wanted):
        return None
    number: dict[str, int] = {}
    for w in wanted:
        for t in w or []:
            number.setdefault(t, len(number))
    has = np.zeros((len(tags), len(number)), bool)
    for i, own in enumerate(tags):
        for t in own or []:
            if t in number:
                has[i, number[t]] = True
    out = np.ones((len(tags), len(wanted)), bool)
    for j, w in enumerate(wanted):
        if w:
            out[:, j] = has[:, [number[t] for t in w]].any(axis=1)
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", tags: str | None = None) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of each query; score is 1 - distance, ties go by id. rows: id, embedding;
    queries: query_id, embedding. tags: a column of both, array of strings; a row counts if it has one of a query's tags, or
    the query has none. Null and zero vectors, those with null components and those of another width than the query's are
    left out. k rows a query are kept, however many there are."""
    left = _packed(rows, "id", tags).select(*[F.col(c).alias(f"row_{c}") for c in ("ids", "vectors", "tags")], "width")
    right = _packed(queries, "query_id", tags).select(*[F.col(c).alias(f"query_{c}") for c in ("ids", "vectors", "tags")], "width")
    values = queries.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    if values <= BROADCAST_VALUES:
        met = left.join(F.broadcast(right), "width")
    else:  # every block of rows meets every block of queries, which stand on all salts
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.withColumn("salt", F.pmod(F.xxhash64("row_ids"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["width", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[np.ndarray]] = {}  # of each piece of a query block
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids, query_ids = np.frombuffer(r["row_ids"], "<i8"), np.frombuffer(r["query_ids"], "<i8")
                x, every = np.frombuffer(r["row_vectors"], "<f8").reshape(len(ids), -1), np.frombuffer(r["query_vectors"], "<f8").reshape(len(query_ids), -1)
                step = max(1, TILE_VALUES // max(1, len(ids)))
                for at in range(0, len(query_ids), step):
                    asked = query_ids[at : at + step]
                    score = _scores(x, every[at : at + step], metric)
                    allowed = _allowed(r["row_tags"], r["query_tags"][at : at + step])
                    if allowed is not None:
                        score = np.where(allowed, score, -np.inf)
                    if len(ids) > 4 * k:  # of a large block only what ties with a query's k best or beats them is sorted
                        bound = np.partition(score, len(ids) - k, axis=0)[len(ids) - k]
                        i, j = np.nonzero((score >= bound) & np.isfinite(score))
                    else:
                        i, j = np.nonzero(np.isfinite(score))
                    old = held.get(asked.tobytes(), _NONE)
                    held[asked.tobytes()] = list(_best(*(np.concatenate(c) for c in zip(old, (asked[j], ids[i], score[i, j]))), k))
        for best in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "id", "score"])

    hits = met.select("row_ids", "row_vectors", "row_tags", "query_ids", "query_vectors", "query_tags").mapInArrow(run, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def filtered(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, stage, score, rank. rows: id, embedding, tags, title; queries: query_id, embedding, wanted (tags that a
    row must have one of; none: all rows), intents (array of terms, null unless the query names intents alone).

    The filter comes first. A query that it leaves without a row searches the rows whose title holds one of its intents, if it
    names intents alone, else all rows."""
    asked = queries.select("query_id", "embedding", F.coalesce("wanted", F.array().cast("array<string>")).alias("tags"), "intents")
    found = stored(nearest(rows.select("id", "embedding", "tags"), asked, k, tags="tags").withColumn("stage", F.lit("filtered")), "nearest")
    left = asked.filter(F.size("tags") > 0).join(found.select("query_id").distinct(), "query_id", "left_anti")
    again = nearest(rows.select("id", "embedding"), left.filter("intents IS NULL"), k).withColumn("stage", F.lit("all"))
    # rows whose title holds a term are told apart by tags again: the terms that it holds
    named = left.filter("intents IS NOT NULL").withColumn("tags", F.transform("intents", F.lower)).filter(F.size("tags") > 0)
    terms = named.select(F.explode("tags").alias("term")).distinct()
    held = rows.select("id", "embedding", F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    hits = held.select("id", "title").join(F.broadcast(terms) if terms.limit(MOST_TITLE_TERMS + 1).count() <= MOST_TITLE_TERMS else terms, F.contains("title", "term")).groupBy("id").agg(F.collect_set("term").alias("tags"))
    titled = nearest(held.join(hits, "id").select("id", "embedding", "tags"), named.select("query_id", "embedding", "tags"), k, tags="tags").withColumn("stage", F.lit("title"))
    return found.unionByName(again).unionByName(titled).select("query_id", "id", "stage", "score", "rank")


#: Terms of stated queries that are broadcast to be looked for in titles.
MOST_TITLE_TERMS = 10_000
