"""MinHash near-dedup with tensored banding.

Table keys are pairs (A_i, B_j) of keys from two small collections: A has 10 keys of 2 minhashes, B has 16 of 3. So 160
tables of 5 minhashes each cost 68 minhashes, not 800. Two sets with Jaccard similarity 0.75 miss all tables with chance
0.4375**10 + 0.578**16 < 0.0005, closer ones with less.

Documents with equal shingle sets are one class. Class representatives are range-partitioned by (A key, document), B keys
ride along; a run of one A key is split by each B key, and each table cell gives a star of edges to its smallest document.
Ranges, and the blocks that a task reads its range in, cut hot runs; the cells of cut runs are joined by a second, small
aggregation. Families (components of
those edges) are re-read as whole sets and all their pairs verified exactly (families.py).

Defined cases: null text, and text without words, has no set, links with nothing and is kept; fewer words than the
shingle width are one shingle; a null doc_id links with nothing, its component is null and it is kept; rows that repeat
a doc_id are one node with the sets of all of them; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import families
from callweave.llm.common import in_tasks, likely, materialise, read_table
from callweave.llm.kernels import U, Words, binaries, distinct_in_groups, mix, shingle_hashes, slices, text_buffer

A_KEYS, A_ROWS, B_KEYS, B_ROWS = 10, 2, 16, 3
#: Rows of table keys that a task looks at together.
BLOCK_ROWS = 1 << 15
_RNG = np.random.default_rng(9)
_N = A_KEYS * A_ROWS + B_KEYS * B_ROWS
_XOR = _RNG.integers(1, 2**64 - 1, _N, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**64 - 1, _N, dtype=np.uint64) | U(1)


def sets(column, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): each text's distinct shingles."""
    words = Words(*text_buffer(column))
    return distinct_in_groups(*shingle_hashes(words.hashes(), words.counts, width))


def folded(values: np.ndarray, counts: np.ndarray, what) -> np.ndarray:
    """A reduction over each group's values; 0 for empty ones."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = what(values, np.concatenate([[0], np.cumsum(counts)])[:-1][some])
    return out


def set_digests(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """16 bytes a set, equal for equal sets; null for empty ones."""
    sums = np.stack([folded(mix(values ^ U(x)), counts, np.add.reduceat) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
    data = [None if not c else s.tobytes() for c, s in zip(counts.tolist(), sums)]
    return pa.array(data, pa.binary())


def collection_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text x A_KEYS, text x B_KEYS)."""
    least = [folded((values ^ x) * m, counts, np.minimum.reduceat) for x, m in zip(_XOR, _ODD)]
    at, out = 0, []
    for keys, rows in ((A_KEYS, A_ROWS), (B_KEYS, B_ROWS)):
        table = np.zeros((len(counts), keys), np.uint64)
        for i in range(keys):
            key = np.full(len(counts), at + 1, np.uint64)
            for _ in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) ^ least[at])
                at += 1
            table[:, i] = key
        out.append(table)
    return out[0], out[1]


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest, a, b (keys as bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in slices(batch, size=1 << 17):
                values, counts = sets(part.column("text"), width)
                a, b = collection_keys(values, counts)
                n = np.ones(len(counts), np.int64)
                parts.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), set_digests(values, counts), binaries(a.ravel(), n * A_KEYS), binaries(b.ravel(), n * B_KEYS)], ["doc_id", "n_shingles", "digest", "a", "b"]))
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_tasks, run, "doc_id long, n_shingles long, digest binary, a binary, b binary")


def _cells(key: np.ndarray, doc: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each B key: (cell of each row, order that sorts by cell and document, where a cell begins)."""
    for j in range(B_KEYS):
        cell = mix(key ^ mix(b[:, j] + U(j)))
        order = np.lexsort((doc, cell))
        new = np.ones(len(order), bool)
        new[1:] = cell[order][1:] != cell[order][:-1]
        yield cell, order, new


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of rows (key, doc, b) in order: edges (cell null), and for cut runs each cell's smallest document (a null).
    A range is read in blocks of bounded size, and a run that goes on in the next block counts as cut."""
    for table in families.blocks(batches, BLOCK_ROWS):
        yield from _block_edges(table)


def _block_edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key = table.column("key").to_numpy().view(np.uint64)
    doc = table.column("doc_id").to_numpy()
    raw = text_buffer(table.column("b"))[0]
    b = raw[: len(raw)].view(np.uint64).reshape(-1, B_KEYS) if raw.ctypes.data % 8 == 0 else np.frombuffer(raw.tobytes(), np.uint64).reshape(-1, B_KEYS)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    rows = np.flatnonzero(sizes[run] > 1)
    pairs = np.zeros((0, 2), np.int64)
    for _, order, first in _cells(key[rows], doc[rows], b[rows]):
        head = doc[rows][order][np.flatnonzero(first)][np.cumsum(first) - 1]
        here = doc[rows][order]
        pairs = np.concatenate([pairs, np.stack([head, here], axis=1)[head != here]])
        if len(pairs) > 1 << 20:
            pairs = np.unique(pairs, axis=0)
    pairs = np.unique(pairs, axis=0)
    none = pa.nulls(len(pairs), pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["cell", "a", "b"])
    edge = np.flatnonzero((run == 0) | (run == run[-1]))
    for cell, order, first in _cells(key[edge], doc[edge], b[edge]):
        at = order[first]
        yield pa.RecordBatch.from_arrays([pa.array(cell[at].view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(doc[edge][at])], ["cell", "a", "b"])


def candidate_edges(sketched: DataFrame) -> DataFrame:
    """a, b: stars of the table cells. sketched: stored rows doc_id, a, b of one document a class."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_buffer(batch.column("a"))[0]
            keys = np.frombuffer(raw.tobytes(), np.int64)
            where = pa.array(np.repeat(np.arange(batch.num_rows), A_KEYS))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id").take(where), batch.column("b").take(where)], ["key", "doc_id", "b"])

    rows = sketched.select("doc_id", "a", "b").transform(in_tasks, split, "key long, doc_id long, b binary")
    found = materialise(rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").transform(in_tasks, _edges, "cell long, a long, b long"), "cells")
    cut = found.filter(F.col("cell").isNotNull()).select("cell", "b")
    heads = materialise(cut.groupBy("cell").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "cut-cells")
    return found.filter(F.col("cell").isNull()).select("a", "b").unionByName(cut.join(heads.select("cell", "a"), "cell").filter("a <> b").select("a", "b"))


def _decide(percent: int):
    def decide(table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        node = table.column("node").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        values = families.sets_of(table.column("set"))
        whole = np.full(len(node), table.column("whole")[0].as_py())
        if low == high:
            near = families.linked_within(values, table.column("family").to_numpy(), percent)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = np.zeros((len(node), len(node)), bool)
            near[np.ix_(a, b)] = families.linked([values[i] for i in a], [values[i] for i in b], percent)
            near |= near.T
        order = np.argsort(node, kind="stable")
        label = families.labels_of(near[np.ix_(order, order)])
        return pa.RecordBatch.from_arrays([pa.array(node[order]), pa.array(node[order][label]), pa.array(whole)], ["a", "b", "whole"])

    return decide


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs."""
    rows = materialise(sketches(docs, width), "sketches")
    ided = rows.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = materialise(ided.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "a", "b")).alias("r")).select("digest", "r.*"), "classes")
    family = families.components(candidate_edges(classes))
    return _resolve(docs, rows, classes, materialise(family, "families"), width, percent)


def _resolve(docs: DataFrame, rows: DataFrame, classes: DataFrame, family: DataFrame, width: int, percent: int) -> DataFrame:
    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                values, counts = sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("family"), part.column("node"), pa.array(counts.astype(np.int64)), binaries(values, counts)], ["family", "node", "size", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    wanted = family.select("node", F.col("component").alias("family"))
    # only candidates' texts move, whatever the size of either side
    members = likely(texts, wanted, ["node"]).join(wanted.hint("shuffle_merge"), "node").select("family", "node", "text").transform(in_tasks, resolved, "family long, node long, size long, set binary")
    found = materialise(families.verify(materialise(members, "members").filter("size > 0"), percent, _decide(percent), "a long, b long, whole boolean"), "links")
    # a doc_id with several texts can be in two classes; their links meet in the node
    repeated = rows.filter(F.col("digest").isNotNull()).join(classes.select("digest", F.col("doc_id").alias("head")), "digest").select("doc_id", "digest", "head")
    several = repeated.groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("b")).filter("a <> b")
    # a family of one block has its components already; the links of cut families go through components() once more
    chained = several.select("a", "b").unionByName(several.select(F.col("doc_id").alias("a"), "b"))
    joined = found.filter("not whole and a <> b").select("a", "b").unionByName(chained)
    open_nodes = materialise(joined, "open-links")
    if open_nodes.isEmpty():
        # a node has a row for each of its texts, repeated ones too
        labels = found.filter("whole and a <> b").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    else:
        labels = families.components(found.filter("a <> b").select("a", "b").unionByName(open_nodes))
    labels = materialise(labels, "labels")
    heads = classes.select("digest", F.col("doc_id").alias("head"))
    out = rows.select("doc_id", "n_shingles", "digest").join(heads, "digest", "left")
    out = out.withColumn("head", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")))
    out = out.join(labels.select(F.col("node").alias("head"), "component"), "head", "left")
    component = F.coalesce("component", "head")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
