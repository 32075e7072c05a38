"""Links inside candidate families: connected components as joins, and exact verification by blocks.

A candidate relation (shared table keys, shared prefix tokens) is given as few edges, stars or chains, never as all
pairs. Its components are families; every pair of a family whose sizes allow a match is then compared on whole sets, block
by block, by counting shared values inside tasks. A family of any size is dealt out as block pairs of bounded size, so no
task holds it whole, and what leaves a task is one row a member, not one a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, materialise
from callweave.llm.kernels import text_buffer


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, other columns ignored). node, component (smallest node reachable) of every node of an edge.

    Each round points every node at its smallest neighbour and contracts the edges; at least half the remaining nodes go,
    so rounds grow with the logarithm of the longest chain. Hot nodes are pre-aggregated, and the joins with stored tables
    are ones whose large partitions Spark can split.
    """
    spark = edges.sparkSession
    left = materialise(edges.select("a", "b").filter("a <> b").transform(in_tasks, _local_stars, "a long, b long").distinct(), "edges")
    levels: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("next")))
        parents = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("parent")), "parents")
        levels.append(parents)
        of = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))
        joined = left.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        left = materialise(joined.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not levels:
        return spark.createDataFrame([], "node long, component long")
    # an edge from a node to its parent is contracted like the others, so one step a level leads to the smallest node
    out = levels[0].select("node", F.col("parent").alias("component"))
    for parents in levels[1:]:
        up = parents.select(F.col("node").alias("component"), F.col("parent").alias("up"))
        out = out.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return out


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a block of edges as stars, which leaves few rounds for the joins."""
    for table in blocks(batches, BLOCK_EDGES):
        yield _stars(table)


def blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """The rows in their order, `least` or somewhat more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _stars(table: pa.Table) -> pa.RecordBatch:
    nodes, number = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
    a, b = number[: table.num_rows], number[table.num_rows :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least.copy())
        least = least[least]
        if (least == label).all():
            break
        label = least
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[other]]), pa.array(nodes[other])], ["a", "b"])


#: Edges that a task looks at together.
BLOCK_EDGES = 1 << 18
#: Most sets and set members of a block; a task holds two blocks.
BLOCK_SETS, BLOCK_MEMBERS = 256, 1 << 20


def block_pairs(members: DataFrame, percent: int, most: int) -> DataFrame:
    """members: family, node, size and others. Each row once for every block pair its block is in: columns family, low,
    high, side (0: block low, 1: block high), whole (the family is one block). most: sets of a block.

    A family beyond one block is dealt by classes of set size, each wide enough that sets of classes further apart than
    neighbours can't match, and a class by a hash of the node into blocks. Only blocks of one or of neighbouring classes meet.
    """
    kind = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / (1.0001 * math.log(100 / percent)) if percent < 100 else F.col("size")).cast("int")
    rows = members.withColumn("kind", kind)
    counts = rows.groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    blocks = F.ceil(F.greatest(F.col("n") / most, F.col("m") / BLOCK_MEMBERS)).cast("int")
    sizes = counts.groupBy("family").agg(((F.sum("n") <= most) & (F.sum("m") <= BLOCK_MEMBERS)).alias("whole"), F.map_from_entries(F.collect_list(F.struct("kind", blocks.alias("blocks")))).alias("blocks"))
    rows = rows.join(materialise(sizes, "family-sizes"), "family")
    # blocks are numbered kind << 32 | number in the kind
    own = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.expr("shiftleft(cast(kind AS BIGINT), 32) | pmod(xxhash64(node), blocks[kind])"))
    others = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(
        F.expr("flatten(transform(filter(array(kind - 1, kind, kind + 1), k -> blocks[k] IS NOT NULL), k -> transform(sequence(0, blocks[k] - 1), i -> shiftleft(cast(k AS BIGINT), 32) | i)))")
    )
    rows = rows.withColumn("block", own).withColumn("other", F.explode(others))
    return rows.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side")).drop("block", "other", "blocks", "kind")


#: A value in so many pairs of sets is counted in a matrix product, a rarer one pair by pair; pairs listed at once.
DENSE, LISTED = 4096, 1 << 20


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Intersection sizes of two lists of sets of distinct 64-bit values; without a second list, of the first with itself."""
    code, owner, many = _coded(left if right is None else [*left, *right])
    if right is None:
        kept = many[code] > 1  # the rest is in no intersection but a set's with itself
        out = _products(code[kept], owner[kept], code[kept], owner[kept], len(left), len(left), len(many))
        np.fill_diagonal(out, [len(x) for x in left])
        return out
    first = owner < len(left)
    return _products(code[first], owner[first], code[~first], owner[~first] - len(left), len(left), len(right), len(many))


def _coded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, owner) of every value, ascending by number, and how often each number occurs."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    code = np.cumsum(new) - 1
    return code, owner[order], np.bincount(code)


def _products(a: np.ndarray, a_owner: np.ndarray, b: np.ndarray, b_owner: np.ndarray, n: int, m: int, codes: int) -> np.ndarray:
    in_a, in_b = np.bincount(a, minlength=codes), np.bincount(b, minlength=codes)
    pairs = in_a * in_b
    out = np.zeros(n * m)
    rare = (pairs[a] > 0) & (pairs[a] <= DENSE)
    code, owner = a[rare], a_owner[rare]
    begin, width = (np.cumsum(in_b) - in_b)[code], in_b[code]
    upto = np.cumsum(width)
    at = 0
    while at < len(code):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + LISTED, "right")))
        w = width[at:to]
        place = np.arange(upto[to - 1] - done) + np.repeat(begin[at:to] - (upto[at:to] - w - done), w)
        out += np.bincount(np.repeat(owner[at:to] * m, w) + b_owner[place], minlength=n * m)
        at = to
    out = out.reshape(n, m)
    number = np.cumsum(pairs > DENSE) - 1
    frequent_a, frequent_b = pairs[a] > DENSE, pairs[b] > DENSE
    a, a_owner, b, b_owner = number[a[frequent_a]], a_owner[frequent_a], number[b[frequent_b]], b_owner[frequent_b]
    step = 4096
    for low in range(0, int(number[-1]) + 1 if codes else 0, step):
        tables = []
        for code, owner, size in ((a, a_owner, n), (b, b_owner, m)):
            i, j = np.searchsorted(code, [low, low + step])
            table = np.zeros((size, min(step, int(number[-1]) + 1 - low)), np.float32)
            table[owner[i:j], code[i:j] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def bundles(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 64) -> Iterator[pa.Table]:
    """Rows of one block pair, or of several whole families together (about `least` rows), of batches sorted by keys."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table, keys)
        yield from _cut(table.slice(0, starts[-1]), starts[:-1], least)
        held = table.slice(starts[-1])
    if held is not None:
        yield from _cut(held, [0], least)


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    marks = [table.column(k).to_numpy() for k in keys]
    return [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()]


def _cut(table: pa.Table, starts: list[int], least: int) -> Iterator[pa.Table]:
    whole = table.column("whole").to_numpy()
    begin = 0
    for at, end in zip(starts, [*starts[1:], table.num_rows]):
        alone = not whole[at] if end > at else False
        if alone and at > begin:
            yield table.slice(begin, at - begin)
            begin = at
        if alone or end - begin >= least or end == table.num_rows:
            if end > begin:
                yield table.slice(begin, end - begin)
            begin = end


def sets_of(column) -> list[np.ndarray]:
    """Binary columns of little-endian 64-bit values as arrays."""
    raw, offsets = text_buffer(column)
    return [raw[a:b].view(np.uint64) if (a % 8 == 0) else np.frombuffer(raw[a:b].tobytes(), np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]


def linked_within(values: list[np.ndarray], family: np.ndarray, percent: int) -> np.ndarray:
    """linked() of all pairs of one family."""
    return linked(values, None, percent) & (family[:, None] == family[None, :])


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; without a second list, of the first with itself."""
    shared = shared_counts(left, right)
    a = np.array([len(x) for x in left], float)
    b = a if right is None else np.array([len(x) for x in right], float)
    return 100 * shared >= percent * (a[:, None] + b[None, :] - shared)


def verify(members: DataFrame, percent: int, decide: Callable[[pa.Table], pa.RecordBatch], schema: str, attach: Callable[[DataFrame], DataFrame] = lambda dealt: dealt, block_sets: int | None = None) -> DataFrame:
    """decide() on every pair of blocks that can hold sets of `percent` similarity. members: family, node, size and what
    decide needs, of which attach() can join what is large once the blocks are known; decide gets the rows of one pair, or of
    several families of one block each."""
    keys = ["family", "low", "high"]
    dealt = attach(block_pairs(members, percent, block_sets or BLOCK_SETS)).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for table in bundles(batches, keys):
            if table.num_rows > 1:
                waiting.append(decide(table.combine_chunks()))
                rows += waiting[-1].num_rows
            if rows >= 8192:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return dealt.transform(in_tasks, run, schema)


def labels_of(adjacent: np.ndarray) -> np.ndarray:
    """Component numbers (smallest member's place) of a symmetric 0/1 matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        least = np.where(adjacent, label[None, :], n).min(axis=1)
        least = np.minimum(label, least)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least
