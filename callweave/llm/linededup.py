"""Line dedup as an exact set-similarity join.

A line's set is its distinct five-word shingles; two lines match at Jaccard similarity 0.75 or more, and of matching
lines the later ones go (order: document id, text hash, line number). Equal sets are one class by a grouping. Between
classes: a line's shingles are ordered by rarity (sums of logarithms of word counts over all documents, kept in 2**16
hashed counters - any common order is exact, a good one is fast), the shortest prefix that a match must hit is posted,
and runs of one shingle give candidates under length and positional filters: every surviving pair of a short run; of a long
one, which could have too many, its rows are compared in blocks by 256-bit parity signatures that bound the difference of two
sets from below. Components of the candidates whose signatures allow a match are re-read as whole sets, and every pair of
them whose sizes allow a match is verified exactly (families.py).

Defined cases: blank lines never match and stay; with `short`, a line of fewer than `width` words is one shingle of the
whole line, so it matches its exact repeats, without it such lines never match and stay; null text has no lines; rows that
agree in id and text share a verdict; null ids count as -1; a line of any length is one set; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import families
from callweave.llm.common import fresh, in_tasks, likely, materialise, read_table, unlikely
from callweave.llm.kernels import U, Words, grouped_order, shingle_hashes, slices, text_buffer
from callweave.llm.neardup import folded, set_digests, sets

COUNTERS = 1 << 16
RAREST = (1 << 12) - 1  # rarities are counted up to here; the rest of the order is by value
SHORT_RUN = 32
KEY = ["doc", "text_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def line_offsets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of lines, text of each line, its number in the text)."""
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    order = np.argsort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    begins = order < len(offsets) - 1  # a text's first line; one that starts where an empty text does comes after it
    text = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    return np.concatenate([starts, offsets[-1:]]), text, np.arange(len(starts)) - first[text]


def word_counts(rows: DataFrame) -> np.ndarray:
    """Occurrences in all texts by hashed word, COUNTERS numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                total += np.bincount((Words(*text_buffer(part.column("text"))).hashes() & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], ["bucket", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in rows.select("text").transform(in_tasks, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def line_sets(raw: np.ndarray, offsets: np.ndarray, least: int):
    """(words of lines of `least` words or more, words a line, text, number)."""
    lines, text, number = line_offsets(raw, offsets)
    words = Words(raw, lines)
    hashes = words.hashes()
    long = words.counts >= least
    kept = np.repeat(long, words.counts)
    return hashes[kept], np.where(long, words.counts, 0), text, number


#: 64-bit numbers of a signature.
SIGNS = ["s0", "s1", "s2", "s3"]


def signatures(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit numbers a set, their 256 bits the parities of its values' classes. Every value that is in one of two sets
    alone changes one bit, so their signatures differ in no more bits than they differ in values."""
    bit, part = U(1) << ((values >> U(56)) & U(63)), values >> U(62)
    return [folded(np.where(part == U(k), bit, U(0)), counts, np.bitwise_xor.reduceat).view(np.int64) for k in range(len(SIGNS))]


def lines_of(rows: DataFrame, counts: np.ndarray, width: int, percent: int, least: int) -> DataFrame:
    """doc, text_hash, line, digest, n (set size), prefix (rarest shingles) and SIGNS of every line of enough words."""
    shared = rows.sparkSession.sparkContext.broadcast(np.log2(1.0 + counts).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            out = []
            for part in slices(batch, size=1 << 17):
                words, many, text, number = line_sets(*text_buffer(part.column("text")), least)
                values, sizes = shingle_hashes(words, many, width)
                if not len(values):
                    continue
                running = np.concatenate([[0.0], np.cumsum(weight[(words & np.uint64(COUNTERS - 1)).astype(np.int64)], dtype=np.float64)])
                begin = np.repeat(np.concatenate([[0], np.cumsum(many)])[:-1], sizes) + (np.arange(len(values)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes))
                rarity = np.minimum(np.rint((running[begin + np.repeat(np.minimum(many, width), sizes)] - running[begin]) * 4), RAREST).astype(np.uint64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = grouped_order(values, owner, rarity, RAREST.bit_length())
                values, owner = values[order], owner[order]
                new = np.ones(len(values), bool)
                new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                values, owner = values[new], owner[new]
                sizes = np.bincount(owner, minlength=len(sizes))
                digests = set_digests(values, sizes)
                prefix = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
                place = np.arange(len(values)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
                signs = signatures(values, sizes)
                head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(values[place < prefix[owner]].view(np.int64)))
                some = np.flatnonzero(sizes)
                take = pa.array(text[some])
                out.append(pa.RecordBatch.from_arrays([part.column("doc").take(take), part.column("text_hash").take(take), pa.array(number[some].astype(np.int64)), digests.take(pa.array(some)), pa.array(sizes[some].astype(np.int32)), head.take(pa.array(some)), *[pa.array(x[some]) for x in signs]], ["doc", "text_hash", "line", "digest", "n", "prefix", *SIGNS]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.transform(in_tasks, run, "doc long, text_hash long, line long, digest binary, n int, prefix array<bigint>, " + ", ".join(f"{x} long" for x in SIGNS))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Stored rows of two kinds. a, b (the rest null): pairs that share a prefix shingle in a run of SHORT_RUN rows or fewer
    and pass the length and positional filters. token, node (a and b null): the rows of longer runs, and of runs that the
    ends of a range may cut. classes: node, n, prefix."""
    order = ["token", "rank", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: the last run so far, while it is short; going: the token of a run that is given row by row; opening: the range's first run
        held, going, opening = None, None, True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if going is not None:
                more = int(np.searchsorted(table.column("token").to_numpy(), going, "right"))
                yield told(rows=table.slice(0, more))
                table = table.slice(more)
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            token, going = table.column("token").to_numpy(), None
            cut = int(np.searchsorted(token, token[-1]))  # the last run may go on
            if cut:
                first = int(np.searchsorted(token, token[0], "right")) if opening else 0
                yield told(rows=table.slice(0, first))
                yield split(table.slice(first, cut - first))
                opening = False
            held = table.slice(cut)
            if held.num_rows > SHORT_RUN:
                yield told(rows=held)
                held, going, opening = None, token[-1], False
        if held is not None:
            yield told(rows=held)

    def told(edges: np.ndarray = np.zeros((0, 2), np.int64), rows: pa.Table | None = None) -> pa.RecordBatch:
        m, n = len(edges), 0 if rows is None else rows.num_rows
        columns = [pa.concat_arrays([pa.array(edges[:, k]), pa.nulls(n, pa.int64())]) for k in (0, 1)]
        columns += [pa.concat_arrays([pa.nulls(m, pa.int64()), *(rows.column(c).chunks if n else [])]) for c in ("token", "node")]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "token", "node"])

    def split(table: pa.Table) -> pa.RecordBatch:
        """Whole runs: pairs of the short ones, rows of the others."""
        if not table.num_rows:
            return told()
        token, rank, node = (table.column(c).to_numpy() for c in order)
        n, place = rank >> 32, rank & 0xFFFFFFFF
        number = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        size = np.bincount(number)[number]
        out = []
        for s in range(1, SHORT_RUN):
            i = np.flatnonzero((token[s:] == token[:-s]) & (size[s:] <= SHORT_RUN))
            if not len(i):
                break
            j = i + s
            most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
            fits = (100 * n[i] >= percent * n[j]) & ((100 + percent) * most >= percent * (n[i] + n[j]))  # n ascends in a run
            out.append(np.stack([node[i[fits]], node[j[fits]]], axis=1))
        edges = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
        return told(edges[edges[:, 0] != edges[:, 1]], table.filter(pa.array(size > SHORT_RUN)))

    # n and place in one number: the fewer columns, the less is shuffled and sorted
    posted = classes.select("node", "n", F.posexplode("prefix").alias("place", "token")).select("token", F.expr("shiftleft(cast(n AS BIGINT), 32) | place").alias("rank"), "node")
    ascending = ["token", F.shiftright("rank", 32), "node"]
    dealt = posted.repartitionByRange(*ascending).sortWithinPartitions(*ascending)
    return materialise(dealt.transform(in_tasks, run, "a long, b long, token long, node long"), "line-candidates")


def apart(percent: int) -> tuple[int, int]:
    """(x, y): matching sets of n and m values differ in d values with x * d <= y * (n + m)."""
    return 100 + percent, 100 - percent


def candidate_edges(found: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold every match. found: of candidates(). lines: node, n, SIGNS.

    The parity signatures of two sets differ in no more bits than the sets in values, so pairs whose signatures are further
    apart are no match: short runs' pairs are looked at one by one, rows of other runs block by block, each run a
    family of its own."""
    pairs = found.filter("token IS NULL").select("a", "b").distinct()
    rows = found.filter("token IS NOT NULL").select("node", F.col("token").alias("family"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(rows.select("node"))
    signs = materialise(likely(lines.select("node", F.col("n").cast("long").alias("size"), *SIGNS), nodes, ["node"]), "line-signatures")
    x, y = apart(percent)
    of = lambda side: signs.select(F.col("node").alias(side), F.struct("size", *SIGNS).alias(f"of_{side}"))
    bits = " + ".join(f"bit_count(of_a.{k} ^ of_b.{k})" for k in SIGNS)
    near = F.expr(f"{x} * ({bits}) <= {y} * (of_a.size + of_b.size)")
    short = pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b")

    def decide(table: pa.Table) -> pa.RecordBatch:
        node, size, family = (table.column(c).to_numpy() for c in ("node", "size", "family"))
        signs = [table.column(k).to_numpy().view(np.uint64) for k in SIGNS]

        def close(one: np.ndarray, others: np.ndarray) -> np.ndarray:
            bits = sum(np.bitwise_count(k[one] ^ k[others]).astype(np.int64) for k in signs)
            return (x * bits <= y * (size[one] + size[others])) & (family[one] == family[others])

        everyone = np.arange(len(node))
        if len(node) <= families.BLOCK_SETS:
            label = families.labels_of(close(everyone[:, None], everyone[None, :]))
        else:
            # a walk over the rows not reached yet: a dense run is done after a few of them
            label, left, waiting = everyone.copy(), everyone, []
            while len(left):
                if not waiting:
                    waiting, left = [left[0]], left[1:]
                one = waiting.pop()
                hit = close(one, left)
                label[left[hit]] = label[one]
                waiting += left[hit].tolist()
                left = left[~hit]
        other = label != everyone
        return pa.RecordBatch.from_arrays([pa.array(node[label[other]]), pa.array(node[other])], ["a", "b"])

    long = families.verify(rows.join(signs, "node"), percent, decide, "a long, b long", block_sets=2048)
    return short.unionByName(long)


def _decide(percent: int, width: int):
    def decide(table: pa.Table) -> pa.RecordBatch:
        side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
        found, counts = sets(table.column("text"), width)
        values = np.split(found, np.cumsum(counts)[:-1])
        rank = np.empty(len(node), np.int64)
        rank[np.lexsort(tuple(table.column(c).to_numpy() for c in ("line", "text_hash", "doc")))] = np.arange(len(node))
        if table.column("low")[0].as_py() == table.column("high")[0].as_py():
            near = families.linked_within(values, table.column("family").to_numpy(), percent)
            np.fill_diagonal(near, False)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = np.zeros((len(node), len(node)), bool)
            near[np.ix_(a, b)] = families.linked([values[i] for i in a], [values[i] for i in b], percent)
            near |= near.T
        earlier = (near & (rank[None, :] < rank[:, None])).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(near.sum(axis=1).astype(np.int64)), pa.array(earlier)], ["node", "links", "earlier"])

    return decide


def matched_lines(docs: DataFrame, width: int = 5, percent: int = 75, short: bool = False) -> DataFrame:
    """doc, text_hash, line, exact (an earlier line has the same set), links (other sets it matches) of every line that
    an earlier one matches."""
    rows = keyed(docs)
    place = [*KEY, "line"]
    lines = materialise(lines_of(rows, word_counts(rows), width, percent, 1 if short else width).withColumn("node", F.monotonically_increasing_id()), "lines")
    # the sets of several lines: few, and prefixes stay out of this shuffle
    first = F.min(F.struct(*place, "node")).alias("first")
    copied = materialise(lines.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first"), "line-copies")
    # one line a class: those that surely have no copy, and of the others the first of their digest
    alone = unlikely(lines, copied, ["digest"]).select("node", "n", "prefix")
    others = likely(lines.select("digest", "node", "n", "prefix"), copied, ["digest"]).join(copied, "digest", "left").filter("first IS NULL OR first.node = node")
    found = candidates(alone.unionByName(others.select("node", "n", "prefix")), percent)
    family = materialise(families.components(candidate_edges(found, lines, percent)), "line-families")
    wanted = likely(lines.select(*place, "node", "digest", "n"), family, ["node"]).join(family.select("node", F.col("component").alias("family")), "node")
    wanted = materialise(wanted.withColumn("size", F.col("n").cast("long")), "line-members")
    # candidate lines are taken out of their texts before anything moves
    texts = rows.select(*KEY, F.posexplode(F.split("text", "\n")).alias("at", "text")).select(*KEY, F.col("at").cast("long").alias("line"), "text")
    texts = likely(texts, wanted, place).dropDuplicates(place)
    verdict = families.verify(wanted.select("family", "node", "size", *place), percent, _decide(percent, width), "node long, links long, earlier boolean", lambda dealt: texts.join(dealt.hint("shuffle_merge"), place))
    verdict = verdict.groupBy("node").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier")).filter("links > 0")
    linked = wanted.join(materialise(verdict, "line-verdicts"), "node").select("digest", F.struct(*place).alias("first"), "links", "earlier")
    same = copied.select("digest", F.struct(*[F.col(f"first.{c}").alias(c) for c in place]).alias("first"), F.lit(0).cast("long").alias("links"), F.lit(False).alias("earlier"))
    told = materialise(same.unionByName(linked).groupBy("digest").agg(F.min("first").alias("first"), F.max("links").alias("links"), F.max("earlier").alias("earlier")), "line-told")
    out = likely(lines.select(*place, "digest"), told, ["digest"]).join(told, "digest").withColumn("exact", F.struct(*place) != F.col("first"))
    return out.filter("exact OR earlier").select(*place, "exact", "links").distinct()


def removals(docs: DataFrame, width: int = 5, percent: int = 75, short: bool = False) -> DataFrame:
    """doc, text_hash, removed (line numbers, ascending), n_exact, n_links: of the texts that lose lines."""
    hits = matched_lines(docs, width, percent, short)
    return hits.groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("removed"), F.count_if("exact").alias("n_exact"), F.sum("links").alias("n_links"))


def dedup_lines(docs: DataFrame, width: int = 5, percent: int = 75, short: bool = False) -> DataFrame:
    """docs, same columns, with the removed lines taken out of text."""
    doc, text_hash, removed = (fresh(x) for x in ("doc", "hash", "removed"))
    gone = materialise(removals(docs, width, percent, short), "removals").select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("removed").alias(removed))
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(removed, i.cast("long"))), "\n")
    rows = docs.join(gone, key, "left")
    return rows.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(left)).select(docs.columns)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: of every document, the lines that earlier lines match."""
    docs = read_table(spark, sf_dir, "documents")
    gone = removals(docs, short=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<bigint>")
    out = rows.join(materialise(gone, "removals"), KEY, "left").withColumn("removed", F.coalesce("removed", none))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "removed")
