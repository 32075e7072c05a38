"""Phrase collocation mining on weighted acyclic automata.

Every word place gives one sequence: the language and the next four words, or fewer at a piece's end. The count of any
phrase of up to four words is then the weight of a prefix. A task sorts the sequences of some megabytes of text (a shard),
builds automata of them, one for each range of sequences that occurs, and sends those out by range. A range unites its
automata and sums weights by prefix; prefixes below the least count are left at once, with all that is below them. A prefix
that goes over a range's border is given out by each range it is in, and the parts are added up.

The parts of a candidate are phrases that are frequent too. They are looked up by composing the automaton of the asked
phrases of a range with that of the range's frequent phrases.

Ranges are cut at every so many sequences of a sample of one in `STRIDE` word places, which decides how even they are and
nothing else. Sequences are whole, so no word, pair or triple is too frequent to be cut; one sequence that is repeated is one
path of a shard. There is a range for each `RANGE_WORDS` words (or two a shuffle partition), up to `MOST_RANGES`, beyond which
ranges grow: their borders are broadcast, some 40 bytes each.

Defined cases: null and empty texts have no words; a null lang is `und`; languages that differ in any way are apart, an
empty one too; repeated rows count as often as they occur; pieces and texts of any length are read whole; equal scores go by
count, then by phrase in the order of bytes; an empty table gives no rows; other columns and ids are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import automata
from callweave.llm.common import in_tasks, materialise, read_table
from callweave.llm.kernels import U, Words, slices, text_buffer

LONGEST = 4
STRIDE = 1024
RANGE_WORDS, MOST_RANGES = 1 << 21, 1 << 20
#: Bytes of text of a shard, most words that it sorts at once, most sequences of an automaton that is sent out.
SHARD_BYTES, SHARD_WORDS, BLOCK = 1 << 23, 1 << 21, 1 << 13

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


class _Sequences:
    """Labels of a shard's words, with each word's language and whether the next one is in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        raw, offsets = text_buffer(part.column("text"))
        raw = _LOWER[raw]
        words = Words(raw, offsets, _BETWEEN)
        text = np.repeat(np.arange(part.num_rows), words.counts)
        pieces = np.cumsum(_ENDS_PIECE[raw], dtype=np.int32)[words.starts] if len(words.starts) else np.zeros(0, np.int32)
        langs = part.column("lang").cast(pa.binary())
        lang_raw, lang_offsets = text_buffer(langs)
        every = automata.binary(np.concatenate([raw[words.inside], lang_raw]), np.concatenate([words.ends() - words.starts, np.diff(lang_offsets)]))
        self.words, labels = automata.ranked(every)
        self.labels, self.lang = labels[: len(text)], labels[len(text) :][text]
        self.same = np.zeros(len(text), bool)  # the next word follows in the same piece
        self.same[:-1] = (text[1:] == text[:-1]) & (pieces[1:] == pieces[:-1])

    def __len__(self) -> int:
        return len(self.labels)

    def next(self, at: np.ndarray) -> list[np.ndarray]:
        """Labels of the words from each place on, 0 past the end of its piece."""
        columns, on = [self.labels[at]], np.ones(len(at), bool)
        for j in range(1, LONGEST):
            there = np.minimum(at + j - 1, len(self) - 1)
            on = on & self.same[there]
            columns.append(np.where(on, self.labels[np.minimum(at + j, len(self) - 1)], 0))
        return columns


def survey(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: lang and n (words of a task's shard), or path (language and words) of one place in STRIDE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SHARD_BYTES):
                s = _Sequences(part)
                if not len(s):
                    continue
                langs, n = np.unique(s.lang, return_counts=True)
                grid = np.arange(0, len(s), STRIDE)
                at = np.minimum(grid + np.random.default_rng(len(s)).integers(0, STRIDE, len(grid)), len(s) - 1)
                columns = [s.lang[at], *s.next(at)]
                paths = [[w.as_py().decode() for w in s.words.take(pa.array([x - 1 for x in labels if x]))] for labels in zip(*[c.tolist() for c in columns])]
                counts = pa.array([*n.tolist(), *[None] * len(paths)], pa.int64())
                names = pa.array([*[s.words[x - 1].as_py().decode() for x in langs.tolist()], *[None] * len(paths)], pa.string())
                yield pa.RecordBatch.from_arrays([names, counts, pa.array([*[None] * len(langs), *paths], pa.list_(pa.string()))], ["lang", "n", "path"])

    return _texts(docs).transform(in_tasks, run, "lang string, n long, path array<string>")


def borders(surveyed: DataFrame, words: int, ranges: int) -> list[tuple[bytes, ...]]:
    """The first sequences of all ranges but the first, ascending. surveyed: stored, of survey()."""
    step = max(1, -(-words // (STRIDE * ranges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange((-seen - 1) % step, batch.num_rows, step)))
            seen += batch.num_rows

    ordered = surveyed.filter(F.col("path").isNotNull()).select("path").orderBy("path")
    found = ordered.transform(in_tasks, run, "path array<string>").distinct().collect() if ranges > 1 else []
    return sorted(tuple(w.encode() for w in r["path"]) for r in found)


def _places(columns: list[np.ndarray], words: pa.Array, cuts: list[tuple[bytes, ...]]) -> np.ndarray:
    """How many of the sorted sequences come before each border."""
    listed = words.to_pylist()
    out = np.zeros(len(cuts), np.int64)
    for i, cut in enumerate(cuts):
        low, high = 0, len(columns[0])
        for column, word in zip(columns, cut):
            label = bisect_left(listed, word) + 1
            here = low + int(np.searchsorted(column[low:high], label))
            if label > len(listed) or listed[label - 1] != word:
                low = here
                break
            low, high = here, low + int(np.searchsorted(column[low:high], label, "right"))
        out[i] = low
    return out


def shards(docs: DataFrame, cuts: list[tuple[bytes, ...]]) -> DataFrame:
    """range, block: automata of each shard's sequences by range."""
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SHARD_BYTES):
                s = _Sequences(part)
                for at in range(0, len(s), SHARD_WORDS):
                    ranges, blocks = _blocks(s, at, min(len(s), at + SHARD_WORDS), shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blocks, pa.binary())], ["range", "block"])

    return _texts(docs).transform(in_tasks, run, "range int, block binary")


def _blocks(s: _Sequences, low: int, high: int, cuts: list[tuple[bytes, ...]]) -> tuple[list[int], list[bytes]]:
    # pairs of words get numbers in their order, so that a sequence is one number: language, first pair, second pair
    first, second, third, _ = s.next(np.arange(low, min(len(s), high + 2)))
    pairs, pair = np.unique((first << 32 | second).astype(np.uint64), return_inverse=True)
    pairs, pair = np.concatenate([[U(0)], pairs]), pair + 1  # 0: no second pair
    n = high - low
    back = np.zeros(n, np.int64)
    there = np.flatnonzero(third[:n])
    back[there] = pair[there + 2]
    langs, lang = np.unique(s.lang[low:high], return_inverse=True)
    bits = U(max(1, len(pairs) - 1).bit_length())
    key = (lang.astype(np.uint64) << bits | pair[:n].astype(np.uint64)) << bits | back.astype(np.uint64)
    key, weights = np.unique(key, return_counts=True)
    mask = (U(1) << bits) - U(1)
    columns = [langs[key >> bits >> bits], *[(x >> U(y) & U(0xFFFFFFFF)).astype(np.int64) for x in (pairs[key >> bits & mask], pairs[key & mask]) for y in (32, 0)]]
    ends = [0, *_places(columns, s.words, cuts).tolist(), len(key)]
    ranges, blocks = [], []
    for i, (begin, end) in enumerate(zip(ends[:-1], ends[1:])):
        for a in range(begin, end, BLOCK):
            b = min(end, a + BLOCK)
            used, labels = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
            some = used[used > 0]
            labels = labels + (1 if used[0] else 0)  # 0 stays the end of a sequence
            blocks.append(automata.dump(automata.build(s.words.take(pa.array(some - 1)), np.split(labels, len(columns)), weights[a:b])))
            ranges.append(i)
    return ranges, blocks


def _united(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[automata.Automaton] = []
        at = None
        for batch in batches:
            for i, block in zip(batch.column("range").to_pylist(), batch.column("block")):
                if i != at and held:
                    yield _prefixes(held, least)
                    held = []
                at = i
                held.append(automata.load(block.as_py()))
        if held:
            yield _prefixes(held, least)

    return run


def _prefixes(parts: list[automata.Automaton], least: int) -> pa.RecordBatch:
    found = [(p[0].decode(), b" ".join(p[1:]).decode(), len(p) - 1, n) for p, n in automata.union(parts, least) if len(p) > 1]
    columns = list(zip(*found)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "words", "a"])


def frequent(docs: DataFrame, cuts: list[tuple[bytes, ...]], least: int, partitions: int) -> DataFrame:
    """lang, phrase, words, a: every phrase of one to four words that occurs `least` times or more."""
    blocks = shards(docs, cuts).repartition(partitions, "range").sortWithinPartitions("range")
    found = blocks.transform(in_tasks, _united(least), "lang string, phrase string, words int, a long")
    # a phrase over a border has a row from each of its ranges
    return found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def looked_up(phrases: DataFrame, asked: DataFrame, cuts: list[tuple[bytes, ...]]) -> DataFrame:
    """lang, phrase, a of the asked phrases. Both sides go to their range and are composed there; asked: lang, phrase, each
    once, all of them frequent, so a range has no more of them than it has frequent phrases."""

    def placed(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = [(x.encode(), *y.encode().split(b" ")) for x, y in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
                where = pa.array([bisect_right(cuts, p) for p in paths], pa.int32())
                yield pa.RecordBatch.from_arrays([where, *batch.columns], ["range", *batch.schema.names])

        return rows.transform(in_tasks, run, f"range int, {', '.join(f'{n} {t}' for n, t in rows.dtypes)}")

    def composed(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, counts = _automaton(left)
        order, wanted = _automaton(right)
        found = automata.compose(counts, wanted) if len(rows) and len(order) else np.zeros(len(order), np.int64)
        right = right.select(["lang", "phrase"]).take(pa.array(order))
        return right.append_column("a", pa.array(found))

    sides = placed(phrases.select("lang", "phrase", "a")).groupBy("range").cogroup(placed(asked.select("lang", "phrase")).groupBy("range"))
    return sides.applyInArrow(composed, "lang string, phrase string, a long").filter("a > 0")


def _automaton(table: pa.Table) -> tuple[np.ndarray, automata.Automaton]:
    """(order of the rows, automaton of lang and phrase, weighted with a if there)."""
    paths = [(x.encode(), *y.encode().split(b" ")) for x, y in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist())]
    order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
    words, labels = automata.ranked(pa.array([w for i in order for w in paths[i]], pa.binary()))
    columns = np.zeros((LONGEST + 1, len(order)), np.int64)
    sizes = np.array([len(paths[i]) for i in order], np.int64)
    row = np.repeat(np.arange(len(order)), sizes)
    columns[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = labels
    weights = table.column("a").to_numpy()[order] if "a" in table.column_names else np.ones(len(order), np.int64)
    return order, automata.build(words, list(columns), weights)


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more, at its lowest-scoring cut. counts: lang,
    phrase, a of all parts."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    split = phrases.filter("words > 1").select("lang", "phrase", "words", "a", cut)
    split = split.withColumn("front", F.expr("substring_index(phrase, ' ', k)")).withColumn("back", F.expr("substring_index(phrase, ' ', k - words)"))
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    rows = split.join(of("front", "l"), ["lang", "front"]).join(of("back", "r"), ["lang", "back"])
    value = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def parts_of(phrases: DataFrame) -> DataFrame:
    """lang, phrase, each once: the parts of all cuts of phrases of two words or more."""
    cuts = "flatten(transform(sequence(1, words - 1), k -> array(substring_index(phrase, ' ', k), substring_index(phrase, ' ', k - words))))"
    return phrases.filter("words > 1").select("lang", F.explode(F.expr(cuts)).alias("phrase")).distinct()


def outer(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longest: the highest count of a longer candidate that holds a phrase of two words or more."""
    inside = "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))"
    return phrases.filter("words > 2").select("lang", F.explode(F.expr(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases, or all."""
    spark = docs.sparkSession
    surveyed = materialise(survey(docs), "survey")
    sizes = {r["lang"]: r["n"] for r in surveyed.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    words, partitions = sum(sizes.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(-(-words // RANGE_WORDS), min(2 * partitions, words // (4 * STRIDE)), 1))
    cuts = borders(surveyed, words, ranges)
    phrases = materialise(frequent(docs, cuts, least, min(partitions, ranges) if ranges <= 2 * partitions else 4 * partitions), "phrases")
    counts = materialise(looked_up(phrases, parts_of(phrases), cuts), "parts")
    rows = scored(phrases, counts).join(outer(phrases), ["lang", "phrase"], "left")
    rows = rows.filter(F.coalesce(F.col("longest").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share, F.lit(True)))
    total = surveyed.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # each part of a language keeps no more than the language needs
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the phrases of all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(k AS INTEGER) AS k, count(*) AS a FROM places, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, unnest(range(1, k)) AS j, w FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, min(struct_pack(score := CAST(CAST(2000000 AS HUGEINT) * cut.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT), j := j, l := x.a, r := y.a)) AS best
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1:], ' ')
      GROUP BY cut.lang, cut.phrase, cut.a),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY best.score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000"""
