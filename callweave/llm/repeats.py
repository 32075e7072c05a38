"""Suffix-array dedup on sparse suffix arrays.

Of all suffixes those that begin at a minimiser are retained: the smallest hash of `gram` consecutive words in each
window of least - gram + 1 of them, so that any passage of `least` words holds one, chosen by its content alone. Suffixes
whose first `gram` words occur in one document only are dropped by a pre-aggregated grouping; the others are sorted by
the words that follow, compared with their nearest neighbours from other documents, and extended right and left from the
minimiser. Windows of `least` words that no neighbour covers, as only a third document shares both sides, are looked up by
their hash among the windows of the same gram. Matches of `least` words or more are merged into spans of repeated words;
`reach` words are carried each way, which is enough as a longer passage has further minimisers.

Words compare by 32-bit hashes (A-Z as a-z), so an end of a span overshoots with chance 2**-32. A sort range that cuts a
run of equal suffixes is stitched by comparing its outermost rows with the neighbouring ranges', and the open windows of
cut runs are looked up over all ranges.

Defined cases: null or short texts have no spans; rows with one id are one document with several texts (text hashes tell
them apart), and equal texts under one id don't repeat each other; null ids count as -1; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import WORD, in_tasks, likely, materialise, read_table
from callweave.llm.kernels import Words, shingle_hashes, slices, text_buffer
from callweave.llm.linededup import KEY, keyed

#: A suffix's place in its text and the windows that it stands for (of owned()).
PLACE = ["place", "low", "high"]
#: Columns of contexts().
FIELDS = {"gram": pa.int64(), "doc": pa.int64(), "text_hash": pa.int64(), "place": pa.int32(), "low": pa.int32(), "high": pa.int32(), "right": pa.binary(), "left": pa.binary()}
KIND = "gram long, doc long, text_hash long, place int, low int, high int, right binary, left binary"
#: Bits of the filter of windows that tasks get when windows are looked up over all ranges: 2 MB whatever the corpus.
WINDOW_SLOTS = 1 << 24


def minimisers(grams: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in grams, owners): the leftmost smallest of every `window` consecutive values of one group."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sliding minimum from prefix and suffix minima of blocks of one window
    size = -(-n // window) * window
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = grams
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    owner = np.repeat(np.arange(len(counts)), counts)
    fine = owner[: n - window + 1] == owner[window - 1 :]
    # a window's leftmost smallest is its first value, or the next window's too unless that window's minimum is another
    at = np.flatnonzero(fine)
    low = least[at]
    heads = at[grams[at] == low]
    last = np.ones(len(at), bool)
    last[:-1] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    at, low = at[last], low[last]
    place = np.full(len(at), -1, np.int64)
    for j in range(window):
        hit = (place < 0) & (grams[at + j] == low)
        place[hit] = at[hit] + j
    place = np.unique(np.concatenate([heads, place]))
    return place, owner[place]


def owned(grams: np.ndarray, counts: np.ndarray, place: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of each of minimisers()' places: the windows whose leftmost smallest it is begin low to high before it.

    Each window is one place's. Equal windows have theirs at the same distance, so a window is looked up from there alone."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    first, last = begin[owner], begin[owner + 1] - window
    same = owner[1:] == owner[:-1]
    # a smaller value takes over as it comes in, any other as the one before goes out
    taken = np.where(grams[place[1:]] < grams[place[:-1]], place[1:] - window + 1, place[:-1] + 1)
    first[1:] = np.where(same, taken, first[1:])
    last[:-1] = np.where(same, taken - 1, last[:-1])
    return place - last, place - first


def suffixes(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """gram (hash), doc, text_hash, place, low, high (of owned()) of every retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in slices(batch, size=1 << 17):
                words = Words(*text_buffer(part.column("text")))
                counts = np.where(words.counts >= least, words.counts, 0)
                hashes = words.hashes()[np.repeat(words.counts >= least, words.counts)]
                values, sizes = shingle_hashes(hashes, counts, gram)
                place, owner = minimisers(values, sizes, least - gram + 1)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                take = pa.array(owner)
                numbers = [pa.array(x.astype(np.int32)) for x in (place - begin[owner], *owned(values, sizes, place, owner, least - gram + 1))]
                out.append(pa.RecordBatch.from_arrays([pa.array(values[place].view(np.int64)), part.column("doc").take(take), part.column("text_hash").take(take), *numbers], ["gram", "doc", "text_hash", *PLACE]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.transform(in_tasks, run, "gram long, doc long, text_hash long, place int, low int, high int")


def contexts(rows: DataFrame, places: DataFrame, gram: int, reach: int) -> DataFrame:
    """gram, doc, text_hash, place, low, high, right (hashes of the suffix's words), left (of the words before it, backwards)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                words = Words(*text_buffer(part.column("text")))
                hashes = (words.hashes() >> np.uint64(32)).astype(">u4")
                out = []
                for i, (doc, text_hash, wanted) in enumerate(zip(part.column("doc").to_pylist(), part.column("text_hash").to_pylist(), part.column("wanted").to_pylist())):
                    own = hashes[words.bounds[i] : words.bounds[i + 1]]
                    back = own[::-1]
                    n = len(own)
                    for w in wanted:
                        p = w["place"]
                        out.append((w["gram"], doc, text_hash, p, w["low"], w["high"], own[p : p + gram + reach].tobytes(), back[n - p : n - p + reach].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), FIELDS.values())], list(FIELDS))

    wanted = places.groupBy(*KEY).agg(F.collect_set(F.struct("gram", *PLACE)).alias("wanted"))
    return likely(rows, places, KEY).join(wanted, KEY).dropDuplicates(KEY).select(*KEY, "text", "wanted").transform(in_tasks, run, KIND)


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row x width of 32-bit words, 0 beyond a row's own, row lengths)."""
    raw, offsets = text_buffer(column)
    many = np.diff(offsets) // 4
    out = np.zeros((len(many), width), np.uint32)
    flat = np.frombuffer(raw.tobytes(), ">u4")
    row = np.repeat(np.arange(len(many)), many)
    out[row, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(many)])[:-1], many)] = flat
    return out, many


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row pair, `most` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def _windows(table: pa.Table, gram: int, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row x b: hash of the `least` words that begin b words before the suffix, whether the suffix stands for them)."""
    right, right_many = _matrix(table.column("right"), gram + reach)
    left, left_many = _matrix(table.column("left"), reach)
    places = np.arange(1, reach + gram + 1, dtype=np.uint64)
    spread = lambda x, odd: np.cumsum((x.astype(np.uint64) + np.uint64(odd)) * (places[: x.shape[1]] * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) ** np.uint64(3), axis=1)
    b = np.arange(least - gram + 1)
    ahead = spread(right, 0x632BE5AB)[:, least - b - 1]
    back = np.concatenate([np.zeros((len(left), 1), np.uint64), spread(left, 0x85157AF5)], axis=1)[:, b]
    out = ahead + back * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out = (out + table.column("gram").to_numpy().view(np.uint64)[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out.view(np.int64), _stands_for(table, b) & (b <= left_many[:, None]) & (least - b <= right_many[:, None])


def _stands_for(table: pa.Table, b: np.ndarray) -> np.ndarray:
    """row x b: whether the window that begins b words before the suffix is its own."""
    low, high = (table.column(c).to_numpy()[:, None] for c in ("low", "high"))
    return (low <= b) & (b <= high)


def _shared(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same value."""
    order = np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
    out = np.zeros(len(v), bool)
    out[order] = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start))[group]
    return out


def _compared(table: pa.Table, gram: int, reach: int, least: int, begins: bool = False, ends: bool = False, whole: bool = True) -> pa.RecordBatch:
    """Matches of the rows of a sorted stretch: doc, text_hash, begin, end.

    First those that a neighbour from another document confirms. A neighbour shares most of what follows, but a third
    document can share more of what comes before. So windows of `least` words that neither neighbour covers, though what
    follows would allow it, are looked up among all windows of their run, each from the suffix that stands for it. The run at a stretch's beginning (`begins`) or end
    (`ends`) may go on in another range: what stays open of it is returned with a null end, gram and hash, to be looked up
    over all ranges. Without `whole` only neighbours count."""
    key, doc, place = (table.column(c).to_numpy() for c in ("gram", "doc", "place"))
    text_hash = table.column("text_hash").to_numpy()
    right, right_many = _matrix(table.column("right"), gram + reach)
    left, left_many = _matrix(table.column("left"), reach)
    n = len(key)
    run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if n else np.zeros(0, np.int64)
    streak = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if n else np.zeros(0, bool)
    start = np.flatnonzero(streak)
    number = np.cumsum(streak) - 1
    before = start[number] - 1
    after = np.concatenate([start[1:], [n]])[number] if n else np.zeros(0, np.int64)
    found = []
    b = np.arange(least - gram + 1)
    most, covered = np.zeros(n, np.int64), np.zeros((n, len(b)), bool)
    for other in (before, after):
        i = np.flatnonzero((other >= 0) & (other < n))
        i = i[run[i] == run[other[i]]]
        j = other[i]
        ahead = _common(right[i], right[j], np.minimum(right_many[i], right_many[j]))
        back = _common(left[i], left[j], np.minimum(left_many[i], left_many[j]))
        hit = (ahead >= gram) & (ahead + back >= least)
        found.append((doc[i[hit]], text_hash[i[hit]], place[i[hit]] - back[hit], place[i[hit]] + ahead[hit]))
        most[i] = np.maximum(most[i], ahead)
        covered[i] |= (b <= back[:, None]) & (least - b <= ahead[:, None])
    del right, left
    asked: list[np.ndarray] = []
    if n and whole:
        size = np.bincount(run)
        cut = np.zeros(len(size), bool)
        cut[0], cut[-1] = cut[0] | begins, cut[-1] | ends
        # what lies beyond a range's outermost rows of one document is not seen here
        most[(begins & (before < 0)) | (ends & (after >= n))] = gram + reach
        opened = ((least - b <= most[:, None]) & ~covered & _stands_for(table, b)).any(axis=1) & (cut[run] | (size[run] > 2))
        rows = np.flatnonzero(np.isin(run, np.unique(run[opened])))
        if len(rows):
            values, fits = _windows(table.take(pa.array(rows)), gram, reach, least)
            still = fits & (least - b <= most[rows, None]) & ~covered[rows]
            for back in b:
                at = np.flatnonzero(fits[:, back])
                if not still[at, back].any():
                    continue
                shared = _shared(values[at, back], doc[rows[at]])
                for kept in (shared, ~shared & cut[run[rows[at]]]):
                    own = at[kept & still[at, back]]
                    r = rows[own]
                    begin = place[r] - back
                    if kept is shared:
                        found.append((doc[r], text_hash[r], begin, begin + least))
                    else:
                        asked.append(np.stack([doc[r], text_hash[r], begin, key[r], values[own, back]]))
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)]
    n, more = len(columns[0]), np.concatenate([np.zeros((5, 0), np.int64), *asked], axis=1)
    m = more.shape[1]
    late = np.arange(n + m) >= n
    arrays = [pa.array(np.concatenate([c, x])) for c, x in zip(columns[:3], more[:3])]
    arrays.append(pa.array(np.concatenate([columns[3], np.zeros(m, np.int64)]), mask=late))
    keys = [pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=~late) for x in more[3:]]
    return pa.RecordBatch.from_arrays([*arrays, *keys], ["doc", "text_hash", "begin", "end", "gram", "window"])


def neighbours(stored: DataFrame, gram: int, reach: int, least: int) -> DataFrame:
    """doc, text_hash, begin, end: the matches of neighbouring suffixes. stored: of contexts(), in a table."""
    fields = list(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, first, begins = TaskContext.get().partitionId(), None, True, True

        def outer(row: pa.Table, at: int) -> pa.RecordBatch:
            part = row.slice(at, 1).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, *[part.column(f) for f in fields]], ["range", "begin", "end", "window", *fields])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            if first:
                yield from (outer(table, a) for a in edge(table, True))
                first = False
            key = table.column("gram").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            held = table.slice(cut)
            if cut:
                yield told(_compared(table.slice(0, cut), gram, reach, least, begins=begins))
                begins = False
        if held is not None:
            yield told(_compared(held, gram, reach, least, begins=begins, ends=True))
            yield from (outer(held, a) for a in edge(held, False))

    def edge(table: pa.Table, begin: bool) -> list[int]:
        """The outermost row and the first one further in that is another document's."""
        doc = table.column("doc").to_numpy()
        at = 0 if begin else len(doc) - 1
        other = np.flatnonzero(doc != doc[at])
        return [at, *([int(other[0 if begin else -1])] if len(other) else [])]

    def told(found: pa.RecordBatch) -> pa.RecordBatch:
        m = found.num_rows
        empty = {f: FIELDS[f] for f in (*PLACE, "right", "left")}
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), *[found.column(c) for c in ("begin", "end", "window")], *[pa.nulls(m, empty[f]) if f in empty else found.column(f) for f in fields]], ["range", "begin", "end", "window", *fields])

    order = ["gram", "right", *KEY, "place"]
    found = materialise(stored.select(fields).repartitionByRange(*order).sortWithinPartitions(*order).transform(in_tasks, run, f"range long, begin long, end long, window long, {KIND}"), "suffix-matches")
    # rows at range ends, few a range, meet those of neighbouring ranges by their gram
    cut = found.filter(F.col("range").isNotNull()).select(fields).repartition("gram").sortWithinPartitions(*order)
    stitched = cut.transform(in_tasks, lambda batches: _stitch(batches, gram, reach, least), "doc long, text_hash long, begin long, end long")
    hits = found.filter("range IS NULL AND window IS NULL").select(*KEY, "begin", "end").unionByName(stitched)
    return hits.unionByName(_looked_up(stored, found.filter("window IS NOT NULL").select(*KEY, "begin", "gram", "window"), gram, reach, least))


def _looked_up(stored: DataFrame, opened: DataFrame, gram: int, reach: int, least: int) -> DataFrame:
    """doc, text_hash, begin, end of the open windows that another document has, whatever range holds it.

    Tasks get a filter of the open windows as WINDOW_SLOTS bits, and of what passes it they return each window once a batch,
    with its smallest and largest document. A full filter lets more through; the join by window decides."""
    slots = WINDOW_SLOTS
    wanted = opened.select(F.col("window").bitwiseAND(slots - 1).alias("slot"))
    bits = wanted.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits")).toArrow()
    words = np.zeros(slots // 64, np.uint64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = stored.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values, fits = _windows(pa.Table.from_batches([part]), gram, reach, least)
                slot = values.view(np.uint64) & np.uint64(slots - 1)
                passed = (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                row, back = np.nonzero(fits & (passed != 0))
                found.append((values[row, back], part.column("doc").to_numpy()[row]))
            value, doc = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if len(value):
                order = np.lexsort((doc, value))
                value, doc = value[order], doc[order]
                first = np.concatenate([[True], value[1:] != value[:-1]])
                last = np.concatenate([first[1:], [True]])
                yield pa.RecordBatch.from_arrays([pa.array(value[first]), pa.array(doc[first]), pa.array(doc[last])], ["window", "a", "b"])

    windows = likely(stored, opened, ["gram"]).transform(in_tasks, run, "window long, a long, b long")
    several = windows.groupBy("window").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("window")
    return opened.join(several, "window").select(*KEY, "begin", (F.col("begin") + least).alias("end"))


def _stitch(batches: Iterator[pa.RecordBatch], gram: int, reach: int, least: int) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        yield _compared(pa.Table.from_batches(rows), gram, reach, least, whole=False).select(["doc", "text_hash", "begin", "end"])


def repeated_spans(docs: DataFrame, least: int = 50, gram: int = 16) -> DataFrame:
    """doc, text_hash, spans (array of begin, end in words, disjoint, ascending): passages of `least` words or more that
    another document has too."""
    reach = max(least, gram)
    rows = keyed(docs)
    kept = materialise(suffixes(rows, least, gram), "suffixes")
    common = materialise(kept.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("gram"), "shared-grams")
    places = kept.join(common, "gram")  # contexts() drops repeats; nothing here keeps Spark from splitting a common gram
    stored = materialise(contexts(rows, places, gram, reach), "suffix-contexts")
    hits = neighbours(stored, gram, reach, least)
    hits = hits.groupBy(*KEY, "begin").agg(F.max("end").alias("end"))
    # a hit that begins beyond all ends before it opens a span
    order = Window.partitionBy(*KEY).orderBy("begin")
    behind = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.withColumn("new", F.coalesce(F.col("begin") > behind, F.lit(True)).cast("long")).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy(*KEY, "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: of every document, the spans of words that other documents repeat."""
    docs = read_table(spark, sf_dir, "documents")
    found = materialise(repeated_spans(docs), "repeated-spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(found, KEY, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), total.alias("n_repeated_words"), "spans")
