"""Secret scans over a trigram inverted index.

From each rule's pattern follows a Boolean query of trigrams: alternatives, each a set of trigrams that a matching text
must hold (its letters a-z; texts are indexed so). The index holds postings by block of texts: for each trigram the rows of
the block that have it. A search intersects the postings of an alternative's trigrams, rarest first, unites alternatives,
and the texts that are left are read and verified with the pattern itself. A rule from which no trigram follows is run over
every text.

Blocks are some megabytes of text each, so no posting list grows with the corpus, and postings are intersected by block.
Only candidates' texts move, whatever their number.

Defined cases: null and empty texts have no matches; rows that agree in id and text are judged alike, null ids too; texts of
any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as S
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, likely, materialise, read_table
from callweave.llm.kernels import slices, text_buffer
from callweave.llm.linededup import KEY, keyed


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of `pattern`, of which those count whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else 0)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled().finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that are long enough
)
#: Published forms of keys and tokens.
MORE = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

#: A query: alternatives, each a set of trigrams that all occur. EVERY holds for any text.
Query = frozenset[frozenset[str]]
EVERY: Query = frozenset([frozenset()])
#: Most strings, strings over a seam, and alternatives that are followed; beyond, a query asks for less, which only adds candidates.
MOST_STRINGS, MOST_SEAMS, MOST_ALTERNATIVES = 64, 16, 64


def _least(alternatives: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that ask for all that another asks for, and more."""
    kept: list[frozenset[str]] = []
    for a in sorted(set(alternatives), key=lambda a: (len(a), sorted(a))):
        if not any(k <= a for k in kept):
            kept.append(a)
    return frozenset(kept) if len(kept) <= MOST_ALTERNATIVES else EVERY


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES**2:
        return a if b == EVERY or a != EVERY else b
    joined = _least(x | y for x in a for y in b)
    return joined if joined != EVERY else max(a, b, key=lambda q: q != EVERY)


def _of_strings(strings: Iterable[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class _Known:
    """What is known of a part's matches: all of them, or what they begin and end with, and a query that they fulfil."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query

    def opened(self) -> _Known:
        """The same without the exact strings, which become prefixes, suffixes and part of the query."""
        if self.exact is None:
            return self
        return _Known(None, _ends(self.exact, slice(0, 2)), _ends(self.exact, slice(-2, None)), _both(self.query, _of_strings(self.exact)))


_ANYTHING = _Known(None, frozenset([""]), frozenset([""]), EVERY)
_NOTHING = _Known(frozenset([""]), frozenset([""]), frozenset([""]), EVERY)


def _ends(strings: Iterable[str], part: slice) -> frozenset[str]:
    out = frozenset(s[part] for s in strings)
    return out if len(out) <= MOST_STRINGS else frozenset([""])


def _then(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Known(frozenset(x + y for x in a.exact for y in b.exact), _NOTHING.prefix, _NOTHING.suffix, _both(a.query, b.query))
    # what the first ends with and the second begins with also make trigrams
    left, right = a.exact or a.suffix, b.exact or b.prefix
    seam = _of_strings(x + y for x, y in product(left, right)) if len(left) * len(right) <= MOST_SEAMS else EVERY
    prefix = _ends((x + y for x, y in product(a.exact, right)), slice(0, 2)) if a.exact is not None and len(a.exact) * len(right) <= MOST_STRINGS else a.opened().prefix
    suffix = _ends((x + y for x, y in product(left, b.exact)), slice(-2, None)) if b.exact is not None and len(left) * len(b.exact) <= MOST_STRINGS else b.opened().suffix
    return _Known(None, prefix, suffix, _both(_both(a.opened().query, b.opened().query), seam))


def _or(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS and a.query == b.query == EVERY:
        return _Known(a.exact | b.exact, a.prefix, a.suffix, EVERY)
    a, b = a.opened(), b.opened()
    return _Known(None, _ends(a.prefix | b.prefix, slice(0, 2)), _ends(a.suffix | b.suffix, slice(-2, None)), _least(a.query | b.query))


def _one_of(chars: Iterable[int]) -> _Known:
    strings = frozenset(chr(c).lower() if c < 128 else chr(c) for c in chars)
    return _Known(strings, _NOTHING.prefix, _NOTHING.suffix, EVERY) if 0 < len(strings) <= MOST_STRINGS else _ANYTHING


def _known(op, value) -> _Known:
    if op is S.LITERAL:
        return _one_of([value])
    if op is S.IN:
        chars: list[int] = []
        for kind, x in value:
            if kind is S.LITERAL:
                chars.append(x)
            elif kind is S.RANGE and x[1] - x[0] <= MOST_STRINGS:
                chars += range(x[0], x[1] + 1)
            else:
                return _ANYTHING
        return _one_of(chars)
    if op is S.SUBPATTERN:
        return _sequence(value[-1])
    if op is S.BRANCH:
        return reduce(_or, (_sequence(x) for x in value[1]))
    if op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
        low, high, inner = value
        once = _sequence(inner)
        if high == 1:
            return _or(_NOTHING, once) if low == 0 else once
        if low == 0:
            return _ANYTHING
        return once.opened()  # at least one, so it begins and ends as one does
    if op is S.AT or op in (S.ASSERT, S.ASSERT_NOT):
        return _NOTHING
    return _ANYTHING


def _sequence(items) -> _Known:
    return reduce(_then, (_known(op, value) for op, value in items), _NOTHING)


def trigram_query(rule: Rule) -> Query:
    """The alternatives that follow from a rule's pattern; EVERY where none does."""
    return _sequence(parser.parse(rule.pattern)).opened().query


def _code(gram: str) -> list[int]:
    """The last three bytes of a trigram as a number; all of it for ASCII."""
    b = gram.encode()
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of text of a block.
BLOCK_BYTES = 1 << 22


def index(rows: DataFrame, grams: Iterable[str] | None = None) -> DataFrame:
    """block, gram, rows: postings of a block's rows by number, and with gram -1 their keys as pairs. rows: of keyed().
    grams: the trigrams to index, all if not given."""
    wanted = None if grams is None else np.array(sorted({c for g in grams for c in _code(g)}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        table = np.ones(1 << 24, bool)
        if wanted is not None:
            table[:] = False
            table[wanted] = True
        for batch in batches:
            for part in slices(batch, size=BLOCK_BYTES):
                raw, offsets = text_buffer(part.column("text"))
                low = _FOLD[raw]
                codes = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
                at = np.flatnonzero(table[codes])
                owner = np.searchsorted(offsets, at, "right") - 1
                inside = at + 2 < offsets[owner + 1]
                found = np.unique(codes[at[inside]].astype(np.int64) << 32 | owner[inside])
                gram = found >> 32
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
                keys = np.stack([part.column(k).to_numpy() for k in KEY], axis=1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.append(first, len(gram))[1:] if len(first) else [], [len(gram) + len(keys)]]).astype(np.int32)), pa.array(np.concatenate([found & 0xFFFFFFFF, keys])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), number)), pa.array(np.append(gram[first], -1).astype(np.int32)), lists], ["block", "gram", "rows"])
                number += 1

    return rows.transform(in_tasks, run, "block long, gram int, rows array<long>")


def candidates(postings: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """doc, text_hash, rules (numbers of the queries) of the rows that fulfil some query. postings: stored, of index()."""
    coded = [[sorted({c for g in a for c in _code(g)}) for a in q] for q in queries]
    wanted = sorted({c for q in coded for a in q for c in a})

    def intersected(table: pa.Table) -> pa.Table:
        lists = {g: np.asarray(r.values) for g, r in zip(table.column("gram").to_pylist(), table.column("rows"))}
        keys = lists.pop(-1).reshape(-1, len(KEY))
        none = np.zeros(0, np.int64)
        hits: dict[int, list[int]] = {}
        for i, query in enumerate(coded):
            for alternative in query:
                found = sorted((lists.get(c, none) for c in alternative), key=len)
                rows = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), found) if found else np.arange(len(keys))
                for r in rows.tolist():
                    if i not in hits.setdefault(r, []):
                        hits[r].append(i)
        at = np.array(sorted(hits), np.int64)
        return pa.table({**{k: keys[at, j] for j, k in enumerate(KEY)}, "rules": pa.array([hits[r] for r in at.tolist()], pa.list_(pa.int32()))})

    asked = postings.filter(F.col("gram").isin(-1, *wanted))
    return asked.groupBy("block").applyInArrow(intersected, "doc long, text_hash long, rules array<int>")


def _verified(texts: DataFrame, rules: Sequence[Rule], chosen: str | None) -> DataFrame:
    """doc, text_hash, spans of the texts with any; chosen: column with the numbers of the rules to run, else all run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            numbers = batch.column(chosen).to_pylist() if chosen else None
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                spans = [{"start": a, "rule": n, "end": b} for n in (numbers[i] if chosen else range(len(rules))) for a, b in rules[n].spans(text)]
                if spans:
                    at.append(i)
                    out.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("rule", pa.int32()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at, pa.int64())) for k in KEY], pa.array(out, kind)], [*KEY, "spans"])

    return texts.transform(in_tasks, run, f"doc long, text_hash long, spans {SPANS}")


SPANS = "array<struct<start: bigint, rule: int, end: bigint>>"


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """doc_id, doc, text_hash, spans (start, number of the rule, end; ascending) of every row. docs: doc_id, text."""
    rows = keyed(docs)
    queries = [trigram_query(r) for r in rules]
    by_index = [i for i, q in enumerate(queries) if q != EVERY]
    whole = [i for i, q in enumerate(queries) if q == EVERY]
    found = docs.sparkSession.createDataFrame([], f"doc long, text_hash long, spans {SPANS}")
    if whole:
        numbers = F.array(*[F.lit(i) for i in whole])
        found = found.unionByName(_verified(rows.withColumn("rules", numbers), rules, "rules"))
    if by_index:
        postings = materialise(index(rows, {g for i in by_index for a in queries[i] for g in a}), "postings")
        hits = candidates(postings, [queries[i] for i in by_index])
        numbers = F.array(*[F.lit(i) for i in by_index])
        hits = materialise(hits.distinct().withColumn("rules", F.transform("rules", lambda r: F.get(numbers, r))), "candidates")
        texts = likely(rows, hits, KEY).join(hits.hint("shuffle_merge"), KEY)
        found = found.unionByName(_verified(texts, rules, "rules"))
    # rows that agree in id and text found the same
    spans = found.distinct().groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    ids = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("text_hash"))
    return ids.join(spans, KEY, "left").select("doc_id", *KEY, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def written(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _many(rule: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rule"] == rule))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the secrets of all documents."""
    rules = BASE + MORE
    kinds = [r.kind for r in rules]
    rows = scan(read_table(spark, sf_dir, "documents"), rules)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    counts = [_many(i).cast("long").alias(f"n_{kinds[i]}") for i in range(len(BASE))]
    return rows.select("doc_id", *counts, F.sha2(written(base, kinds), 256).alias("base_sha256"), written(F.col("spans"), kinds).alias("spans"))
