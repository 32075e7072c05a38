"""What queries name, found with dictionaries that are tables.

A dictionary row is (dictionary, canonical, term). All dictionaries go into one Aho-Corasick machine, whose payload says
which dictionaries and canonical names a term stands for, so a text is read once whatever their number. The rows are
broadcast in blocks of at most MOST_TERMS terms, a narrow pass over the texts each; a worker builds a machine once a block.
What a pass adds is an array of spans, and everything after it are column expressions on that array.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import fuzzy, matching, vocabulary
from callweave.functions import text as T
from callweave.functions.signals import any_of

#: Terms of a block: some 100 bytes each in a worker, and as many in its broadcast.
MOST_TERMS = 200_000
#: Rows and bytes of a batch that are looked through at once.
MOST_ROWS, PIECE_BYTES = 512, 1 << 18
SPANS = "array<struct<dictionary: string, begin: int, size: int, canonical: string, place: bigint, tight: boolean, term: string>>"
GUESSES = "array<struct<dictionary: string, kind: string, score: double, size: int, place: bigint, canonical: string>>"
#: What makes a term part of a longer word.
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_BUILT: dict[str, object] = {}


def dictionaries(spark: SparkSession, synonyms: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """dictionary, canonical, term, own, place from nested mappings: each canonical name and its synonyms, in order."""
    rows, place = [], 0
    for name, table in synonyms.items():
        for canonical, terms in table.items():
            for own, term in [(True, canonical), *((False, t) for t in terms)]:
                rows.append((name, canonical, term, own, place))
                place += 1
    return spark.createDataFrame(rows, "dictionary string, canonical string, term string, own boolean, place long")


def _blocks(terms: DataFrame, columns: list[str]) -> Iterator[list]:
    """The rows in blocks of some MOST_TERMS, dealt by a hash of the term."""
    known = terms.filter(F.coalesce(F.trim("term") != "", F.lit(False))).select(F.lower("term").alias("term"), *columns)
    blocks = max(1, -(-known.count() // MOST_TERMS))
    for i in range(blocks):
        yield known.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).orderBy("place", "term").collect()


def _once(key: str, make):
    """make(), built once a worker; the last eight stay."""
    if key not in _BUILT:
        while len(_BUILT) >= 8:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = make()
    return _BUILT[key]


def _machine(words: dict[str, list]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, meanings in words.items():
        machine.add_word(word, (word, meanings))
    machine.make_automaton()
    return machine


def _appended(rows: DataFrame, kind: str, column: str, each) -> DataFrame:
    """rows with one more column, made from each batch in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # what is found can be many times the text, so only a piece's is held
            rows_ = max(1, min(MOST_ROWS, whole.num_rows * PIECE_BYTES // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, rows_):
                batch = whole.slice(at, rows_)
                yield pa.RecordBatch.from_arrays([*batch.columns, each(batch)], [*batch.schema.names, column])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{column}` {kind}"
    return rows.mapInArrow(run, schema)


def with_spans(rows: DataFrame, text: str, terms: DataFrame, column: str = "spans") -> DataFrame:
    """rows with every place where a term occurs in the text (lower case, as normalize_query() leaves it): the term's
    dictionary and canonical name, begin and size in characters. tight: found without blanks in the text without blanks,
    where places count so."""
    spark = rows.sparkSession
    names = []
    for block in _blocks(terms, ["dictionary", "canonical", "place"]):
        shared, key = spark.sparkContext.broadcast([tuple(r) for r in block]), uuid.uuid4().hex

        def build(shared=shared):
            plain: dict[str, list] = {}
            tight: dict[str, list] = {}
            for term, dictionary, canonical, place in shared.value:
                plain.setdefault(term, []).append((dictionary, canonical, place, term))
                if t := term.replace(" ", ""):
                    tight.setdefault(t, []).append((dictionary, canonical, place, term))
            return _machine(plain), _machine(tight)

        def each(batch: pa.RecordBatch, build=build, key=key) -> pa.Array:
            machines = _once(key, build)
            out = []
            for x in batch.column(text):
                whole = x.as_py() or ""
                spans = []
                for is_tight, machine, t in ((False, machines[0], whole), (True, machines[1], whole.replace(" ", ""))):
                    if t and len(machine):
                        for end, (word, meanings) in machine.iter(t):
                            begin = end - len(word) + 1
                            inside = (begin > 0 and t[begin - 1] in _INNER) or (end + 1 < len(t) and t[end + 1] in _INNER)
                            spans += [{"dictionary": d, "begin": begin, "size": -1 if inside and not is_tight else len(word), "canonical": c, "place": p, "tight": is_tight, "term": term} for d, c, p, term in meanings]
                out.append(spans)
            return pa.array(out, _ARROW_SPANS)

        names.append(f"{column}_{key}")
        rows = _appended(rows, SPANS, names[-1], each)
    return rows.withColumn(column, F.concat(*names)).drop(*names)


_ARROW_SPANS = pa.list_(pa.struct([("dictionary", pa.string()), ("begin", pa.int32()), ("size", pa.int32()), ("canonical", pa.string()), ("place", pa.int64()), ("tight", pa.bool_()), ("term", pa.string())]))
_ARROW_GUESSES = pa.list_(pa.struct([("dictionary", pa.string()), ("kind", pa.string()), ("score", pa.float64()), ("size", pa.int32()), ("place", pa.int64()), ("canonical", pa.string())]))


def named(spans: Column, dictionary: str) -> Column:
    """Canonical names in order of their first place: from left to right the longest term at a place, not inside a longer
    ASCII word and not over an earlier term. Of two names with one term the later in the dictionary counts."""
    own = F.filter(spans, lambda s: (s["dictionary"] == dictionary) & ~s["tight"] & (s["size"] > 0))
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["begin"].alias("begin"), (-s["size"]).alias("size"), (-s["place"]).alias("place"), s["canonical"].alias("canonical"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("found"))
    step = lambda a, s: F.when(s["begin"] < a["end"], a).otherwise(F.struct((s["begin"] - s["size"]).alias("end"), F.array_append(a["found"], s["canonical"]).alias("found")))
    return F.array_distinct(F.aggregate(ordered, start, step, lambda a: a["found"]))


def contained(spans: Column, dictionary: str) -> Column:
    """Canonical names with a term anywhere in the text, with or without blanks, in the dictionary's order."""
    own = F.filter(spans, lambda s: s["dictionary"] == dictionary)
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["place"].alias("place"), s["canonical"].alias("canonical"))))
    return F.array_distinct(F.transform(ordered, lambda s: s["canonical"]))


def dictionary_terms(rows: DataFrame, text: str, terms: DataFrame, dictionary: str, column: str = "found") -> DataFrame:
    """rows with the canonical names of one dictionary: whole terms, else contained ones."""
    spans = f"spans_{uuid.uuid4().hex}"
    out = with_spans(rows, text, terms.filter(F.col("dictionary") == dictionary), spans)
    exact = named(F.col(spans), dictionary)
    return out.withColumn(column, F.when(F.size(exact) > 0, exact).otherwise(contained(F.col(spans), dictionary))).drop(spans)


# Results depend on them. Cutoffs of the fuzzy stages, least length of a text, score of a card's words, most names.
WEIGHTED_LEAST, PARTIAL_LEAST, SHORTEST, TOKEN_LEAST, MOST_NAMES = 85.0, 78.0, 3, 3, 3
_TOKEN_END = "카드"


def compact(text: str) -> str:
    """Lower case, letters and digits alone."""
    return "".join(c for c in text.lower() if c.isalnum())


def token_variants(text: str, stop: frozenset[str]) -> list[str]:
    """Words of two characters or more, each also without the card word at its end or start."""
    out = []
    for token in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        if len(token) >= 2 and token not in stop:
            forms = {token}
            if len(token) > len(_TOKEN_END):
                forms |= {token.removesuffix(_TOKEN_END), token.removeprefix(_TOKEN_END)}
            out += sorted(f for f in forms if f and f not in stop)
    return out


def token_score(variants: Sequence[str], name: str) -> int:
    """Per word in the compact name its length, and 2 more with an ASCII letter or digit."""
    return sum(len(v) + 2 * any(c.isascii() and c.isalnum() for c in v) for v in variants if v in name)


def with_guesses(rows: DataFrame, text: str, terms: DataFrame, asked: Mapping[str, tuple[str, Sequence[str]]], stop: Sequence[str] = (), column: str = "guesses") -> DataFrame:
    """rows with scored names for the dictionaries that found nothing. asked: dictionary to (column with what was found so
    far, kinds of guess: tokens, partial or weighted). Each block gives its best, so the best of all are among them."""
    spark, names, stops = rows.sparkSession, [], frozenset(stop)
    for block in _blocks(terms.filter(F.col("dictionary").isin(*asked)), ["dictionary", "canonical", "place", "own"]):
        shared, key = spark.sparkContext.broadcast([tuple(r) for r in block]), uuid.uuid4().hex

        def build(shared=shared):
            by: dict[str, list] = {}
            seen = set()
            for term, dictionary, canonical, place, own in shared.value:
                # of equal terms the first counts
                by.setdefault(dictionary, []).append((term, compact(term), canonical, place, own, (dictionary, term) not in seen))
                seen.add((dictionary, term))
            return by

        def each(batch: pa.RecordBatch, build=build, key=key) -> pa.Array:
            known = _once(key, build)
            found = {d: batch.column(c).to_pylist() for d, (c, _) in asked.items()}
            out = []
            for i, x in enumerate(batch.column(text)):
                t = x.as_py() or ""
                out.append([g for d, (_, kinds) in asked.items() if not found[d][i] for kind in kinds for g in _guessed(t, d, kind, known.get(d, []), stops)])
            return pa.array(out, _ARROW_GUESSES)

        names.append(f"{column}_{key}")
        rows = _appended(rows, GUESSES, names[-1], each)
    return rows.withColumn(column, F.concat(*names)).drop(*names)


def _guessed(text: str, dictionary: str, kind: str, known: list, stop: frozenset[str]) -> list[dict]:
    found = []
    if kind == "tokens":
        if variants := token_variants(text, stop):
            scored = [(float(token_score(variants, tight)), len(canonical), place, canonical) for _, tight, canonical, place, own, _ in known if own]
            best = max((s[0] for s in scored), default=0.0)
            found = [s for s in scored if s[0] == best and best >= TOKEN_LEAST]
    elif len(text) >= SHORTEST:
        tight = compact(text)
        scored = []
        for term, tight_term, canonical, place, _, first in known:
            if not first:
                continue
            score = fuzzy.partial_ratio(tight_term, tight, PARTIAL_LEAST) if kind == "partial" else fuzzy.weighted_ratio(text, term, WEIGHTED_LEAST)
            if score >= (PARTIAL_LEAST if kind == "partial" else WEIGHTED_LEAST):
                scored.append((score, len(term), place, canonical))
        found = sorted(scored, key=lambda s: (-s[0], s[2]))[:MOST_NAMES]
    return [{"dictionary": dictionary, "kind": kind, "score": s, "size": n, "place": p, "canonical": c} for s, n, p, c in found]


def best_names(guesses: Column, dictionary: str, kind: str) -> Column:
    """Of the fuzzy guesses the three best terms' names, best first; of the word guesses the names with the highest score in
    the dictionary's order, of more than three the shortest."""
    own = F.filter(guesses, lambda g: (g["dictionary"] == dictionary) & (g["kind"] == kind))
    if kind == "tokens":
        top = F.array_max(F.transform(own, lambda g: g["score"]))
        own = F.filter(own, lambda g: g["score"] == top)
        by = lambda g: F.struct(F.when(F.size(own) > MOST_NAMES, g["size"]).otherwise(0).alias("a"), g["place"].alias("b"), g["canonical"].alias("c"))
    else:
        by = lambda g: F.struct((-g["score"]).alias("a"), g["place"].alias("b"), g["canonical"].alias("c"))
    return F.array_distinct(F.transform(F.slice(F.array_sort(F.transform(own, by)), 1, MOST_NAMES), lambda g: g["c"]))


def _else(first: Column, then: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(then)


def signals(rows: DataFrame, text: str, terms: DataFrame, patterns: dict[str, str], info: list[str], usage: list[str], issuance: list[str], stop: Sequence[str] = ()) -> DataFrame:
    """rows with normalized, cards, actions, payments, weak, patterns, info, usage, issuance. terms: of dictionaries(), with
    the dictionaries card, action, payment and weak. Each takes whole terms; else contained ones; cards else the names that
    share most words with the text, else the best partial ratios; actions and payments else the best weighted ratios. Where
    weak intents were found, actions stay that another term than a weak one supports. Pattern hits join the actions."""
    columns = rows.columns
    kinds = ("card", "action", "payment", "weak")
    rows = rows.withColumn("normalized", T.normalize_query(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    weak_terms = terms.filter("dictionary = 'weak' AND NOT own").select(F.lower("term").alias("term"), F.lit(True).alias("__weak")).distinct()
    marked = terms.select("*", F.lower("term").alias("__term")).join(weak_terms, F.col("__term") == weak_terms["term"], "left").select(terms["dictionary"], "canonical", terms["term"], "own", "place", F.coalesce("__weak", F.lit(False)).alias("is_weak"))
    # the actions' strong terms are a dictionary of their own, so that their spans tell what supports an action
    strong = marked.filter("dictionary = 'action' AND NOT own AND NOT is_weak").withColumn("dictionary", F.lit("support"))
    whole = marked.drop("is_weak").unionByName(strong.drop("is_weak"))
    rows = with_spans(rows, "normalized", whole, "__spans")
    for kind in kinds:
        rows = rows.withColumn(f"__{kind}", _else(named(F.col("__spans"), kind), contained(F.col("__spans"), kind)))
    rows = with_guesses(rows, "normalized", terms, {"card": ("__card", ["tokens", "partial"]), "action": ("__action", ["weighted"]), "payment": ("__payment", ["weighted"])}, stop, "__guesses")
    guess = lambda d, kind: best_names(F.col("__guesses"), d, kind)
    cards = _else(F.col("__card"), _else(guess("card", "tokens"), guess("card", "partial")))
    actions = _else(F.col("__action"), guess("action", "weighted"))
    supported = contained(F.col("__spans"), "support")
    actions = F.when(F.size("__weak") > 0, F.array_intersect(actions, supported)).otherwise(actions)
    hits = T.composite_actions(F.col(text), patterns)
    flag = lambda words: any_of(F.col("normalized"), words)
    return rows.select(
        *columns, "normalized", cards.alias("cards"), F.array_distinct(F.concat(actions, hits)).alias("actions"), _else(F.col("__payment"), guess("payment", "weighted")).alias("payments"),
        F.col("__weak").alias("weak"), hits.alias("patterns"), flag(info).alias("info"), flag(usage).alias("usage"), flag(issuance).alias("issuance"),
    )


def product_candidates(rows: DataFrame, text: str, products: DataFrame, least: float = 0.6, k: int = 3) -> DataFrame:
    """id, product, score, rank: the k products that a text names best, ties in the table's order. rows: id, text; products:
    product, others (array of other names), place. Where the text stands in a name or a name in it, those products alone
    count; else shared keywords, else sound. Equal texts are scored once; texts without a sign and nulls name nothing."""
    spark, columns = rows.sparkSession, []
    texts = rows.select(F.col(text).alias("text")).filter(F.coalesce(F.trim("text") != "", F.lit(False))).distinct()
    for block in _blocks(products.withColumn("term", F.col("product")), ["product", "others", "place"]):
        shared, key = spark.sparkContext.broadcast([(r["product"], list(r["others"] or []), r["place"]) for r in block]), uuid.uuid4().hex

        def each(batch: pa.RecordBatch, shared=shared, key=key) -> pa.Array:
            known = _once(key, lambda: [(vocabulary.Product(name, others), name, place) for name, others, place in shared.value])
            out = []
            for x in batch.column("text"):
                whole = x.as_py()
                low, asked = vocabulary.tight(whole), vocabulary.keywords(whole)
                found = [(s, True, place, name) for p, name, place in known if (s := vocabulary.direct(low, p.name))]
                if not found:
                    letters = matching.letters(low)
                    found = [(s, False, place, name) for p, name, place in known if (s := p.scored(asked, letters, least))]
                found = sorted(found, key=lambda f: (-f[0], f[2]))[:k]
                out.append([{"score": s, "direct": d, "place": p, "product": n} for s, d, p, n in found])
            return pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("direct", pa.bool_()), ("place", pa.int64()), ("product", pa.string())])))

        columns.append(f"found_{key}")
        texts = _appended(texts, "array<struct<score: double, direct: boolean, place: bigint, product: string>>", columns[-1], each)
    every = F.concat(*columns)
    best = F.when(F.exists(every, lambda c: c["direct"]), F.filter(every, lambda c: c["direct"])).otherwise(every)
    order = F.slice(F.array_sort(F.transform(best, lambda c: F.struct((-c["score"]).alias("s"), c["place"].alias("place"), c["product"].alias("product")))), 1, k)
    chosen = texts.select("text", F.posexplode(order).alias("n", "c"))
    return rows.select("id", F.col(text).alias("text")).join(chosen, "text").select("id", F.col("c.product").alias("product"), F.round(-F.col("c.s"), 6).alias("score"), (F.col("n") + 1).cast("long").alias("rank"))
