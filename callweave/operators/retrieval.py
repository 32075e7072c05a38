"""After a search: rank fusion, boosts, per-title dedupe, lanes, retries, pins. vectors.py and textsearch.py search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import matching
from callweave.operators.pairing import by_kind, gathered, holders, met, numbered, places, ranged
from callweave.sources.stored import stored

RRF_K = 60


def rerank_by_terms(rows: DataFrame, terms: Column, *fields: str) -> DataFrame:
    """rows: query_id, id, rank. A stable order by the number of terms that stand in one of the fields."""
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "rank")
    return _counted(rows, terms, *fields).withColumn("rank", F.row_number().over(order).cast("long"))


def _counted(rows: DataFrame, terms: Column, *fields: str) -> DataFrame:
    """rows with hits, the number of terms that stand in one of the fields."""
    low = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    held = F.filter(terms, lambda t: (t != "") & F.exists(F.array(*low), lambda x: F.contains(x, F.lower(t))))
    return rows.withColumn("hits", F.size(held).cast("long"))


def kinds(rows: DataFrame, id: str, columns: Sequence[str], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows that are alike in the columns, told by one digest: (kind and its columns, each kind once; kind, id of all rows).
    What depends on nothing else is worked out for a kind and joined to its rows."""
    named = rows.select(F.col(id), *columns, F.sha2(F.to_json(F.struct(*columns)), 256).alias("kind"))
    return named.select("kind", *columns).dropDuplicates(["kind"]), named.select("kind", id)


def rerank_pairs(queries: DataFrame, rows: DataFrame, on: Sequence[str], *fields: str) -> DataFrame:
    """query_id, id, hits, rank: rerank_by_terms() of the rows that are equal to a query in `on`. queries: query_id, terms;
    rows: id, rank, fields. A kind of query is ranked once, and pairs are never moved: where rows are, in ranges of their
    rank, they are counted by query and hits; sums of these counts say where the ranks of a range begin, and the range is
    looked through again in order."""
    types = dict(queries.dtypes) | dict(rows.select("id").dtypes)
    asked, members = numbered(*kinds(queries, "query_id", [*on, "terms"]))
    wanted = F.transform(F.filter("terms", lambda t: t != ""), F.lower).alias("terms")
    asked = asked.select("kind", *on, wanted, F.when(F.col("terms").isNull(), F.size("terms").cast("long")).alias("absent"))
    texts = [F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"__text{n}") for n, f in enumerate(fields)]
    asked, held, ranges = ranged(asked, rows.select("id", "rank", *on, *texts), on, ["rank"])
    counts = met(places(asked, held), held, ranges, ["rank"], _reranked, _tallied, "__range int, kind long, hits long, n long")
    counts = stored(counts.groupBy("__range", "kind", "hits").agg(F.sum("n").alias("n")), "counts")
    before = Window.partitionBy("kind").orderBy(F.desc("hits"), "__range").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begin = begin.groupBy("__range", "kind").agg(F.collect_list(F.struct("hits", "base")).alias("bases"))
    return met(asked.join(begin, "kind").join(members, "kind"), held, ranges, ["rank"], _reranked, _placed, f"query_id {types['query_id']}, id {types['id']}, hits long, rank long")


def _reranked(questions: pa.Table) -> list[tuple]:
    """Of each kind of query: kind, terms, hits where it has no terms, ranks by hits that are given so far, ids."""
    last = "bases" in questions.column_names and questions.column("bases").null_count < len(questions)
    known = by_kind(questions, ["kind", "terms", "absent", *["bases"] * last])
    ids = questions.column("query_id").combine_chunks() if last else pa.nulls(len(questions))
    return [(kind, terms, absent, {b["hits"]: b["base"] for b in bases[0]} if bases else {}, ids.take(pa.array(at))) for (kind, terms, absent, *bases), at in known]


def _hits(part: pa.RecordBatch) -> Callable[[list | None], np.ndarray]:
    """Tells of each row how many of the terms it holds."""
    held = holders(*[part.column(c) for c in part.schema.names if c.startswith("__text")])

    def of(terms: list | None) -> np.ndarray:
        out = np.zeros(part.num_rows, np.uint16 if len(terms or []) < 1 << 16 else np.int64)
        for t in terms or []:
            out += held(t)
        return out

    return of


def _tallied(known: list[tuple], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    of, out = _hits(part), []
    for kind, terms, *_ in known:
        n = np.bincount(of(terms))
        out += [(kind, h, n[h]) for h in np.flatnonzero(n)]
    names, hits, n = zip(*out)
    yield pa.RecordBatch.from_arrays([pa.repeat(part.column("__range")[0], len(out)), pa.array(names, pa.int64()), pa.array(hits, pa.int64()), pa.array(n, pa.int64())], ["__range", "kind", "hits", "n"])


def _placed(known: list[tuple], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[list[pa.Array]]:
        of, id = _hits(part), part.column("id")
        for _, terms, absent, given, ids in known:
            hits = of(terms)
            order, rank, at = np.argsort(hits, kind="stable"), np.empty(len(hits), np.int64), 0
            for h, n in enumerate(np.bincount(hits).tolist()):
                if n:
                    rank[order[at : at + n]] = np.arange(given[h] + 1, given[h] + n + 1)
                    given[h] += n
                    at += n
            shown = pa.array(hits.astype(np.int64)) if terms is not None else pa.repeat(pa.scalar(absent, pa.int64()), len(hits))
            ranks = pa.array(rank)
            for query in ids:
                yield [pa.repeat(query, len(hits)), id, shown, ranks]

    yield from gathered(each(), ["query_id", "id", "hits", "rank"])


def rrf_rank(hits: DataFrame) -> DataFrame:
    """query_id, source, table, id, place. hits also has score and noisy. Rows are numbered by (query, source, table); of a
    document's rows the first counts, and noisy ones go, but the places they took stay taken."""
    order = Window.partitionBy("query_id", "source", "table").orderBy(F.desc("score"), "id")
    rows = hits.select("*", F.row_number().over(order).cast("long").alias("place")).filter(~F.coalesce("noisy", F.lit(False)))
    return rows.groupBy("query_id", "source", "table", "id").agg(F.min("place").alias("place"))


def hybrid_fusion(ranked: DataFrame) -> DataFrame:
    """query_id, table, id, score: sum of 1 / (60 + place) over sources; documents are told apart by table and id."""
    return ranked.groupBy("query_id", "table", "id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("place"))), 9).alias("score"))


def fused_lanes(lanes: DataFrame) -> DataFrame:
    """hybrid_fusion() of two lanes whose places stand in one row: query_id, table, id, and place and near, null where the
    lane lacks the document."""
    one, other = (F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0)) for c in ("place", "near"))
    return lanes.select("query_id", "table", "id", F.round(one + other, 9).alias("score"))


def noisy_guides(docs: DataFrame, least: int = 60) -> DataFrame:
    """Without documents that have no title or less than `least` characters."""
    return docs.filter((F.trim("title") != "") & (F.length(F.regexp_replace("content", r"\s", "")) >= least))


# Results depend on them. Additive boosts and penalties by rule.
BOOSTS = {"card": 0.2, "guide_card": 0.25, "intent": 0.15, "guide_title": 0.02, "payment": 0.1, "weak": 0.05, "category": 0.05, "reservation": 1.2, "guide_token": 0.004, "guide_hits": 0.01, "card_product_penalty": -0.06, "filter_term": 0.08, "card_product": 0.6, "noise": -0.15, "noise_strong": -0.2}


def boost(flags: dict[str, Column], wrong_card: Column) -> Column:
    """Sum of the boosts whose flag holds (or count, for whole numbers); 0 where the query has a card the document lacks."""
    total = F.lit(0.0)
    for name, flag in flags.items():
        total = total + flag.cast("int") * BOOSTS[name]
    return F.when(wrong_card, 0.0).otherwise(total)


def finalize(candidates: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank. candidates: query_id, id, title, content_length, score, matched: if any matched, only
    matched ones; of one title the longest, best scored; then the k best."""
    any_match = F.max(F.col("matched").cast("int")).over(Window.partitionBy("query_id"))
    rows = candidates.withColumn("__any", any_match).filter("__any = 0 OR matched").drop("__any")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    one = Window.partitionBy("query_id", "__title").orderBy(F.desc("content_length"), F.desc("score"), "id")
    rows = rows.withColumn("__title", title).withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def lane_selection(ranked: DataFrame, k: int) -> DataFrame:
    """k - 1 cards, one guide, then the best of the rest. ranked: query_id, id, lane (card, guide), score."""
    in_lane = Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "id")
    rows = ranked.withColumn("__lane", F.row_number().over(in_lane))
    first = ((F.col("lane") == "card") & (F.col("__lane") <= k - 1)) | ((F.col("lane") == "guide") & (F.col("__lane") <= 1))
    order = Window.partitionBy("query_id").orderBy(first.desc(), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "lane", "rank")


def lanes_by_route(ranked: DataFrame, k: int) -> DataFrame:
    """query_id, id, lane, rank. ranked: query_id, id, lane (card, guide), score, route, mixed. Without mixing only the
    route's own lane counts. Mixed, information takes k - 1 cards (one at least) and a guide first, usage one card and one
    guide; the best of the rest fill up. The chosen are ranked by score."""
    in_lane = Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "id")
    info, card, n = F.col("route") == "card_info", F.col("lane") == "card", F.col("__lane")
    rows = ranked.filter(F.coalesce("mixed", F.lit(False)) | (card == F.coalesce(info, F.lit(False)))).withColumn("__lane", F.row_number().over(in_lane))
    first = F.when(card, n <= F.when(info, max(1, k - 1)).otherwise(1)).otherwise(n <= 1)
    chosen = Window.partitionBy("query_id").orderBy(F.desc(first), F.when(info & first, card.cast("int")).desc(), F.desc("score"), "id")
    rows = rows.withColumn("__n", F.row_number().over(chosen)).filter(F.col("__n") <= k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.select("query_id", "id", "lane", F.row_number().over(order).cast("long").alias("rank"))


def stage_fallback(rows: DataFrame, flag: Column) -> DataFrame:
    """Rows with the flag; all of a query's rows where none has it."""
    some = F.max("__flag").over(Window.partitionBy("query_id"))
    return rows.withColumn("__flag", flag.cast("int")).withColumn("__some", some).filter("__flag = 1 OR __some = 0").drop("__flag", "__some")


def pin_documents(results: DataFrame, pins: DataFrame, most: int = 2) -> DataFrame:
    """results: query_id, id, rank. pins: query_id, id, pin_rank. Pinned results are marked, up to `most` new ones added."""
    joined = results.join(pins, ["query_id", "id"], "full_outer")
    new = Window.partitionBy("query_id", F.col("rank").isNull()).orderBy("pin_rank", "id")
    rows = joined.withColumn("__new", F.row_number().over(new)).filter(F.col("rank").isNotNull() | (F.col("__new") <= most))
    return rows.select("query_id", "id", "rank", F.col("pin_rank").isNotNull().alias("pinned"), "pin_rank")


def guidance_topk(rows: DataFrame, k: int = 4) -> DataFrame:
    """Pinned by pin rank, then by (hits, score), at most k. rows: query_id, id, pin_rank, hits, score."""
    order = Window.partitionBy("query_id").orderBy(F.col("pin_rank").asc_nulls_last(), F.desc("hits"), F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)


def promote(rows: DataFrame, flag: Column) -> DataFrame:
    """The first flagged row of a query moves to the front. rows: query_id, id, rank."""
    first = F.min(F.when(flag, F.col("rank"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("__first", first)
    order = Window.partitionBy("query_id").orderBy((F.col("rank") == F.col("__first")).desc_nulls_last(), "rank")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).drop("__first")


def split_current_next(rows: DataFrame, blocked: Column, each: int = 2) -> DataFrame:
    """slot current or next: blocked ones come last. rows: query_id, id, rank."""
    order = Window.partitionBy("query_id").orderBy(blocked.cast("int"), "rank")
    rows = rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= 2 * each)
    return rows.select("query_id", "id", F.when(F.col("__n") <= each, "current").otherwise("next").alias("slot"), F.col("__n").cast("long").alias("place"))


def retrieval_failed(results: DataFrame, queries: DataFrame, least: float = 0.05) -> DataFrame:
    """query_id, failed: no result or a best score below `least`."""
    top = results.groupBy("query_id").agg(F.max("score").alias("top"))
    return queries.select("query_id").distinct().join(top, "query_id", "left").select("query_id", F.coalesce(F.col("top") < least, F.lit(True)).alias("failed"))


def retry_decision(results: DataFrame, queries: DataFrame, least: float = 0.05, domain: int = 3) -> DataFrame:
    """query_id, failed, action, route. results: query_id, rank (from 1), score, card_match. queries: query_id, route,
    card_asked, mode, domain_score, each once. A search failed without a result, with a first score below `least`, or where
    information on a card was asked and the first result is no match of it. Failed ones that were not hybrid are searched
    again so; otherwise those without any result and a domain score of `domain` or more take the other route."""
    top = results.filter("rank = 1").select("query_id", "score", "card_match", F.lit(True).alias("__found"))
    rows = queries.join(top, "query_id", "left")
    none, wrong = F.col("__found").isNull(), (F.col("route") == "card_info") & F.col("card_asked") & ~F.col("card_match")
    failed = none | F.coalesce(F.col("score") < least, F.lit(False)) | F.coalesce(wrong, F.lit(False))
    action = F.when(failed & ~F.col("mode").eqNullSafe("hybrid"), "hybrid").when(none & (F.col("domain_score") >= domain), "flip").otherwise("keep")
    flipped = F.when(F.col("route") == "card_info", "card_usage").when(F.col("route") == "card_usage", "card_info").otherwise(F.col("route"))
    rows = rows.withColumn("failed", failed).withColumn("action", action)
    return rows.select("query_id", "failed", "action", F.when(F.col("action") == "flip", flipped).otherwise(F.col("route")).alias("route"))


def card_info_stop(results: DataFrame, top: float = 0.35, gap: float = 0.08, low: float = 0.22, low_gap: float = 0.04) -> DataFrame:
    """results: query_id, rank (from 1), score, card. query_id, stop (the lexical pass is enough: a good result clearly
    ahead or alone, or the first three share one card) and vector (a further pass pays: weak, close or mixed results)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "score", F.lower(F.replace(F.coalesce("card", F.lit("")), F.lit(" "), F.lit(""))).alias("card"))))
    heads = results.filter("rank <= 3").groupBy("query_id").agg(ranked.alias("r"))
    first, second = F.get("r", F.lit(0))["score"], F.get("r", F.lit(1))["score"]
    cards = F.array_distinct(F.transform("r", lambda x: x["card"]))
    ahead = F.coalesce((first >= top) & (second.isNull() | (first - second >= gap)), F.lit(False))
    one = first.isNotNull() & (F.size("r") == 3) & (F.size(cards) == 1) & (cards[0] != "")
    mixed = F.size(F.array_remove(cards, "")) > 1
    return heads.select("query_id", (ahead | one).alias("stop"), (first.isNull() | (first < low) | F.coalesce(first - second < low_gap, F.lit(False)) | mixed).alias("vector"))


def fetch_by_ids(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: query_id, id, score. A query with any missing id gives nothing."""
    joined = wanted.join(docs.select("id", "title").withColumn("__there", F.lit(1)), "id", "left")
    missing = F.sum(F.col("__there").isNull().cast("int")).over(Window.partitionBy("query_id"))
    return joined.withColumn("__missing", missing).filter("__missing = 0").select("query_id", "id", "score", "title")


def regression(cases: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, route_ok, required_ok, forbidden_ok, answer_ok, passed. cases: query_id, route, must_have and must_not (ids),
    must_say and must_not_say (terms, whatever their case); null asks for nothing. answers: query_id, route, answer. A query
    without results or answer has none of what is asked."""
    got = results.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    said = answers.select("query_id", F.col("route").alias("got_route"), F.lower(F.coalesce("answer", F.lit(""))).alias("answer"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    rows = cases.join(got, "query_id", "left").join(said, "query_id", "left").withColumn("ids", none("ids", "bigint")).withColumn("answer", F.coalesce("answer", F.lit("")))
    holds = lambda t: F.contains(F.col("answer"), F.lower(t))
    rows = rows.select(
        "query_id", (F.col("route").isNull() | F.col("route").eqNullSafe(F.col("got_route"))).alias("route_ok"), (F.size(F.array_except(none("must_have", "bigint"), F.col("ids"))) == 0).alias("required_ok"),
        (F.size(F.array_intersect(none("must_not", "bigint"), F.col("ids"))) == 0).alias("forbidden_ok"), (F.forall(none("must_say", "string"), holds) & ~F.exists(none("must_not_say", "string"), holds)).alias("answer_ok"),
    )
    return rows.withColumn("passed", F.col("route_ok") & F.col("required_ok") & F.col("forbidden_ok") & F.col("answer_ok"))


def pass_rate(checked: DataFrame) -> DataFrame:
    """cases, passed, rate (percent). checked: of regression()."""
    won = F.count_if("passed")
    return checked.agg(F.count(F.lit(1)).alias("cases"), won.alias("passed"), F.round(100.0 * F.try_divide(won, F.count(F.lit(1))), 1).alias("rate"))


def random_per_category(rows: DataFrame, category: str, seed: int = 42) -> DataFrame:
    """One row a category, the same for the same seed; pre-aggregated, no window over a hot category."""
    return rows.groupBy(category).agg(F.min_by("id", F.struct(F.xxhash64(F.lit(seed), "id"), "id")).alias("id"))


def dictionary_match(rows: DataFrame, terms: Sequence[str], text: str = "content") -> DataFrame:
    """id, terms: dictionary terms in order of first place, longest at a place, not inside a longer ASCII word."""
    words = sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        inner = set("abcdefghijklmnopqrstuvwxyz0123456789_")
        for f in frames:
            found = []
            for t in f[text].fillna("").str.lower():
                last, hits = -1, {}
                spans = sorted(((e - len(w) + 1, -len(w), w) for e, w in machine.iter(t)))
                for begin, size, w in spans:
                    end = begin - size
                    if begin <= last or (begin and t[begin - 1] in inner) or (end < len(t) and t[end] in inner):
                        continue
                    hits.setdefault(w, None)
                    last = end - 1
                found.append(list(hits))
            yield pd.DataFrame({"id": f["id"], "terms": found})

    return rows.select("id", text).mapInPandas(run, "id long, terms array<string>")


def fuzzy_match(rows: DataFrame, terms: Sequence[str], text: str, least: float = 0.78, k: int = 3) -> DataFrame:
    """id, term, score: the k best terms of a short text by partial ratio; equal texts are scored once."""
    names = sorted(set(terms))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f["__text"]:
                scores = sorted(((round(matching.partial_ratio(n, t), 6), n) for n in names), key=lambda x: (-x[0], x[1]))
                out += [(t, n, s) for s, n in scores[:k] if s >= least]
            yield pd.DataFrame(out, columns=["__text", "term", "score"])

    keyed = rows.select("id", F.lower(F.col(text)).alias("__text")).filter(F.length("__text") >= 3)
    scored = keyed.select("__text").distinct().mapInPandas(run, "__text string, term string, score double")
    return keyed.join(scored, "__text").select("id", "term", "score")


def vocabulary_candidates(rows: DataFrame, products: Sequence[str], text: str, least: float = 0.6, k: int = 3) -> DataFrame:
    """id, product, score: containment either way, else phonetic similarity; the k best of `least` or more."""
    names = sorted(set(products))

    def score(t: str, name: str) -> float:
        a, b = t.replace(" ", ""), name.lower().replace(" ", "")
        if a == b:
            return 1.0
        if b in a:
            return 0.95
        if a and a in b:
            return 0.88 + 0.10 * len(a) / len(b)
        return matching.phonetic_similarity(a, b)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f["__text"]:
                best = sorted(((round(score(t, n), 6), n) for n in names), key=lambda x: (-x[0], x[1]))[:k]
                out += [(t, n, s) for s, n in best if s >= least]
            yield pd.DataFrame(out, columns=["__text", "product", "score"])

    keyed = rows.select("id", F.lower(F.col(text)).alias("__text"))
    return keyed.join(keyed.select("__text").distinct().mapInPandas(run, "__text string, product string, score double"), "__text").select("id", "product", "score")


def chunk_documents(rows: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """id, chunk (number), text of pieces of titled documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, n, piece) for i, t, c in zip(f["id"], f["title"], f["content"]) for n, piece in enumerate(matching.split_text(f"제목: {t}\n\n내용: {c}", size, overlap))]
            yield pd.DataFrame(out, columns=["id", "chunk", "text"])

    return rows.select("id", "title", "content").mapInPandas(run, "id long, chunk long, text string")


def scope_filter(rows: DataFrame, scope: str, key: str = "id", scopes: dict[str, list[tuple[str, bool]]] | None = None) -> DataFrame:
    """Rows whose id fits a named scope: (LIKE pattern, wanted) pairs, all of which must hold."""
    for pattern, wanted in (scopes or SCOPES)[scope]:
        rows = rows.filter(F.col(key).like(pattern) if wanted else ~F.col(key).like(pattern))
    return rows


# Results depend on them.
SCOPES = {
    "guide_merged": [("%_merged", True)],
    "guide_general": [("sinhan_terms_%", False), ("%_merged", False), ("hyundai_applepay_%", False)],
    "guide_all": [("sinhan_terms_%", False), ("hyundai_applepay_%", False)],
    "guide_with_terms": [("hyundai_applepay_%", False)],
    "terms": [("sinhan_terms_%", True)],
    "hyundai_applepay": [("hyundai_applepay_%", True)],
}
