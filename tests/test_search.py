"""Vector and text search against brute force: ties, nulls, empty tables, blocks of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.operators import retrieval, textsearch, vectors


def grams(text):
    words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def top(rows, k):
    return [(q, i, rank) for q, hits in rows.items() for rank, (_, i) in enumerate(sorted(hits)[:k], 1)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_nearest(spark, monkeypatch, metric, bound):
    """Broadcast and salted blocks of queries, several blocks a side, tags, ties and odd rows."""
    monkeypatch.setattr(vectors, "BROADCAST_VALUES", bound)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 20)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), [["a"], ["b", "c"], None, []][i % 4]) for i in range(60)]
    odd = [(100, None, ["a"]), (101, [], ["a"]), (102, [1.0], ["a"]), (103, [0.0] * 4, ["a"]), (104, [None, 1.0, 1.0, 1.0], ["a"]), (105, [float("nan"), 1.0, 1.0, 1.0], ["a"])]
    wanted = [[], ["a"], ["b", "a"], None, ["none"]]
    queries = [(q, rng.integers(-2, 3, 4).astype(float).tolist(), wanted[q % 5]) for q in range(10)] + [(20, None, []), (21, [1.0] * 5, [])]
    kind = "{} long, embedding array<double>, tags array<string>"
    got = vectors.nearest(spark.createDataFrame(rows + odd, kind.format("id")).repartition(3), spark.createDataFrame(queries, kind.format("query_id")), 7, metric, "tags")
    want = {}
    for q, v, tags in queries[:10]:
        v = np.array(v)
        for i, x, own in rows:
            x = np.array(x)
            if x.any() and (metric == "l2" or v.any()) and (not tags or set(tags) & set(own or [])):
                score = x @ v / np.linalg.norm(x) / np.linalg.norm(v) if metric == "cosine" else 1 - np.linalg.norm(x - v)
                want.setdefault(q, []).append((round(-score, 9), i))
    got = got.collect()
    assert sorted((r.query_id, r.rank) for r in got) == sorted((q, n) for q, _, n in top(want, 7))
    best = {(q, i): -s for q, hits in want.items() for s, i in hits}
    scores = {q: sorted(hits)[:7] for q, hits in want.items()}
    assert all(abs(r.score - best[r.query_id, r.id]) < 1e-6 and abs(r.score + scores[r.query_id][r["rank"] - 1][0]) < 1e-6 for r in got)
    none = spark.createDataFrame([], kind.format("id"))
    assert vectors.nearest(none, spark.createDataFrame(queries, kind.format("query_id")), 7).count() == 0
    assert vectors.nearest(spark.createDataFrame(rows, kind.format("id")), none.withColumnRenamed("id", "query_id"), 7).count() == 0


def test_filtered_stages(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], ["a"], "Lost card"), (2, [0.9, 0.1], ["b"], "limits"), (3, [0.0, 1.0], None, None)], "id long, embedding array<double>, tags array<string>, title string")
    queries = [(1, ["a"], None), (2, ["x"], None), (3, ["x"], ["LOST", "fee"]), (4, ["x"], ["nothing"]), (5, None, None), (6, ["x"], [])]
    asked = spark.createDataFrame([(q, [1.0, 0.0], w, i) for q, w, i in queries], "query_id long, embedding array<double>, wanted array<string>, intents array<string>")
    got = sorted((r.query_id, r.stage, r.id) for r in vectors.filtered(rows, asked, 2).collect())
    assert got == [(1, "filtered", 1), (2, "all", 1), (2, "all", 2), (3, "title", 1), (5, "filtered", 1), (5, "filtered", 2)]


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_trigram_join(spark, monkeypatch, least):
    rng = random.Random(3)
    words = ["card", "cards", "카드", "카드발급", "limit", "limits", "a", "lost", "the", "the", "the", "été"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(120)] + [None, "", "!!", "the " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = [(i, t) for i, t in enumerate(texts) if i % 5 == 0]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = {(q, i): similarity(a, b) for q, a in asked for i, b in enumerate(texts) if grams(a) and similarity(a, b) >= least - 1e-12}
    for bound in (1 << 20, 0):  # trigrams and ranks broadcast, or shuffled
        monkeypatch.setattr(textsearch, "BROADCAST_ROWS", bound)
        got = {(r.query_id, r.id): r.similarity for r in textsearch.trigram_matches(rows, queries, least).collect()}
        assert got == pytest.approx(want) and len(want) > 30
    assert textsearch.trigram_matches(rows.limit(0), queries, least).count() == 0


def test_contained_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The CARD's limit", "Title", None), (2, None, "a limit", "src"), (3, "", "", ""), (4, "ab" * 3000 + "needle", None, None)], "id long, content string, title string, category string")
    terms = ["card", "LIMIT", "imi", "needle", "limittitle", "bab", "카드", "title"]
    want = sorted((i, t.lower()) for i, *fields in docs.collect() for t in terms if any(t.lower() in (f or "").lower() for f in fields))
    for most in (200_000, 2):
        monkeypatch.setattr("callweave.operators.lexicon.MOST_TERMS", most)
        got = textsearch.contained_terms(docs, spark.createDataFrame([(t,) for t in [*terms, "", None, "card"]], "term string"))
        assert sorted(map(tuple, got.collect())) == want


def test_text_search(spark):
    docs = [(17, "the card was lost", "Lost card", "loss"), (2, "limits of cards", "Limits", "limit"), (3, None, None, None), (4, "lost and found, lost", "x", "y")]
    table = spark.createDataFrame(docs, "id long, content string, title string, category string")
    queries = [(1, ["lost", "card", "the", "fee"]), (2, ["imit", "nd f"]), (3, ["zzz"]), (4, []), (5, ["of"])]
    got = {}
    for r in textsearch.text_search(table, spark.createDataFrame(queries, "query_id long, terms array<string>"), 3, bonus={"%7": 0.5}).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.stage, round(r.score, 6)))
    want = {}
    for q, terms in queries:
        compared = [t for t in terms if len(t) >= 3][:3]
        value = lambda d, t: max(similarity(f, t) for f in d[1:] if f) if any(d[1:]) else 0.0
        hits = [d for d in docs if any(value(d, t) >= 0.3 for t in compared)]
        stage = "trigram" if hits else "contained"
        hits = hits or [d for d in docs if any(t in (f or "").lower() for t in terms for f in d[1:])]
        rows = sorted((-round(sum(value(d, t) for t in compared) + 0.5 * str(d[0]).endswith("7"), 9), d[0]) for d in hits)[:3]
        if rows:
            want[q] = [(n, i, stage, round(-s, 6)) for n, (s, i) in enumerate(rows, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want and {s for x in want.values() for _, _, s, _ in x} == {"trigram", "contained"}


def covers(text, query):
    words = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()
    need, w = set(words(query)), words(text)
    at = [i for i, x in enumerate(w) if x in need]
    if not need or not need <= set(w):
        return None
    full = [(i, j) for i in at for j in at if i <= j and need <= set(w[i : j + 1])]
    shortest = [(i, j) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full)]
    return round(sum(0.1 / (1 + (j - i) - (sum(i <= p <= j for p in at) - 1)) for i, j in shortest), 9)


def test_cover_ranks(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "c", "the,", "X!"], k=rng.randrange(0, 14))) for _ in range(60)] + [None, "", "a " * 300]
    queries = [(1, "a"), (2, "a b"), (3, "The a? b"), (4, "c c x"), (5, "nowhere a"), (6, ""), (7, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = {(q, i): covers(t, x) for q, x in queries for i, t in enumerate(texts) if covers(t, x) is not None}
    got = {(r.query_id, r.id): r["rank"] for r in textsearch.cover_ranks(docs, asked).collect()}
    assert got == pytest.approx(want) and len(want) > 80
    pairs = spark.createDataFrame([(2, 0), (2, 1), (3, 2), (5, 3), (9, 1)], "query_id long, id long")
    some = {(r.query_id, r.id) for r in textsearch.cover_ranks(docs, asked, pairs=pairs).collect()}
    assert some == {k for k in want if k in {(2, 0), (2, 1), (3, 2), (5, 3)}}


def test_case_search_without_vectors(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0], "a", "lost the card"), (2, None, "a", "card card"), (3, [0.0, 1.0], "b", None), (4, [0.5, 0.5], "b", "card and lost")], "id long, embedding array<double>, category string, text string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a", "lost card"), (2, [1.0, 0.0], "z", "lost"), (3, None, "a", "lost card"), (4, None, None, "zzz")], "query_id long, embedding array<double>, category string, text string")
    got = {}
    for r in textsearch.case_search(cases, queries, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.stage, round(r.vector_score, 4), round(r.text_score, 4)))
    assert {q: sorted(v) for q, v in got.items()} == {
        1: [(1, 1, "category", 1.0, 0.05)], 2: [(1, 1, "all", 1.0, 0.1), (2, 4, "all", 0.7071, 0.1)],
        3: [(1, 1, "text", 0.0, 0.05), (2, 4, "text", 0.0, 0.05)], 4: [(1, 1, "text", 0.0, 0.0), (2, 2, "text", 0.0, 0.0)],
    }


def test_query_terms(spark):
    """Marks inside a word go, they don't split it; a final `란` goes before the ending."""
    row = spark.createDataFrame([("K-패스 국민행복(카드) 연회비란 ?! 란 12 a1 분실·도난은",)], "q string").select(T.query_terms(F.col("q"), ["연회"], ["은"]).alias("t")).first()
    assert row.t == ["k패스", "국민행복카드", "연회비", "a1", "분실도난"]


def test_replays_bring_out_the_last_windows(spark):
    """A replay gives the rows of its batch twin, the last day included."""
    from callweave.plans import search
    from callweave.streaming import jobs

    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, search.QUERIES["stream_daily_downloads"](spark, folder).collect()))
    want = sorted(map(tuple, jobs.daily_downloads(jobs.timed(search._downloads(spark, folder))).collect()))
    assert got == want and len(want) == 30


def test_cooldown(spark):
    """Greedy fold in order against jumps, with ties, all five reasons to ask, and one long session."""
    import datetime as dt

    from callweave.streaming import jobs

    rng = random.Random(6)
    begin = dt.datetime(2024, 1, 1)
    rows = [(s, s * 1000 + i, begin + dt.timedelta(milliseconds=500 * rng.randrange(200 if s else 4000)), rng.choice([True, False, False, None]), rng.randrange(3), rng.choice([None, 0.5, 0.6]), rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2])) for s in range(4) for i in range(600 if s == 0 else 25)]
    rows += [(9, 1, begin, None, None, None, None, None), (9, 2, begin, True, 0, 0.0, 0, 0), (9, 3, begin, True, 0, 0.0, 0, 0), (9, 4, begin + dt.timedelta(seconds=11.9), True, 0, 0.0, 0, 0), (9, 5, begin + dt.timedelta(seconds=12), True, 0, 0.0, 0, 0)]
    want, last = {}, {}
    for s, i, ts, flag, hits, confidence, turn, sentences in sorted(rows, key=lambda r: (r[2], r[1])):
        fine = (bool(flag) or (hits or 0) >= 2 or (confidence or 0) >= 0.6 or (turn or 0) >= 2 or (sentences or 0) >= 2) and (s not in last or (ts - last[s]).total_seconds() >= 12)
        last |= {s: ts} if fine else {}
        want[s, i] = fine
    df = spark.createDataFrame(rows, "session_id long, id long, ts timestamp_ntz, flag boolean, hits int, confidence double, turn int, sentences int")
    assert {(r.session_id, r.id): r.allowed for r in jobs.cooldown(df).collect()} == want and 20 < sum(want.values()) < 400
    assert jobs.cooldown(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = ["tel (02 - 123 - 4567) x", "1588-1234 / 010‑1234‑5678", "12345678", "see A.COM or www.x.y", "고객센터 1588\n안내 a@b.co", "테디카드 안내 ( )", "12-34"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(T.redact(F.col("t")).alias("t")).collect()]
    assert got == ["tel  x", " / ", "", "see  or ", "\n안내 ", " 안내 ", "12-34"]
    assert spark.range(1).select(T.redact(F.lit("문의 010-1234-5678"), keep_phone=True).alias("t")).first().t == "문의 010-1234-5678"


def test_rerank_by_kinds(spark):
    """A kind of query is ranked once, and its rows count terms once for each kind."""
    rows = spark.createDataFrame([(i, i, i % 2, ["red ring", "blue bolt", None][i % 3], "x") for i in range(24)], "id long, rank long, part long, title string, content string")
    queries = spark.createDataFrame([(n, n % 2, [["red", ""], ["bolt", "x"]][n % 3 > 0]) for n in range(6)], "query_id long, part long, terms array<string>")
    got = retrieval.rerank_pairs(queries, rows, ["part"], "title", "content")
    want = retrieval.rerank_by_terms(rows.join(queries, "part"), F.col("terms"), "title", "content").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("most", [20_000, 3])
def test_rerank_moves_no_pairs(spark, monkeypatch, most):
    """Rows are ranked where they are, from counts of the ranges before: rows and queries of which hardly two are alike, with
    nulls, several ranges and parts of queries."""
    monkeypatch.setattr("callweave.operators.pairing.MOST_QUESTIONS", most)
    rng = random.Random(most)
    words = ["Red", "ring", "blue", "bolt", "ñu", "old", ""]
    maybe = lambda x: x if rng.random() > 0.15 else None
    some = lambda: " ".join(rng.choices(words, k=3))
    rows = spark.createDataFrame([(maybe(i), 1000 - i, maybe(i % 3), maybe(f"{some()} {i}"), maybe(some())) for i in range(300)], "id long, rank long, part long, title string, content string")
    queries = spark.createDataFrame([(n, maybe(n % 3), maybe([*rng.choices(words, k=4), maybe(str(n))])) for n in range(24)] + [(99, 50, ["red"]), (2, 2, ["RED", "red"])], "query_id long, part long, terms array<string>")
    got = retrieval.rerank_pairs(queries, rows, ["part"], "title", "content")
    pairs = rows.join(queries.filter("query_id != 2"), "part")
    want = retrieval.rerank_by_terms(pairs, F.col("terms"), "title", "content").select(*got.columns)
    assert sorted(map(str, got.filter("query_id != 2").collect())) == sorted(map(str, want.collect())) != []
    above = got._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
    assert above[1] and not any(x in above[0] for x in ("Exchange", "Join", "Window"))


def test_trigrams_of_equal_texts_are_compared_once(spark, monkeypatch):
    compared = []
    whole = textsearch.similar_sets
    monkeypatch.setattr(textsearch, "similar_sets", lambda left, right, least: compared.append((left.count(), right.count())) or whole(left, right, least))
    titles = spark.createDataFrame([(i, ["small ring", "large bolt", "", None][i % 4]) for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(i, ["small rings", "none"][i % 2]) for i in range(10)], "query_id long, text string")
    got = sorted((r.query_id, r.id) for r in textsearch.trigram_matches(titles, queries, 0.5).collect())
    assert got == [(q, i) for q in range(0, 10, 2) for i in range(0, 40, 4)] and compared == [(2, 2)]


@pytest.mark.parametrize("most", [200_000, 4])
def test_term_places(spark, monkeypatch, most):
    """Places of a lane against a list of its rows in order: ties, second rows, noise, repeated ids, rows of another lane that
    this one lacks, one block of queries and several."""
    monkeypatch.setattr("callweave.operators.lexicon.MOST_TERMS", most)
    monkeypatch.setattr(textsearch, "RANGE_ROWS", 9)
    rng = random.Random(4)
    words = ["card", "lost", "fee", "limit", "ring"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4))), rng.choice(["Card", None, "x"])) for i in [*range(-40, 160), 3, 3, 8, 157, 1 << 54]]
    asked = [(q, rng.sample(words, rng.randrange(4)) + rng.choice([[], ["CARD", "", "ost"], ["zzz"]])) for q in range(12)] + [(99, None)]
    marks = lambda i: ("even" if i % 2 == 0 else "odd", i % 7 == 0, i % 3 == 0)
    near = {(q, i): n for n, (q, i) in enumerate(sorted({(rng.choice([*range(12), 99, 50]), rng.randrange(-60, 180)) for _ in range(90)}), 1) if i % 7}
    hits, want = {}, {}
    for i, *fields in rows:
        for q, terms in asked:
            n = len({t.lower() for t in terms or [] if t and any(t.lower() in (f or "").lower() for f in fields)})
            hits[q, i] = hits.get((q, i), 0) + n
    for lane in {(q, marks(i)[0]) for q, i in hits}:
        own = {i: n for (q, i), n in hits.items() if n and (q, marks(i)[0]) == lane}
        listed = sorted([(-n, i) for i, n in own.items()] + [(0.5 - n, i) for i, n in own.items() if marks(i)[2]])
        for place, (score, i) in enumerate(listed, 1):
            if score == -own[i] and not marks(i)[1]:
                want[lane[0], lane[1], i] = (place, None)
    alone = dict(want)
    for (q, i), n in near.items():
        want[q, marks(i)[0], i] = (want.get((q, marks(i)[0], i), (None,))[0], n)
    docs = spark.createDataFrame([(*r, *marks(r[0])) for r in rows], "id long, content string, title string, table string, noisy boolean, again boolean").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>")
    other = spark.createDataFrame([(q, marks(i)[0], i, n) for (q, i), n in near.items()], "query_id long, table string, id long, place long")
    for beside, expected in ((None, alone), (other, want)):
        got = textsearch.term_places(docs, queries, beside).collect()
        assert {(r.query_id, r.table, r.id): (r.place, r.near) for r in got} == expected and len(got) == len(expected) > 300
    assert {(r.place is None, r.near is None) for r in got} == {(False, False), (False, True), (True, False)}
    assert textsearch.term_places(docs.limit(0), queries).count() == textsearch.term_places(docs, queries.limit(0)).count() == 0
    assert textsearch.term_places(docs.limit(0), queries, other).count() == len(near)


def test_pairs_by_tiles(monkeypatch):
    """Pairs are the same whatever a tile holds; a document is never cut."""
    import pyarrow as pa

    rng = random.Random(5)
    terms = pa.array([sorted(rng.sample(range(6), rng.randrange(6))) for _ in range(50)] + [None, [1, 1, 2]], pa.list_(pa.int32()))
    start, queries = np.array([0, 2, 2, 5, 6, 8, 9]), np.array([0, 3, 0, 1, 2, 3, 1, 3, 2])
    found = {}
    for most in (1 << 20, 6):
        monkeypatch.setattr(textsearch, "MOST_PAIRS", most)
        tiles = list(textsearch._pairs(terms, start, queries))
        assert (len(tiles) > 5) == (most == 6) and [t[0] for t in tiles[1:]] == [t[1] for t in tiles[:-1]]
        assert all(list(zip(q, n, i)) == sorted(zip(q, n, i)) for _, _, q, n, i in tiles)
        found[most] = {(int(q), low + int(i)): int(n) for low, _, *rows in tiles for q, n, i in zip(*rows)}
    want = {}
    for i, own in enumerate(terms.to_pylist()):
        for t in own or []:
            for q in queries[start[t] : start[t + 1]].tolist():
                want[q, i] = want.get((q, i), 0) + 1
    assert found[6] == found[1 << 20] == want


def _after_the_pairs(spark, name):
    """The plan of what follows once pairs of queries and documents are made."""
    from callweave.plans import search

    plan = search.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    return plan.split("MapInArrow")[0]


def test_fused_pairs_are_not_moved(spark):
    after = _after_the_pairs(spark, "hybrid_fusion")
    assert not any(step in after for step in ("Aggregate", "Window", "Join", "Sort", "Repartition"))


def test_ranked_pairs_are_not_moved(spark):
    after = _after_the_pairs(spark, "rrf_rank")
    assert "Union" in after and not any(step in after for step in ("Aggregate", "Window", "Join", "Sort", "Repartition"))
