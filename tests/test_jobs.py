"""Hand-made cases of jobs."""

import datetime as dt
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from callweave.functions import matching
from callweave.functions import text as T
from callweave.operators import calls, ingest, retrieval, transcripts, vectors
from callweave.streaming import jobs


def test_fcr_days_and_null_keys(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, 1, "a", day(1)), (2, 1, "a", day(1)), (3, 1, "a", day(8)), (4, 1, "a", day(16)), (5, 2, None, day(1)), (6, 2, None, day(2)), (7, 3, "", day(1)), (8, 3, "", day(2))]
    got = {r.id: r.fcr for r in calls.fcr_flags(spark.createDataFrame(rows, "id long, customer_id long, category_raw string, call_date date")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True}


def test_durations(spark):
    rows = [(None, 0), ("", 0), ("5:07", 307), ("61:00", 3660), ("1:02:03", 3723), ("abc", 0)]
    df = spark.createDataFrame(rows, "t string, n long")
    assert all(r.s == r.n for r in df.select("n", calls.duration_seconds(F.col("t")).alias("s")).collect())


def test_relevance_scores(spark):
    as_of = dt.date(2024, 6, 30)
    rows = [(i, i, as_of - dt.timedelta(days=d)) for i, d in enumerate([0, 7, 8, 30, 31, 36, 90, 91])]
    got = {r.id: (r.score, r.level) for r in calls.consultation_relevance(spark.createDataFrame(rows, "id long, customer_id long, call_date date"), as_of).collect()}
    assert got == {0: (100, "high"), 1: (65, "high"), 2: (63, "medium"), 3: (19, "medium"), 4: (20, "low"), 5: (19, "low"), 6: (10, "low"), 7: (0, "none")}


def test_upsert_twice_equals_once(spark):
    target = spark.createDataFrame([(1, "x", "old", None), (2, "y", "old", dt.date(2020, 1, 1))], "id long, name string, note string, hired date")
    batch = spark.createDataFrame([(1, "a", None, 1), (1, "b", dt.date(2021, 1, 1), 2), (2, "c", None, 3), (3, "d", None, 4)], "id long, name string, hired date, n long")
    once = ingest.upsert_latest(target, batch, ["id"], "n", ["name", "hired"], ["hired"])
    twice = ingest.upsert_latest(once, batch, ["id"], "n", ["name", "hired"], ["hired"])
    want = {(1, "b", "old", dt.date(2021, 1, 1)), (2, "c", "old", dt.date(2020, 1, 1)), (3, "d", None, None)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want


def test_category_rules(spark):
    rows = [("[카드사명#1] 결제 계좌 변경",), ("도난/분실 신청/해제",), ("  가상 계좌 안내 ",), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "c string").select(T.normalize_category(F.col("c")).alias("c")).collect()]
    assert got == ["테디카드 결제계좌 변경", "분실/도난 신청/해제", "가상계좌 안내", ""]
    mapped = ingest.map_category(spark.createDataFrame([("한도 상향 신청",), ("모름",)], "category_raw string"), spark.createDataFrame([], "category_raw string, category_main string, category_sub string"))
    assert {(r.category_main, r.category_sub) for r in mapped.collect()} == {("한도", "신청/등록"), ("기타", "기타")}


def test_trigram_and_terms(spark):
    df = spark.createDataFrame([("word", "two words", "연회비는 얼마인가요 카드 12")], "a string, b string, q string")
    r = df.select(T.trigram_similarity(F.col("a"), F.col("b")).alias("s"), T.query_terms(F.col("q")).alias("t"), T.is_spam(F.lit("ㅋ" * 10)).alias("spam")).first()
    assert round(r.s, 4) == 0.3636 and r.t == ["연회비", "얼마인가"] and r.spam


def test_phonetics_and_ratios():
    assert matching.phonetic_similarity("카드", "카드") == 1.0 and matching.letters("각 A") == "ㄱㅏㄱa"
    assert matching.ratio("abcd", "bcde") == 0.75 and matching.cover_density(["a", "x", "b"], ["a", "b"]) > 0
    assert "".join(matching.split_text("abc " * 300, 100, 0)) == "abc " * 300


def test_turn_merge_overlaps():
    a = [("agent", f"turn number {i} of the call") for i in range(3)]
    b = [("customer", "I have a question about my card")]
    assert matching.append_turns(a + b, b + a, 8, 0.93) == a + b + a
    assert matching.tidy_turns([("agent", "ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ"), ("agent", "hello there"), ("agent", "hello there")]) == [("agent", "hello there")]


def test_near_duplicate_chain(spark):
    long = "this is a rather long sentence about the card number"
    rows = [(1, 1, "agent", long), (1, 2, "agent", long + "!"), (1, 3, "agent", long + "!!"), (1, 4, "customer", long)]
    got = transcripts.near_duplicate_turns(spark.createDataFrame(rows, "session_id long, seq long, speaker string, message string")).collect()
    assert sorted((r.seq, r.message) for r in got) == [(1, long + "!!"), (4, long)]


def test_vector_ties_and_bad_rows(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    got = vectors.nearest(docs, queries, 2).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in got] == [(1, 1, 1), (1, 2, 2)]


def test_finalize_titles_and_matches(spark):
    rows = [(1, 1, "T", 10, 0.9, True), (1, 2, "T", 20, 0.1, True), (1, 3, "", 5, 0.5, True), (1, 4, "U", 50, 2.0, False), (2, 5, "V", 1, 0.1, False)]
    got = retrieval.finalize(spark.createDataFrame(rows, "query_id long, id long, title string, content_length long, score double, matched boolean"), 5).collect()
    assert {(r.query_id, r.id, r.rank) for r in got} == {(1, 3, 1), (1, 2, 2), (2, 5, 1)}


def test_script_queries_compare_whole_messages(spark, tmp_path):
    from difflib import SequenceMatcher

    from callweave.plans import texts

    said = ["plain words " * 40 + "after the cut", "on the way " * 60, "short", "x" * 500]
    rows = [(1, i, "user" if i % 2 else "assistant", m) for i, m in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ratios, changes = {}, []
    for i, m in enumerate(said):
        after = m.replace(" the ", " a ")
        ratios[1000 + i] = round(SequenceMatcher(None, m, after, autojunk=False).ratio(), 6)
        changes += [(1000 + i, "replace", "the", "a")] * m.count(" the ")
    assert {r.id: r.ratio for r in texts.QUERIES["sequence_ratio"](spark, str(tmp_path)).collect()} == ratios
    assert sorted(map(tuple, texts.QUERIES["word_diff"](spark, str(tmp_path)).collect())) == changes


def test_matching_blocks_like_difflib():
    """The same blocks as difflib, and long texts with many changes in far less time than its pairs of places take."""
    rng = random.Random(9)
    for few in (0, 4_000):
        matching.FEW_PAIRS, before = few, matching.FEW_PAIRS
        for _ in range(300):
            signs = "abcd é가"[: rng.randint(1, 7)]
            a = "".join(rng.choice(signs) for _ in range(rng.randint(0, 90)))
            b = "".join(rng.choice(signs) if rng.random() < 0.1 else c for c in a if rng.random() > 0.05) if rng.random() < 0.7 else a[::-1]
            assert matching.matching_blocks(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        matching.FEW_PAIRS = before
    text = "".join(rng.choice("etaoin srhl") for _ in range(20_000))
    changed = "".join("X" if i % 500 == 499 else c for i, c in enumerate(text))
    began = time.process_time()
    assert matching.ratio(text, changed) == 1 - 40 / 20_000
    assert time.process_time() - began < 10


def test_shared_edge_like_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        middle = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        noisy = "".join(c if rng.random() > 0.05 else rng.choice("abcdx") for c in middle)
        tail, head = "".join(rng.choice("abcd") for _ in range(5)) + middle, noisy + "".join(rng.choice("abcd") for _ in range(5))
        want = next((n for n in range(min(len(tail), len(head)), 11, -1) if matching.ratio(tail[-n:], head[:n]) >= 0.92), 0)
        assert matching.shared_edge(tail, head) == want
    assert matching.shared_edge("", "abc") == 0


def test_turns_repeated_at_a_batch_boundary():
    said = [("agent", "May I have your card number, please?"), ("customer", "it is one two three four five")]
    merge = lambda new: matching.append_turns(said, new, 8, 0.93)
    # the same words with other marks; an ending; a repeat after a filler
    assert merge([("agent", "may i have your card number".replace("may i", "May I") + " please"), ("agent", "thanks")]) == said + [("agent", "thanks")]
    assert merge([("customer", "two three four five"), ("agent", "thanks")]) == said + [("agent", "thanks")]
    assert merge([("agent", "ok."), ("customer", "it is one two three four five."), ("agent", "thanks")]) == said + [("agent", "ok."), ("agent", "thanks")]
    # an overlap inside the next turn, by likeness, also behind a filler
    assert merge([("customer", "one two three four fife and six is the last")]) == said + [("customer", "and six is the last")]
    # the longest length that is alike counts, so a letter more can go (26 of 28 are the same)
    assert merge([("agent", "ok"), ("customer", "three four five and six is the last")]) == said + [("agent", "ok"), ("customer", "nd six is the last")]
    # another speaker's words, short overlaps and blank turns stay
    for new in ([("agent", "it is one two three four five")], [("customer", "four five and so on")], [("customer", "")]):
        assert merge(new) == said + new
    assert matching.append_turns([], said, 8, 0.93) == said and merge([]) == said


def test_session_state_goes_when_it_is_too_old(spark, tmp_path):
    """Turns of idle sessions leave no state; what is carried equals the batch form."""
    kind = "session_id long, id long, turn long, ts timestamp, value string"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    steps = [
        [(1, 1, 1, at(0), "a"), (1, 2, 2, at(60), None), (2, 3, 1, at(10), None), (3, 4, 1, at(20), "c")],
        [(1, 5, 3, at(180), None), (1, 6, 4, at(181), None), (3, 7, 2, at(30), None), (3, 8, 3, at(40), None), (3, 9, 4, at(50), None), (3, 10, 5, at(55), None)],
        [(4, 11, 1, at(90), "d")],
        [(5, 12, 1, at(90_000), None)],
        [(5, 13, 2, at(90_010), None)],
    ]
    kept = []
    for rows in steps:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        query = jobs.session_context_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert kept[:3] == [2, 0, 1] and kept[-1] == 0
    got = {r.id: r.carried for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: r.carried for r in jobs.session_context(spark.createDataFrame([r for s in steps for r in s], kind)).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "c", 5: "a", 6: None, 7: "c", 8: "c", 9: "c", 10: None, 11: "d", 12: None, 13: None}
