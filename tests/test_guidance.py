"""Guidance gates and live transcripts by hand-made cases."""

import datetime as dt
import random

import pytest

from callweave.operators import guidance, transcripts
from callweave.streaming import jobs, live

GUIDE = "query_id long, id long, query string, terms array<string>, intents array<string>, phone boolean, title string, tag_text string, content string, pin_rank long, score double"


def _guides(spark, query, docs, terms=(), intents=()):
    return spark.createDataFrame([(1, i, query, list(terms), list(intents), None, title, None, text, pin, score) for i, title, text, pin, score in docs], GUIDE)


def test_gates_narrow_and_fall_back(spark):
    docs = [(1, "카드 분실 신고", "분실 시 신고", None, 0.5), (2, "대출 안내", "이자", None, 0.9), (3, "분실 티머니", "티머니 분실", None, 0.7), (4, None, None, None, None)]
    got = {r.id: r for r in guidance.guidance_gates(_guides(spark, "카드 분실했어요", docs, ["카드"])).collect()}
    assert set(got) == {1} and got[1].hits == 3 and not got[1].entity  # 카드, 분실, 신고; the one with a brand goes
    brand = guidance.guidance_gates(_guides(spark, "티머니 분실", docs)).collect()
    assert [(r.id, r.entity) for r in brand] == [(3, True)]
    none = guidance.guidance_gates(_guides(spark, None, docs)).collect()
    assert {r.id for r in none} == {1, 2, 4}  # no tags, no words: only the gate against brands counts


def test_weak_guides_go_unless_all_would(spark):
    docs = [(1, "분실 신고", "x", None, 0.0), (2, "분실", "x", 1, 0.0), (3, "도난 분실", "x", None, -0.5)]
    assert [(r.id, r.place) for r in guidance.guidance_documents(_guides(spark, "분실", docs)).orderBy("place").collect()] == [(2, 1), (1, 2)]
    docs[0] = (1, "분실 신고", "x", None, 0.3)
    assert [r.id for r in guidance.guidance_documents(_guides(spark, "분실", docs)).collect()] == [1]
    assert guidance.guidance_documents(_guides(spark, "분실", docs).limit(0)).count() == 0


def _at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)


def test_fragments_across_micro_batches(spark, tmp_path):
    kind = "session_id long, seq long, pos long, ts timestamp, message string, last boolean"
    said = [(1, 0, "a"), (1, 1, " "), (1, 2, "b"), (2, 0, "x"), (2, 1, None), (1, 3, "c"), (1, 4, "d")]
    rows = [(s, q, 0, _at(i), m, (s, q) in {(1, 4), (2, 1)}) for i, (s, q, m) in enumerate(said)]
    for i in (0, 4):
        spark.createDataFrame(rows[i : i + 4], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.fragment_batches(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 0, 3, None, "a b c"), (1, 1, 1, "agent", "d"), (2, 0, 1, "agent", "x")}


@pytest.mark.parametrize("turns", [1, 7, 30])
def test_merged_stream_equals_batch(spark, tmp_path, turns):
    line = lambda i: f"turn {i} says {'abcdefghij'[i % 10] * 3} {i * 7919} about the card"
    rows = []
    for session in (1, 2):
        for batch, start in enumerate(range(0, turns, 4)):
            for i in range(max(0, start - 2), min(turns, start + 4)):
                rows.append((session, batch, len(rows), _at(len(rows)), "agent" if i // session % 2 else "customer", line(i), False))
    last = {s: max(r[2] for r in rows if r[0] == s) for s in (1, 2)}
    rows = [(*r[:6], r[2] == last[r[0]]) for r in rows]
    df = spark.createDataFrame(rows, "session_id long, batch long, seq long, ts timestamp, speaker string, message string, last boolean")
    want = {tuple(r) for r in transcripts.merge_batches(df.drop("ts", "last")).collect()}
    got = jobs.drained(spark, df, live.transcript_merge, "merge", str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want


def test_gates_and_documents_by_kinds(spark):
    """Copies of questions and guides are gated once by their kind, with what gating every pair gives."""
    kinds = [("분실 신고 방법", "분실", "신고", "카드", 0.5), ("대출 안내", "대출", "금리", "본문", -1.0), ("", None, None, "분실", 0.0), ("티머니 분실", "분실", None, "티머니", 0.2)]
    told = [(10 * c + i, c % 2, *g[:1], g[1], g[3], 1 if (c, i) == (3, 1) else None, g[4]) for c in range(6) for i, g in enumerate(kinds)]
    guides = spark.createDataFrame(told, "id long, part long, title string, tag_text string, content string, pin_rank long, score double")
    asked = [(n, n % 2, q, ["카드"], None, False) for n, q in enumerate(["분실했어요", "분실했어요", "분실했어요", "대출", None, "티머니"])]
    queries = spark.createDataFrame(asked, "query_id long, part long, query string, terms array<string>, intents array<string>, phone boolean")
    pairs = guides.join(queries, "part")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(guidance.guidance_gates_on(queries, guides, ["part"])) == rows(guidance.guidance_gates(pairs)) != []
    assert rows(guidance.guidance_documents_on(queries, guides, ["part"], 3)) == rows(guidance.guidance_documents(pairs, 3)) != []
    assert guidance._kind_pairs(queries, guides, ["part"])[0].count() < pairs.count() / 3


def _unlike(spark, rng):
    """Questions and guides of which hardly two are alike, with nulls."""
    words = ["분실", "대출", "결제", "티머니", "신청", "카드", "번호", "dcc", "x"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randrange(1, n)))
    maybe = lambda x: x if rng.random() > 0.15 else None
    told = [(maybe(i), maybe(i % 3), maybe(f"{some(4)} {i}"), maybe(some(3)), maybe(some(5)), i % 4 if i % 9 == 0 else None, maybe((i * 7 % 11 - 3) / 4)) for i in range(300)]
    asked = [(n, maybe(n % 3), maybe(f"{some(3)} q{n}"), maybe([maybe(w) for w in rng.sample(words, 2)]), maybe([["loss", " "], [" Loan", None], []][n % 3]), maybe(n % 5 == 0)) for n in range(24)]
    guides = spark.createDataFrame(told, "id long, part long, title string, tag_text string, content string, pin_rank long, score double")
    return spark.createDataFrame(asked, "query_id long, part long, query string, terms array<string>, intents array<string>, phone boolean"), guides.filter("id IS NOT NULL")


@pytest.mark.parametrize("most", [20_000, 3])
def test_gates_move_no_pairs(spark, monkeypatch, most):
    """Guides are gated where they are, with what gating every pair gives: several ranges and parts of questions."""
    monkeypatch.setattr("callweave.operators.pairing.MOST_QUESTIONS", most)
    queries, guides = _unlike(spark, random.Random(most))
    got = guidance.guidance_gates_on(queries, guides, ["part"])
    rows = lambda df: sorted(map(str, df.select("query_id", "id", "pin_rank", "hits", "score", "entity").collect()))
    assert rows(got) == rows(guidance.guidance_gates(guides.join(queries, "part"))) != []
    above = got._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
    assert above[1] and not any(x in above[0] for x in ("Exchange", "Join", "Window"))


def test_documents_move_the_best_alone(spark, monkeypatch):
    """Of each range a question's k best are moved, not all guides that pass."""
    monkeypatch.setattr("callweave.operators.pairing.TASKS_PER_CORE", 1)
    queries, guides = _unlike(spark, random.Random(7))
    most = lambda rows: rows.groupBy("query_id").count().agg({"count": "max"}).first()[0]
    moved, whole = [], guidance.guidance_topk
    pairs = guides.join(queries, "part")
    want = sorted(map(tuple, guidance.guidance_documents(pairs, 2).collect()))
    ranges = spark.sparkContext.defaultParallelism
    assert most(guidance.guidance_gates(pairs)) > 2 * ranges
    monkeypatch.setattr(guidance, "guidance_topk", lambda rows, k: moved.append(most(rows)) or whole(rows, k))
    got = sorted(map(tuple, guidance.guidance_documents_on(queries, guides, ["part"], 2).collect()))
    assert got == want != [] and len(moved) == 1 and moved[0] <= 2 * ranges
