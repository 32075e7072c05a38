"""Hand-made cases of grounding sentences, keywords, targets, splits, lanes and retries."""

from pyspark.sql import functions as F

from callweave.functions import routing as R
from callweave.functions import text as T
from callweave.operators import calls, grounding, retrieval, transcripts

GUIDES = "query_id long, rank long, title string, content string, keywords array<string>, phone boolean"


def _sentence(spark, *docs, keywords=("분실", "신고"), phone=False):
    rows = [(1, i, title, content, list(keywords), phone) for i, (title, content) in enumerate(docs, 1)]
    return grounding.grounding_sentence(spark.createDataFrame(rows, GUIDES)).collect()[0].sentence


def test_a_later_guide_with_two_points_wins(spark):
    first = "분실 신고는 앱에서 접수됩니다. 분실 신고 이후 재발급이 진행됩니다."
    assert _sentence(spark, ("가", first), ("나", "카드를 받은 뒤 등록합니다.")) == "분실 신고는 앱에서 접수됩니다."
    assert _sentence(spark, ("가", first), ("나", "1) 분실 신고 접수는 24시간 열려 있습니다.")) == "분실 신고 접수는 24시간 열려 있습니다."


def test_weak_sentences_titles_and_the_default(spark):
    assert _sentence(spark, ("가", "카드 등록을 먼저 진행합니다. 분실 카드는 바로 정지합니다.")) == "분실 카드는 바로 정지합니다."
    assert _sentence(spark, ("가", "카드번호를 알려 주시면 확인됩니다."), ("분실 안내", None)) == "관련 안내는 '가' 기준으로 진행하시면 됩니다."
    assert _sentence(spark, (" ", None), (None, "짧다.")) == "문서 안내 기준에 따라 순서대로 진행하시면 됩니다."
    far = "가" * 430 + ". 분실 신고는 앱에서 접수됩니다."  # beyond what is read of a guide
    assert "분실" not in _sentence(spark, ("제목", far))
    assert grounding.grounding_sentence(spark.createDataFrame([], GUIDES)).count() == 0


def test_numbers_stay_only_where_they_may_be_said(spark):
    text = "분실 신고는 1588-1234 또는 02-123-4567 번으로 www.card.com 에서 합니다."
    assert _sentence(spark, ("가", "분실 신고는 02-123-4567 에서 접수됩니다.")) == "분실 신고는 에서 접수됩니다."
    assert "02-123-4567" in _sentence(spark, ("가", text), phone=True)
    assert "www" not in _sentence(spark, ("가", text), phone=True)


def test_keywords(spark):
    rows = spark.createDataFrame([(1, "테디 카트 분실 신고 어떻게 혜택 혜택"), (2, "apple pay 한도 올려"), (3, None), (4, "  ")], "id long, t string")
    got = {r.id: r.k for r in rows.select("id", R.extract_keywords(F.col("t"), {"카트": "카드"}, {"테디카드": ["테디 카드"]}).alias("k")).collect()}
    assert got[1].cards == ["테디카드"] and got[1].actions == ["분실", "신고", "분실신고"] and got[1].intents == ["혜택"]
    assert got[1].query == "테디카드 분실 신고 분실신고 혜택"
    assert got[2].payments == ["애플페이"] and got[2].actions == ["한도", "한도상향"]
    assert got[3].query == got[4].query == "" and got[3].cards == []


def test_targets_add_up(spark):
    ranked = spark.createDataFrame([(i, i) for i in range(1, 61)] + [(99, None)], "agent_id long, rank int")
    for total in (0, 5000, 9000):
        sums = calls.agent_targets(ranked, spark.createDataFrame([(total,)], "calls long")).agg(F.sum("target")).collect()[0][0]
        assert sums == total
    plain = {r.agent_id: r.target for r in calls.agent_targets(ranked).collect()}
    assert [plain[i] for i in (1, 5, 6, 15, 60, 99)] == [132, 124, 122, 108, 75, 88]


def test_split_is_exact(spark):
    rows = spark.range(1003).withColumnRenamed("id", "key")
    for n, size, test in ((None, 1003, 101), (500, 500, 50), (5000, 1003, 101), (1, 1, 1)):
        got = transcripts.train_test_split(rows, "key", n).collect()
        assert (len(got), sum(r.is_test for r in got)) == (size, test)
    assert transcripts.train_test_split(rows.limit(0), "key").count() == 0
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "key long")
    assert transcripts.train_test_split(nulls, "key").count() == 3


def test_lanes(spark):
    def run(route, mixed, k=3):
        rows = [(1, i, lane, score, route, mixed) for i, (lane, score) in enumerate([("card", 0.9), ("card", 0.8), ("card", 0.7), ("guide", 0.1), ("guide", 0.95)])]
        df = spark.createDataFrame(rows, "query_id long, id long, lane string, score double, route string, mixed boolean")
        return [r.id for r in retrieval.lanes_by_route(df, k).orderBy("rank").collect()]

    assert run("card_info", False) == [0, 1, 2] and run("card_usage", False) == [4, 3]
    assert run("card_info", True) == [4, 0, 1] and run("card_usage", True, 4) == [4, 0, 1, 2]
    assert run("card_info", True, 1) == [0] and run(None, None) == [4, 3]


def test_similarity_and_accuracy(spark):
    rows = spark.createDataFrame([("abcd", "abcx", "abcd"), ("ab", "ab", "ax"), (None, "a", "a")], "t string, b string, a string")
    got = transcripts.correction_similarity(rows, "b", "a", "t").collect()[0]
    assert (got.utterances, got.before, got.after, got.gain) == (3, round((0.75 + 1 + 0) / 3, 6), round((1 + 0.5 + 0) / 3, 6), round((1.5 - 1.75) / 3, 6))
    said = spark.createDataFrame([(1, "truth", 0, "agent", "ab cd"), (1, "truth", 1, "customer", "efgh"), (1, "predicted", 0, "agent", "abcdef")], "session_id long, kind string, seq long, speaker string, message string")
    got = transcripts.speaker_accuracy(said).collect()[0]
    assert (got.aligned, got.truth_characters, got.accuracy, got.coverage) == (6, 8, round(4 / 6, 6), 0.75)
    none = transcripts.speaker_accuracy(said.limit(0)).collect()[0]
    assert (none.aligned, none.accuracy, none.coverage) == (0, 0.0, 0.0)


def test_work_and_transition_scores(spark):
    rows = spark.createDataFrame([(90, 20), (91, 15), (119, 15), (120, 10), (149, 10), (150, 5), (199, 5), (200, 0)], "s long, want long")
    assert all(r.got == r.want for r in rows.select("want", T.work_score(F.col("s")).alias("got")).collect())
    got = rows.limit(1).select(T.transition_score(F.lit("부정"), F.lit("긍정"), F.lit("중립")).alias("x")).collect()[0].x
    assert got == 15
