"""Filters, staged lookup, snippets and error spans on small hand-made inputs."""

from pyspark.sql import functions as F

from callweave.functions import matching
from callweave.functions import routing as R
from callweave.operators import filters

COLUMNS = "id string, title string, content string, category string, category1 string, category2 string, card_name string"


def guides(spark):
    rows = [("A1", "Call us", "고객센터 안내", "x", "p", "q", None), ("A2", None, "50% off", "y", "p", "r", ""), ("B1", "other", None, "z", None, None, "My Card")]
    return spark.createDataFrame(rows, COLUMNS)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_guide_filter(spark):
    g = guides(spark)
    assert ids(g.filter(filters.guide_filter())) == ["A1", "A2", "B1"]
    assert ids(g.filter(filters.guide_filter(id_prefix="A", category1=["p"]))) == ["A1", "A2"]
    assert ids(g.filter(filters.guide_filter(phone=True))) == ["A1"]
    assert ids(g.filter(filters.guide_filter(exclude_terms=["other"]))) == ["A1"]  # null title or content: not known
    assert ids(g.filter(filters.guide_filter(terms=["0%"], not_card_specific=True))) == ["A2"]
    assert ids(g.filter(filters.guide_filter(exclude_patterns=["b_", "%안내"]))) == []
    assert ids(guides(spark).limit(0).filter(filters.guide_filter(phone=True))) == []


def test_card_filter(spark):
    g = guides(spark)
    assert ids(g.filter(filters.card_filter(names=["mycard"]))) == ["B1"]
    assert ids(g.filter(filters.card_filter(payments=["off"]))) == ["A1", "A2", "B1"]  # a payment alone filters nothing
    assert ids(g.filter(filters.card_filter(payments=["off"], intents=["use"]))) == ["A2"]


def test_card_candidates(spark):
    rows = [(i, f"Card {i % 3}", None if i == 4 else f"Plus {i}", "t", "alpha" if i % 2 else None) for i in range(60)]
    cards = spark.createDataFrame(rows, "id long, name string, card_name string, title string, content string")
    took = lambda *a, **k: [(r["id"], r["stage"]) for r in filters.card_candidates(cards, *a, **k).orderBy("id").collect()]
    assert took(["card1"], []) == [(i, 1) for i in (1, 4, 7, 10, 13)]
    assert took(["card1"], ["ALPHA"]) == [(i, 1) for i in (1, 7, 13, 19, 25)]
    assert took(["lus 5"], ["none"]) == [(5, 2), *((i, 2) for i in range(50, 54))]
    assert took(["gone"], ["alpha"], limit=2) == [(1, 3), (3, 3)]
    assert took(["gone"], ["alpha"], require_name=True) == [] == took([], [])
    assert filters.card_candidates(cards.limit(0), ["card1"]).count() == 0


def test_relevant_snippets(spark):
    text = "one\n\ntwo fee\n\n문의: 02-123-4567\nthree\n\nfour\n\nfive\n# 기타 안내\nfee fee"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "fee" * 100), (4, "nothing here")], "id long, content string")
    got = {r["id"]: r["snippet"] for r in filters.relevant_snippets(docs, F.array(F.lit("FEE"))).collect()}
    assert got == {1: "one\ntwo fee\nthree", 2: "", 3: ("fee" * 100)[:280] + "...", 4: "nothing here"}
    small = {r["id"]: r["snippet"] for r in filters.relevant_snippets(docs, F.array(F.lit("fee")), limit=12).collect()}
    assert small[1] == "one\ntwo fee"
    none = {r["id"]: r["snippet"] for r in filters.relevant_snippets(docs, F.array().cast("array<string>"), limit=3).collect()}
    assert none == {1: "one...", 2: "", 3: "fee...", 4: "not..."}


def test_error_spans():
    truth = [("a", "x" * 5 + "abcdefghij"), ("b", "klmnopqrstuvwxyz")]
    guess = [("a", "xxxxx"), ("b", "abcdefghijklmn"), ("a", "opqrstuvwxyz")]
    assert matching.error_spans(truth, guess, least=10) == [(12, 19, 19, "b", "a"), (10, 5, 5, "a", "b")]
    assert matching.error_spans(truth, guess, least=11) == [(12, 19, 19, "b", "a")]
    assert matching.error_spans([], guess) == [] == matching.error_spans(truth, truth)


def test_settled_route_filters(spark):
    usage = ["guide_merged"]
    rows = [
        # names that can't be card names go
        ("x", "card_usage", {"card_name": ["혜택 좋은 카드", "테디카드", "a" * 18]}, usage, {"card_name": ["테디카드"]}),
        # a loss intent keeps loss intents; without one they go; a question for information loses all intents
        ("지갑 분실 신고", "card_usage", {"intent": ["분실도난"]}, usage, {"intent": ["분실도난"]}),
        ("카드 정지", "card_usage", {"intent": ["분실도난", "해지"], "weak_intent": ["도난"]}, usage, {"intent": ["해지"]}),
        ("연회비 얼마", "card_usage", {"intent": ["해지"], "weak_intent": ["한도"], "payment_method": ["티머니"]}, usage, {"payment_method": ["티머니"]}),
        # one programme
        ("k패스 경기도 청년 다자녀", "card_usage", {}, usage, {"card_name": ["K-패스"], "region": ["경기"], "benefit_type": ["다자녀", "청년"]}),
        ("k패스", "card_usage", {"card_name": ["테디카드"], "region": ["서울"]}, usage, {"card_name": ["테디카드"], "region": ["서울"]}),
        # telephone and forced routes, and a null text
        ("k패스 전화번호", "phone_lookup", {"intent": ["phone_lookup"]}, usage, {"intent": ["phone_lookup"]}),
        ("k패스", "card_usage", {}, [], {}),
        (None, "card_usage", {"intent": ["분실"], "card_name": ["테디카드"]}, usage, {"card_name": ["테디카드"]}),
    ]
    df = spark.createDataFrame(rows, "t string, route string, filters map<string,array<string>>, sources array<string>, want map<string,array<string>>")
    got = df.select("want", R.settled_filters(F.struct("route", "filters", "sources"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
