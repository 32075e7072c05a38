"""Readers, conforming jobs and signal functions on small hand-made inputs."""

import json

from pyspark.sql import functions as F

from callweave.functions import signals as S
from callweave.operators import conform, retrieval
from callweave.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "가"}, {"id": 2}], indent=1))
    (tmp_path / "b.json").write_text("[]")
    rows = readers.read_json_array(spark, str(tmp_path), "id long, name string").collect()
    assert sorted(map(tuple, rows)) == [(1, "가"), (2, None)]


def test_eval_csv_skips_bad_lines_and_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,model,res\n1,m,N1\n2,m\nx,m,N2\n3,\"a,b\",S1\n".encode())
    rows = readers.read_eval_csv(spark, str(tmp_path), "id long, model string, res string")
    assert sorted(r["id"] for r in rows.select("id").collect()) == [1, 3]


def test_chat_examples(spark):
    said = json.dumps([{"speaker": "agent", "message": "hi"}])
    rows = spark.createDataFrame([(1, [("user", "Raw Stream:\nhello"), ("assistant", said)]), (2, [("user", "plain"), ("assistant", "no json")]), (3, None)], "id long, messages array<struct<role string, content string>>")
    got = {r["id"]: (r["system"], r["user"], r["utterances"]) for r in readers.chat_examples(rows).collect()}
    assert got[1] == (None, "hello", [("agent", "hi")])
    assert got[2][1] == "plain" and not got[2][2]
    assert got[3] == (None, None, None)


def test_case_blocks(spark):
    rows = spark.createDataFrame([("x[case 1][script] a \n[stt]\n b [case 2] none [case 7][script]c[stt]d",), (None,), ("",)], "value string")
    assert sorted(map(tuple, readers.case_blocks(rows).collect())) == [(1, "a", "b"), (3, "c", "d")]


def test_read_where(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, c string")
    assert [r["id"] for r in readers.read_where(rows, {"c": "a", "id": 3}).collect()] == [3]
    assert readers.read_where(rows, {"c": None}).count() == 0
    assert readers.read_where(rows, {}, 2).count() == 2


def test_remap_keeps_unmatched_ids(spark):
    docs = spark.createDataFrame([(1, "CS-HANA-7"), (2, "CS-HANA-8"), (3, None), (4, "other")], "id long, consultation_id string")
    ids = spark.createDataFrame([("hana_consultation_7", "new")], "old_id string, new_id string")
    assert dict(map(tuple, conform.remap_document_ids(docs, ids).collect())) == {1: "new", 2: "hana_consultation_8", 3: "3", 4: "other"}


def test_pools_run_out(spark):
    calls = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("기타",)], "category string")
    agents = spark.createDataFrame([(i, i) for i in range(1, 4)], "id long, created_order long")
    got = sorted(map(tuple, conform.agent_pools(calls, agents, {"a": 2}, 2).collect()))
    assert got == [("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("기타", 0, 1), ("기타", 1, 2), ("기타", 2, 3)]


def test_compound_patterns_take_ascii_words(spark):
    rules = [("end", S.ascii_edges(r"tion\b")), ("inside", S.ascii_edges(r"tion\B")), ("slash", S.ascii_edges(r"\\b[b]"))]
    found = lambda t: value(spark, S.compound_patterns(F.lit(t), rules))
    assert found("action") == ["end"] and found("actioné") == ["end"] and found("action가") == ["end"]
    assert found("actions") == ["inside"] and found("action_") == ["inside"] and found(r"\bb") == ["slash"]


def test_card_token_match(spark):
    match = lambda tokens, names: value(spark, S.card_token_match(F.array(*map(F.lit, tokens)), names))
    assert match(["kb"], ["KB card", "other"]) == ["KB card"]  # 2 letters and 2 for ASCII
    assert match(["나라"], ["나라 사랑"]) == []  # below 3
    assert match(["card"], ["card long", "card b", "card", "a card c"]) == ["card", "card b", "a card c"]
    assert match(["x"], ["card"]) == []


def test_sections_and_grounding(spark):
    text = "intro\n# Fees\na\n## More fees\nb\n### Fees again\nc"
    assert value(spark, S.matching_sections(F.lit(text), F.array(F.lit("fees")))) == "# Fees\na\n\n## More fees\nb"
    assert value(spark, S.matching_sections(F.lit(text), F.array(F.lit("none")))) == text
    assert value(spark, S.strict_grounding(F.lit("One  two. Three!"), F.lit("x one two three"))) == "One  two. Three!"
    assert value(spark, S.strict_grounding(F.lit("one four."), F.lit("one two"))) == ""
    assert value(spark, S.strict_grounding(F.lit("one."), F.lit(" "))) == ""


def test_weak_actions_and_card(spark):
    keep = lambda text, weak: value(spark, S.filter_weak_actions(F.array(F.lit("a"), F.lit("b")), weak, F.lit(text), {"a": ["lost card"], "b": ["ask"]}, {"ask"}))
    some, none = F.array(F.lit("w")), F.array().cast("array<string>")
    assert keep("my lostcard ask", some) == ["a"]
    assert keep("ask", none) == ["a", "b"]
    assert json.loads(value(spark, S.base_card(F.lit(1), F.lit(" "), F.lit("x" * 200)))) == {"id": 1, "content": "x" * 140}


def test_card_info_stop(spark):
    rows = [(1, 1, 0.5, "A"), (2, 1, 0.5, "A"), (2, 2, 0.45, "B"), (3, 1, 0.1, "A b"), (3, 2, 0.1, "ab"), (3, 3, 0.1, "AB"), (4, 1, None, "A")]
    got = {r[0]: (r[1], r[2]) for r in retrieval.card_info_stop(spark.createDataFrame(rows, "query_id long, rank int, score double, card string")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, True), 4: (False, True)}


def test_card_token_match_reads_tokens_once(spark):
    """The tokens stand once in the plan, however many names there are."""
    rows = spark.createDataFrame([("the river, que?",)], "content string")
    tokens = F.filter(F.split("content", "[^a-z]+"), lambda t: F.length(t) >= 3)
    found = rows.select(S.card_token_match(tokens, ["the river", "lo que", "des"]).alias("x"))
    assert found.first()["x"] == ["the river"] and found._jdf.queryExecution().analyzed().toString().count("split(") == 1
