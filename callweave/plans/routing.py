"""Queries of routing, checks and parsing, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from callweave.functions import matching
from callweave.functions import routing as R
from callweave.functions import text as T
from callweave.operators import calls, checks, ingest, lexicon, retrieval, textsearch, transcripts
from callweave.plans.search import covers_sql
from callweave.plans.texts import _F, _U
from callweave.sources import bindings as b

# The tables' texts are invented prose, so the dictionaries are pieces of it.
CARDS = {"Gold": ["ing th"], "Blue Sky": ["ere a"]}
ACTIONS = {"open": ["tion o"], "loss": ["heit"]}
PAYMENTS = {"pay": ["ed a"]}
WEAK = {"limit": ["und s"], "fee": ["que s"]}
INFO, USAGE, ISSUANCE = ["der d"], ["hen"], ["est a"]
WORDS = R.RouteTerms(
    benefit=["les d"], reissue=["con e"], sources=["ment"], loss=["loss"], error=["error"], registration=["open"], trigger_actions=["loss"], force=[(["los a"], ["on"]), (["ara a"], ["os"])], phone=["osa"],
    reissue_name="reissue", issue_name="issue", issue_template="card issue terms", card_word="card", info_word="info", how_word="how", use_word="use",
)
SYNONYMS = {"small": ["tiny", "very small"], "widget": ["gadget"], "large": ["big one"]}
GUIDE_CASES = [["분실", "안내"], ["분실/도난"], ["안내"], ["해지 방법", "한도"]]
PAY_TEXTS = ["애플페이 카드 등록", "apple pay 결제 안돼", "지갑 분실", "테스트", "applepay 티머니 충전", "애플페이 뭐"]
ASKED = ["the and", "der und", "les dans les", "que", "nowhere the"]
DATES = ["yyyy-MM-dd", "yyyy.MM.dd", "'bad' dd"]


def _signals(s, d):
    rows = b.fragments(s, d)
    return rows.select("session_id", "seq", "pos", R.signals(F.col("message"), CARDS, ACTIONS, PAYMENTS, WEAK, {"shout": "!!"}, INFO, USAGE, ISSUANCE).alias("s"))


def _chained_signals(s, d):
    terms = lexicon.dictionaries(s, {"card": CARDS, "action": ACTIONS, "payment": PAYMENTS, "weak": WEAK})
    found = lexicon.signals(b.fragments(s, d), "message", terms, {"shout": "!!"}, INFO, USAGE, ISSUANCE)
    return found.select("session_id", "seq", "pos", "cards", "actions", "payments", "weak", "patterns", "info", "usage", "issuance")


def _products(s, d):
    """Part names against the names, types and brands of every two-hundredth part."""
    part = _part(s, d)
    products = part.filter("p_partkey % 200 = 0").select(F.col("p_name").alias("product"), F.array("p_type", "p_brand").alias("others"), F.col("p_partkey").alias("place"))
    return lexicon.product_candidates(part.select(F.col("p_partkey").alias("id"), "p_name"), "p_name", products)


def _lexicon(s, d):
    """A dictionary table of the benchmark's word pairs, looked up in all documents."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    terms = b.table(s, d, "benchmark").select(words.alias("w")).filter(F.size("w") > 1).select(F.explode(pairs).alias("term")).distinct()
    terms = terms.select(F.lit("pairs").alias("dictionary"), F.upper("term").alias("canonical"), "term", F.lit(True).alias("own"), F.xxhash64("term").alias("place"))
    docs = b.table(s, d, "documents").select("doc_id", T.normalize_query(F.coalesce("text", F.lit(""))).alias("text"))
    return lexicon.dictionary_terms(docs, "text", terms, "pairs").select("doc_id", "found")


def _route(s, d):
    pay = F.when(F.contains(F.col("s.normalized"), F.lit("ñ")), "applepay_general")
    rows = _signals(s, d).select("session_id", "seq", "pos", R.route_decision(F.col("s"), pay, WORDS, {"limit": R.INFO, "fee": R.USAGE}).alias("r"))
    filters = F.array_sort(F.transform(F.map_entries("r.filters"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))))
    return rows.select("session_id", "seq", "pos", "r.route", "r.db_route", filters.alias("filters"), "r.template", "r.trigger", "r.search", "r.sources", "r.exclude", "r.policy")


#: Terms that the invented prose holds, in the places of the defaults.
SETTLED = R.FilterTerms(loss_strong=["loss", "ara"], loss_action=["ta"], loss_names=["los", "limit"], info=["en "], no_name=["pre"], name_below=12, programme=["na"], programme_name="pass", benefits={"young": ["or"], "family": ["ma", "mi"]}, regions={"north": ["ka"], "south": ["la", "so"]})


def _settled(s, d):
    pay = F.when(F.contains(F.col("s.normalized"), F.lit("ñ")), "applepay_general")
    rows = _signals(s, d).select("session_id", "seq", "pos", F.col("s.normalized").alias("t"), R.route_decision(F.col("s"), pay, WORDS, {"limit": R.INFO, "fee": R.USAGE}).alias("r"))
    settled = R.settled_filters(F.col("r"), F.col("t"), SETTLED)
    return rows.select("session_id", "seq", "pos", F.array_sort(F.transform(F.map_entries(settled), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))).alias("filters"))


def _flags(s, d):
    rows = _signals(s, d).select("session_id", "seq", "pos", "s.*")
    db = F.when(F.col("pos") % 3 == 0, "both").otherwise("card_tbl")
    return rows.select("session_id", "seq", "pos", R.info_guidance(F.col("normalized"), F.col("actions"), ["ll", "oss"]).alias("guidance"), R.expand_card_info(F.col("normalized"), F.col("cards"), db, ["thea"]).alias("expand"))


def _part(s, d):
    return b.table(s, d, "part")


def _consult(s, d):
    """Every second query's category has no cases, every fifth has no vector; queries ask for two or three frequent words."""
    docs = b.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cases = b.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category")).join(docs, "id", "left")
    q = F.col("id")
    asked = F.get(F.array(*map(F.lit, ASKED)), (q / 50 % len(ASKED)).cast("int"))
    queries = cases.filter("id % 50 = 0").select(q.alias("query_id"), F.when(q % 250 > 0, F.col("embedding")).alias("embedding"), F.when(q % 100 == 0, "none").otherwise(F.col("category")).alias("category"), asked.alias("text"))
    found = textsearch.case_search(cases, queries, 5)
    return found.select("query_id", "id", "stage", "rank", F.round("vector_score", 5).alias("vector_score"), F.round("text_score", 5).alias("text_score"), F.round("score", 5).alias("score"))


def _rerank(s, d):
    p = _part(s, d)
    q = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), "p_size", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("terms"))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rank"), "p_size", F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.col("p_brand").alias("category"))
    return retrieval.rerank_pairs(q, rows, ["p_size"], "title", "content", "category")


def _outputs(s, d):
    """Model answers about utterances: plain, fenced, surrounded, cut off, broken."""
    item = F.to_json(F.struct("speaker", "message"))
    forms = [F.concat(F.lit("["), item, F.lit("]")), F.concat(F.lit('```json\n{"items": ['), item, F.lit("]}\n```")), F.concat(F.lit("Result: ["), item, F.lit("] done")), F.concat(F.lit('{"items": ['), item, F.lit(', {"speaker": "ag')), F.lit("no list here")]
    out = F.coalesce(*[F.when(F.col("seq") % 5 == i, f) for i, f in enumerate(forms)])
    rows = checks.parse_model_output(b.utterances(s, d).withColumn("answer", out).select("session_id", "seq", "answer"), "answer")
    return rows.select("session_id", "seq", "failed", F.col("items")[0]["speaker"].alias("speaker"), F.col("items")[0]["message"].alias("message"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n"))


def _phonetic(s, d):
    def run(frames):
        for f in frames:
            yield f.assign(similarity=[round(matching.phonetic_similarity(x, y), 6) for x, y in zip(f["p_name"], f["p_type"])])

    pairs = _part(s, d).select("p_name", "p_type").distinct()
    return pairs.mapInPandas(run, "p_name string, p_type string, similarity double")


def _picked(options: list, at):
    return F.coalesce(*[F.when(at == i, F.array(*map(F.lit, o)) if isinstance(o, list) else F.lit(o)) for i, o in enumerate(options)])


QUERIES = {
    "extract_signals": _chained_signals,
    "dictionary_terms": _lexicon,
    "product_candidates": _products,
    "contained_signals": lambda s, d: _signals(s, d).select("session_id", "seq", "pos", *[f"s.{c}" for c in ("cards", "actions", "payments", "weak", "patterns", "info", "usage", "issuance")]),
    "route_decision": _route,
    "route_filters": _settled,
    "fallback_contains": lambda s, d: b.table(s, d, "documents").select("doc_id", R.fallback_contains(F.lower("text"), {**CARDS, **ACTIONS, **WEAK}).alias("found")),
    "expand_terms": lambda s, d: _part(s, d).select("p_partkey", R.expand_terms(F.split("p_name", " "), SYNONYMS, True).alias("terms")),
    "guide_terms": lambda s, d: _part(s, d).select("p_partkey", R.guide_terms(_picked(GUIDE_CASES, F.col("p_partkey") % 4), ["안내"]).alias("terms")),
    "guidance_flags": _flags,
    "card_keywords": lambda s, d: _part(s, d).select("p_partkey", R.card_keywords(F.split("p_name", " ")).alias("keywords")),
    "guidance_slots": lambda s, d: _part(s, d).select("p_partkey", R.guidance_slots(F.concat(F.split("p_name", " "), F.array("p_brand", "p_brand")), F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(R.no_terms()), F.array("p_type", "p_brand", "p_type")).alias("g")).select("p_partkey", "g.*"),
    "chat_template_rows": lambda s, d: b.table(s, d, "benchmark").select("item_id", R.chat_template(F.col("text"), F.concat(F.lit("answer "), F.col("item_id")), "You help").alias("messages")),
    "tag_overlap": lambda s, d: _part(s, d).select("p_partkey", F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("small"), F.lit("bolt"))).alias("overlap")),
    "unused_agents": lambda s, d: checks.unused_agents(b.employees(s, d).select("id"), b.table(s, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("id"))),
    "missing_expected": lambda s, d: checks.missing_expected(b.customers(s, d), b.table(s, d, "orders").select(F.col("o_custkey").alias("id")), "id"),
    "expiring_cards": lambda s, d: checks.expiring_cards(b.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("expiry")), dt.date(1997, 3, 1)),
    "synonym_bags": lambda s, d: checks.synonym_bags(_part(s, d).select(F.col("p_name").alias("keyword"), F.col("p_type").alias("category"), F.array("p_brand").alias("synonyms"))),
    "consult_case_search": _consult,
    "card_info_rerank": _rerank,
    "parse_model_output": _outputs,
    "phonetic_similarity": _phonetic,
    "conform_status": lambda s, d: b.table(s, d, "orders").select("o_orderkey", T.conform_status(_picked(["진행중", "INCOMPLETE", "x", "in_progress"], F.col("o_orderkey") % 4)).alias("status")),
    "conform_dates": lambda s, d: b.table(s, d, "orders").select("o_orderkey", T.conform_date(F.coalesce(*[F.when(F.col("o_orderkey") % 3 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(DATES)])).alias("day")),
    "duration_format": lambda s, d: b.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.floor("value").cast("long")).alias("n")).select("event_id", calls.duration_text(F.col("n")).alias("text"), calls.duration_seconds(calls.duration_text(F.col("n"))).alias("seconds")),
    "conform_documents": lambda s, d: ingest.conform_documents(b.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("제"), F.col("doc_id"), F.lit("조 "), F.col("source")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("own").alias("content"), "text", F.concat_ws(" , ", "lang", "source").alias("keywords"))),
    "applepay_intent": lambda s, d: _part(s, d).select("p_partkey", T.applepay_intent(_picked(PAY_TEXTS, F.col("p_partkey") % 6), R.no_terms()).alias("intent")),
    "unique_in_order": lambda s, d: _part(s, d).select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name", "p_type", "p_name"), " ")).alias("words")),
    "eval_script_rows": lambda s, d: transcripts.customer_script(b.utterances(s, d), ["the ", "and "]).select(F.col("session_id").alias("id"), "script", F.concat(F.lit("N"), F.col("session_id") % 3).alias("truth")),
}


def _any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _held(x: str, tight: str, table: dict[str, list[str]]) -> str:
    cells = [f"CASE WHEN {_any(x, low)} OR {_any(tight, [t.replace(' ', '') for t in low])} THEN '{c}' END" for c, terms in table.items() for low in [[t.lower() for t in (c, *terms)]]]
    return f"list_filter([{', '.join(cells)}], lambda v: v IS NOT NULL)"


def _ordered(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_S = (
    _F
    + ", n AS (SELECT session_id, seq, pos, message, trim(regexp_replace(lower(message), '\\s+', ' ', 'g')) AS t, replace(trim(regexp_replace(lower(message), '\\s+', ' ', 'g')), ' ', '') AS c FROM g), h AS (SELECT *, "
    + f"{_held('t', 'c', CARDS)} AS cards, {_held('t', 'c', ACTIONS)} AS acts, {_held('t', 'c', PAYMENTS)} AS payments, {_held('t', 'c', WEAK)} AS weak, CASE WHEN contains(message, '!!') THEN ['shout'] ELSE [] END AS patterns, "
    + f"{_any('t', INFO)} AS info, {_any('t', USAGE)} AS usage, {_any('t', ISSUANCE)} AS issuance FROM n), s AS (SELECT *, list_concat(acts, patterns) AS actions FROM h)"
)
_C, _A, _P, _W = ("len(cards) > 0", "len(actions) > 0", "len(payments) > 0", "len(weak) > 0")
_CASE = (
    f"CASE WHEN {_any('t', WORDS.phone)} THEN 20 "
    + "".join(f"WHEN {_any('t', a)} AND {_any('t', x)} THEN 21 " for a, x in WORDS.force)
    + f"WHEN {_any('t', WORDS.reissue)} AND plain THEN 1 WHEN {_any('t', WORDS.benefit)} AND plain THEN 2 WHEN info AND NOT usage AND NOT {_P} AND len(patterns) = 0 THEN 3 WHEN issuance AND NOT {_C} THEN 4 "
    + f"WHEN {_C} AND {_A} THEN 5 WHEN {_C} AND {_P} THEN 6 WHEN {_C} AND {_W} THEN 7 WHEN {_C} THEN 8 WHEN {_A} THEN 9 WHEN {_P} THEN 10 ELSE 0 END"
)
_KEYS = {"card_name": ("cards", (2, 3, 5, 6, 7, 8)), "intent": ("actions", (3, 5, 9)), "payment_method": ("payments", (5, 6, 9, 10)), "weak_intent": ("weak", (3, 5, 7))}
_FILTERS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN k IN {on} AND len({c}) > 0 THEN '{key}=' || array_to_string({c}, '|') END" for key, (c, on) in _KEYS.items()) + ", CASE k WHEN 1 THEN 'intent=reissue' WHEN 4 THEN 'intent=issue' WHEN 20 THEN 'intent=phone_lookup' END], lambda v: v IS NOT NULL))"
_ROUTE = f"""{_S}, p AS (SELECT *, NOT contains(t, 'ñ') AS plain FROM s), k AS (SELECT *, {_CASE} AS k FROM p),
r AS (SELECT *, CASE WHEN k = 20 THEN 'phone_lookup' WHEN k IN (2, 3, 4, 8) OR k = 7 AND weak[1] = 'limit' THEN 'card_info' ELSE 'card_usage' END AS route,
{_C} OR {_A} OR {_P} OR {_W} OR len(patterns) > 0 AS strong, NOT contains(t, ' ') AS single FROM k),
m AS (SELECT *, NOT strong AND single OR {_C} AND NOT {_A} AND NOT {_P} AND NOT {_W} AND single AS mute, route = 'card_usage' AND contains(t, 'ment') AS terms FROM r)
SELECT session_id, seq, pos, route,
CASE WHEN k IN (1, 9, 20) THEN 'guide_tbl' WHEN k IN (4, 6, 8, 10, 21) THEN 'card_tbl' WHEN k = 2 OR k = 3 AND NOT {_A} AND NOT {_W} THEN CASE WHEN {_C} THEN 'card_tbl' ELSE 'both' END ELSE 'both' END AS db_route,
{_FILTERS} AS filters,
CASE k WHEN 3 THEN CASE WHEN {_C} THEN cards[1] || ' info' WHEN {_A} THEN 'card ' || actions[1] || ' info' END WHEN 4 THEN 'card issue terms' WHEN 5 THEN cards[1] || ' ' || actions[1] || ' how' WHEN 6 THEN cards[1] || ' ' || payments[1] || ' use'
WHEN 7 THEN cards[1] || ' ' || weak[1] || CASE WHEN weak[1] = 'limit' THEN '' ELSE ' how' END WHEN 8 THEN cards[1] || ' info' WHEN 9 THEN 'card ' || actions[1] || ' how' WHEN 10 THEN payments[1] || ' use' END AS template,
k >= 20 OR NOT mute AND (k <> 9 OR list_contains(actions, 'loss')) AS trigger, k >= 20 OR strong AND length(t) >= 2 AND NOT mute AS search,
CASE WHEN k = 20 THEN ['guide_merged', 'guide_general'] WHEN k = 21 THEN [] WHEN NOT plain THEN ['hyundai_applepay', 'guide_general'] WHEN terms THEN ['guide_with_terms'] WHEN list_has_any(actions, ['loss', 'error', 'open']) THEN ['guide_merged', 'guide_general'] WHEN route = 'card_info' THEN ['card_products', 'guide_merged', 'guide_general'] ELSE ['guide_merged', 'guide_general'] END AS sources,
CASE WHEN k >= 20 THEN ['terms'] WHEN NOT plain THEN ['terms', 'card_products'] WHEN terms THEN [] ELSE ['terms'] END AS exclude,
CASE WHEN k = 20 THEN 'B' WHEN k = 21 THEN 'C' WHEN NOT plain OR route = 'card_info' AND {_C} THEN 'A' WHEN {_A} OR {_C} AND {_P} THEN 'B' ELSE 'C' END AS policy FROM m"""
_SETTLED = f"""{_S}, d AS ({_ROUTE}), j AS (SELECT d.session_id, d.seq, d.pos, s.t, d.filters AS given, d.route = 'phone_lookup' OR len(d.sources) = 0 AS fixed,
(contains(t, 'loss') OR contains(t, 'ara')) AND (NOT contains(t, 'en ') OR contains(t, 'ta')) AS lost, contains(t, 'en ') AS info, contains(t, 'na') AS pass FROM d JOIN s USING (session_id, seq, pos)),
e AS (SELECT *, list_transform(given, lambda f: {{'k': split_part(f, '=', 1), 'v': string_split(split_part(f, '=', 2), '|')}}) AS f FROM j),
c AS (SELECT *, list_filter(list_transform(f, lambda x: {{'k': x.k, 'v': CASE WHEN x.k = 'card_name' THEN list_filter(x.v, lambda n: NOT contains(lower(n), 'pre') AND length(n) < 12)
WHEN x.k IN ('intent', 'weak_intent') AND NOT lost THEN CASE WHEN info THEN [] ELSE list_filter(x.v, lambda n: NOT contains(n, 'los') AND NOT contains(n, 'limit')) END ELSE x.v END}}), lambda x: len(x.v) > 0) AS g FROM e),
m AS (SELECT *, CASE WHEN pass THEN list_filter([CASE WHEN len(list_filter(g, lambda x: x.k = 'card_name')) = 0 THEN 'card_name=pass' END,
CASE WHEN contains(t, 'ka') THEN 'region=north' WHEN contains(t, 'la') OR contains(t, 'so') THEN 'region=south' END,
CASE WHEN contains(t, 'or') AND (contains(t, 'ma') OR contains(t, 'mi')) THEN 'benefit_type=young|family' WHEN contains(t, 'or') THEN 'benefit_type=young' WHEN contains(t, 'ma') OR contains(t, 'mi') THEN 'benefit_type=family' END], lambda x: x IS NOT NULL) ELSE [] END AS more FROM c)
SELECT session_id, seq, pos, CASE WHEN fixed THEN given ELSE list_sort(list_concat(list_transform(g, lambda x: x.k || '=' || array_to_string(x.v, '|')), more)) END AS filters FROM m"""
_SPELL = "[x, replace(x, ' ', ''), replace(x, ' ', '-'), replace(x, '-', ''), replace(x, '-', ' '), replace(x, '.', ''), replace(x, '.', ' ')]"
_SCRIPTS = f"WITH {_U}, c AS (SELECT session_id, seq, trim(replace(replace(message, 'the ', ''), 'and ', ''), E' \\n\\t\\r') AS m FROM u WHERE speaker = 'customer') SELECT session_id, trim(regexp_replace(string_agg(m, ' ' ORDER BY seq, m), '\\s+', ' ', 'g')) AS script FROM c WHERE length(m) > 4 GROUP BY session_id"

_CASES = f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS category, text FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
q AS (SELECT id AS query_id, CASE WHEN id % 250 > 0 THEN e END AS f, CASE WHEN id % 100 = 0 THEN 'none' ELSE category END AS category, {ASKED}[id // 50 % {len(ASKED)} + 1] AS text FROM v WHERE id % 50 = 0),
asked AS (SELECT query_id, text FROM q), cases AS (SELECT id, text FROM v WHERE coalesce(text, '') <> ''), {covers_sql()},
p AS (SELECT query_id, v.id, list_cosine_similarity(e, f) AS vector_score, v.category = q.category AS own FROM v, q WHERE f IS NOT NULL),
s AS (SELECT *, max(CAST(own AS INT)) OVER (PARTITION BY query_id) AS held FROM p),
n AS (SELECT query_id, id, CASE WHEN held = 1 THEN 'category' ELSE 'all' END AS stage, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) AS rank, vector_score FROM s WHERE held = 0 OR own),
t AS (SELECT q.query_id, c.id, 'text' AS stage, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(k.rank, 0) DESC, c.id) AS rank, 0.0 AS vector_score FROM q CROSS JOIN cases c LEFT JOIN ranks k ON k.query_id = q.query_id AND k.id = c.id WHERE q.f IS NULL),
u AS (SELECT u.*, coalesce(k.rank, 0) AS text_score FROM (SELECT * FROM n WHERE rank <= 5 UNION ALL SELECT * FROM t WHERE rank <= 5) u LEFT JOIN ranks k ON k.query_id = u.query_id AND k.id = u.id)
SELECT query_id, id, stage, rank, CAST(round(vector_score, 5) AS DOUBLE) AS vector_score, CAST(round(text_score, 5) AS DOUBLE) AS text_score, CAST(round(0.8 * vector_score + 0.2 * least(text_score, 1), 5) AS DOUBLE) AS score FROM u"""

ORACLE_SQL = {
    "contained_signals": _S + " SELECT session_id, seq, pos, cards, actions, payments, weak, patterns, info, usage, issuance FROM s",
    "route_decision": _ROUTE,
    "route_filters": _SETTLED,
    "fallback_contains": f"SELECT doc_id, {_held('lower(text)', chr(39).join(['replace(lower(text), ', ' ', ', ', '', ')']), {**CARDS, **ACTIONS, **WEAK})} AS found FROM documents",
    "expand_terms": "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), a AS (SELECT p_partkey, list_concat(w, flatten(list_transform(w, lambda t: CASE t WHEN 'small' THEN ['tiny', 'very small'] WHEN 'widget' THEN ['gadget'] WHEN 'large' THEN ['big one'] ELSE [] END))) AS w FROM s), "
    + f"o AS (SELECT p_partkey, {_ordered('w')} AS w FROM a), x AS (SELECT p_partkey, list_concat(w, list_transform(w, lambda t: replace(t, ' ', ''))) AS w FROM o) SELECT p_partkey, {_ordered('w')} AS terms FROM x",
    "guide_terms": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['분실도난'] WHEN 1 THEN ['분실도난', '분실 도난', '분실·도난'] WHEN 2 THEN ['안내'] ELSE ['해지 방법', '해지방법', '한도'] END AS terms FROM part",
    "guidance_flags": _S + f" SELECT session_id, seq, pos, t <> '' AND ({_any('t', ['ll', 'oss'])} OR list_contains(actions, 'loss')) AS guidance, {_C} AND (pos % 3 = 0 OR contains(c, 'thea')) AS expand FROM s",
    "card_keywords": f"WITH k AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: '#' || x) AS w FROM part) SELECT p_partkey, {_ordered('w')} AS keywords FROM k",
    "guidance_slots": "SELECT p_partkey, list_transform(list_sort(list_transform(list_distinct(list_concat(string_split(p_name, ' '), [p_brand])), lambda x: {'n': length(x), 'x': x})), lambda v: v.x) AS card_names, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS region, list_sort(list_distinct([p_type, p_brand])) AS benefit_types FROM part",
    "chat_template_rows": "SELECT item_id, CAST(to_json([{'role': 'system', 'content': 'You help'}, {'role': 'user', 'content': text}, {'role': 'assistant', 'content': 'answer ' || item_id}]) AS VARCHAR) AS messages FROM benchmark",
    "tag_overlap": "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['small', 'bolt']) AS overlap FROM part",
    "unused_agents": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)",
    "missing_expected": "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "expiring_cards": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'",
    "synonym_bags": f"WITH t AS (SELECT p_type AS category, p_name AS x FROM part UNION SELECT p_type, p_brand FROM part), v AS (SELECT category, unnest({_SPELL}) AS term FROM t) SELECT category, list_sort(list(DISTINCT term)) AS terms FROM v GROUP BY category",
    "consult_case_search": _CASES,
    "card_info_rerank": "WITH q AS (SELECT p_partkey AS query_id, p_size, string_split(p_name || ' ' || lower(p_type), ' ') AS terms FROM part WHERE p_partkey % 50 = 0), h AS (SELECT query_id, p_partkey AS id, CAST(len(list_filter(terms, lambda t: contains(lower(p_name), t) OR contains(lower(p_type), t) OR contains(lower(p_brand), t))) AS BIGINT) AS hits FROM part JOIN q USING (p_size)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM h",
    "parse_model_output": f"WITH {_U} SELECT session_id, seq, seq % 5 = 4 AS failed, CASE WHEN seq % 5 < 4 THEN speaker END AS speaker, CASE WHEN seq % 5 < 4 THEN message END AS message, CAST(seq % 5 < 4 AS BIGINT) AS n FROM u",
    "phonetic_similarity": "WITH p AS (SELECT DISTINCT p_name, p_type, lower(replace(p_name, ' ', '')) AS a, lower(replace(p_type, ' ', '')) AS b FROM part) SELECT p_name, p_type, round(1 - levenshtein(a, b) * 1.0 / greatest(length(a), length(b)), 6)::DOUBLE AS similarity FROM p",
    "conform_status": "SELECT o_orderkey, (['in_progress', 'incomplete', 'completed', 'in_progress'])[o_orderkey % 4 + 1] AS status FROM orders",
    "conform_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "duration_format": "WITH n AS (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(floor(value) AS BIGINT) END AS n FROM events) SELECT event_id, CASE WHEN n IS NOT NULL THEN printf('%02d:%02d', n // 60, n % 60) END AS text, coalesce(n, 0) AS seconds FROM n",
    "conform_documents": "SELECT doc_id AS id, '제' || doc_id || '조 ' || source AS title, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'own' END AS content, list_filter([lang, source], lambda v: v IS NOT NULL) AS keywords, CASE WHEN source IS NOT NULL THEN '제' || doc_id || '조' END AS document_number FROM documents",
    "applepay_intent": "SELECT p_partkey, (['applepay_add_card', 'applepay_payment', 'applepay_add_card', NULL, 'applepay_transport', 'applepay_general'])[p_partkey % 6 + 1] AS intent FROM part",
    "unique_in_order": f"WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part) SELECT p_partkey, {_ordered('w')} AS words FROM w",
    "customer_script": _SCRIPTS,
    "eval_script_rows": f"WITH s AS ({_SCRIPTS}) SELECT session_id AS id, script, 'N' || session_id % 3 AS truth FROM s",
}
