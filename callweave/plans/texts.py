"""Queries over documents, conversations and conformed columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.operators import ingest, transcripts
from callweave.sources import bindings as b

_RULES = {"small ": "small-", "ring": "band", "large ": "large-"}
_CLASSES = {"FUNCTION": ["the ", "der ", "que "], "ENDING": ["tion", "heit", "ment"], "MARK": ["|", "!!"]}
_TERMS = ["the", "and", "der", "die", "que", "les", "las", "tion", "heit", "ment", "ción"]


def _docs(s, d):
    return b.guide_documents(s, d)


def _orders_as_batch(s, d):
    """Orders as an upsert batch: several rows a customer, load order by order key."""
    return b.table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("grade"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderkey").alias("load_order"))


def _customer_target(s, d):
    return b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grade"), F.lit("new").alias("status"), F.col("c_name").alias("name"))


def _map_category(s, d):
    calls = b.consultations(s, d).select("id", "category_raw")
    mapping = s.createDataFrame([("view", "결제/승인", "조회/안내"), ("purchase", "결제/승인", "발급"), ("click", "한도", "변경")], "category_raw string, category_main string, category_sub string")
    return ingest.map_category(calls, mapping).select("id", "category_main", "category_sub", "normalized")


def _dictionary(s, d):
    """Parts as a keyword dictionary: name, its brand and type as categories."""
    rows = b.table(s, d, "part").select("p_name", "p_brand", "p_type", "p_size").distinct()
    entry = F.struct(F.col("p_type").alias("category"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 10).cast("int").alias("priority"), F.lit(None).cast("string").alias("urgency"), F.lit(None).cast("double").alias("weight"))
    return rows.groupBy(F.col("p_name").alias("keyword")).agg(F.array_sort(F.collect_set(entry)).alias("categories"), F.array_sort(F.collect_set("p_brand")).alias("synonyms")).withColumn("canonical", F.col("keyword"))


def _priority(s, d):
    entries = _dictionary(s, d).select("keyword", F.posexplode("categories").alias("pos", "c")).select("keyword", "pos", "c.category", F.coalesce("c.priority", F.lit(5)).alias("priority"))
    return ingest.dictionary_priority(entries)


def _batches(s, d):
    turns = b.fragments(s, d)
    members = transcripts.overlap_batches(turns)
    place = turns.withColumn("place", (F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "pos")) - 1).cast("long"))
    return members.join(place.select("session_id", "place", "speaker", "message"), ["session_id", "place"]).select("session_id", "batch", F.col("place").alias("seq"), "speaker", "message")


def _emotion(k):
    return F.get(F.array(*map(F.lit, ("부정", "중립", "긍정"))), (k % 3).cast("int"))


def _said(speaker, at, names):
    """The speaker's name among others it goes by; other speakers are the counselor."""
    other = F.get(F.array(*map(F.lit, names)), at.cast("int"))
    return F.when(F.col("speaker") == speaker, other).otherwise("상담사")


def _diarized(s, d):
    rows = b.utterances(s, d)
    truth = rows.withColumn("kind", F.lit("truth"))
    guess = rows.withColumn("kind", F.lit("predicted")).withColumn("speaker", F.when(F.col("seq") % 5 == 0, "agent").otherwise(F.col("speaker")))
    return truth.unionByName(guess)


def _confusion(s, d):
    return transcripts.speaker_confusion(_diarized(s, d))


def _script_pairs(s, d):
    rows = b.utterances(s, d)
    return rows.select((F.col("session_id") * 1000 + F.col("seq")).alias("id"), F.col("message").alias("before"), F.replace("message", F.lit(" the "), F.lit(" a ")).alias("after"))


RELATED = {"view": ["click", "signup"], "purchase": ["view", "click", "refund"], "signup": ["view"]}


def _redacted(s, d):
    clean = T.redact(F.col("content"), contacts=["there", "dans"], names=["rights"])
    return _docs(s, d).select("id", F.sha2(clean, 256).alias("redacted"), (clean != F.col("content")).alias("changed"))


QUERIES = {
    "normalize_category": lambda s, d: b.table(s, d, "part").select("p_partkey", T.normalize_category(F.col("p_name"), {}, _RULES).alias("normalized")),
    "map_category": _map_category,
    "category_keywords": lambda s, d: b.table(s, d, "part").select("p_partkey", T.category_words(F.concat_ws("/", "p_name", "p_type")).alias("words")),
    "conform_call_time": lambda s, d: b.consultations(s, d).select("id", T.call_time_of(T.seed_of(F.concat(F.lit("src-"), F.col("id")))).alias("call_time"), T.weekday_only(F.col("call_date"), F.col("id"), ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]).alias("call_day")),
    "seed_from_md5": lambda s, d: b.customers(s, d).select("id", T.seed_of(F.regexp_replace("grade", r"\d", "")).alias("seed")),
    "new_consultation_id": lambda s, d: b.consultations(s, d).select("id", T.consultation_id(F.concat(F.lit("A-"), F.col("agent_id")), F.col("call_ts")).alias("consultation_id")),
    "handled_categories": lambda s, d: b.consultations(s, d).select("id", T.handled_categories(F.col("category_raw"), F.col("category_raw"), F.col("id").cast("string"), RELATED).alias("handled")),
    "processing_timeline": lambda s, d: b.consultations(s, d).select("id", T.timeline(F.hour("call_ts") * 3600 + F.minute("call_ts") * 60, F.expr("CAST(split(call_duration, ':')[0] AS INT) * 60 + CAST(split(call_duration, ':')[1] AS INT)"), ["intake", "check", "close"]).alias("steps")).select("id", F.transform("steps", lambda x: F.concat_ws(" ", x["step"], x["at"])).alias("steps")),
    "upsert_latest": lambda s, d: ingest.upsert_latest(_customer_target(s, d), _orders_as_batch(s, d), ["id"], "load_order", ["grade", "status"], ["status"]),
    "insert_ignore": lambda s, d: ingest.insert_ignore(_customer_target(s, d).filter("id % 2 = 0"), _orders_as_batch(s, d).withColumn("name", F.lit("order")), ["id"], "load_order"),
    "flatten_keywords": lambda s, d: ingest.flatten_keywords(_dictionary(s, d)),
    "flatten_synonyms": lambda s, d: ingest.flatten_synonyms(_dictionary(s, d)),
    "dictionary_priority": _priority,
    "card_name_synonyms": lambda s, d: ingest.card_synonyms(b.table(s, d, "part").select(F.col("p_name").alias("name")), b.table(s, d, "supplier").select(F.concat_ws("-", F.lit("No.1"), "s_name").alias("name"))),
    "exact_duplicate_docs": lambda s, d: ingest.exact_duplicates(_docs(s, d)),
    "normalize_query": lambda s, d: b.table(s, d, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("query")),
    "query_terms": lambda s, d: b.table(s, d, "benchmark").select("item_id", T.query_terms(F.col("text"), ["the", "and", "of"], ["tion", "ly"]).alias("terms")),
    "answer_class": lambda s, d: _docs(s, d).select("id", T.answer_class(F.col("content"), _CLASSES, "OTHER").alias("c")).select("id", "c.primary", "c.secondary"),
    "search_gating": lambda s, d: _docs(s, d).select("id", T.domain_score(F.col("content"), _TERMS).alias("score"), "content").select("id", "score", T.search_gate(F.col("content"), F.col("score")).alias("g")).select("id", "score", "g.no_search", "g.retrieval_mode"),
    "search_mode": lambda s, d: _docs(s, d).select("id", T.search_mode(F.col("content"), ["!!"], ["|"]).alias("mode")),
    "composite_actions": lambda s, d: _docs(s, d).select("id", T.composite_actions(F.col("content"), {"shout": "(?s)!!.*!!", "table": r"\| \w+ \|", "licence": "[Rr]ights.{0,9}reserved"}).alias("actions")),
    "correction_map": lambda s, d: b.utterances(s, d).select("session_id", "seq", T.correct_terms(F.col("message"), {"the": "da", "there": "dar", "and": "und", "x": "x"}).alias("message")),
    "clean_utterance": lambda s, d: b.utterances(s, d).select("session_id", "seq", T.clean_utterance(F.concat(F.lit("<new_start> "), F.col("message"), F.lit(" [NEW_START]\n"))).alias("message")),
    "spam_repetition": lambda s, d: b.fragments(s, d).select("session_id", "seq", "pos", T.is_spam(F.col("message")).alias("spam")),
    "sentence_split": lambda s, d: b.utterances(s, d).select("session_id", "seq", F.posexplode(T.sentences(F.col("message"))).alias("pos", "sentence")),
    "redact_text": _redacted,
    "dedupe_blocks": lambda s, d: b.utterances(s, d).select("session_id", "seq", T.dedupe_blocks(F.replace("message", F.lit("\n"), F.lit("\n\n"))).alias("text")),
    "emotion_score": lambda s, d: b.consultations(s, d).select("id", T.transition_score(*[_emotion(F.floor(F.col("k") / n)) for n in (1, 3, 9)]).cast("long").alias("points"), T.work_score(F.col("k") * 3).cast("long").alias("work")),
    "retrieval_cache_key": lambda s, d: b.table(s, d, "benchmark").select("item_id", T.cache_key(F.lit("card_info"), F.col("text"), F.array(F.lit("b"), F.lit("a")), 5).alias("key")),
    "pg_array_text": lambda s, d: b.table(s, d, "part").select("p_partkey", T.pg_array(F.split("p_name", " ")).alias("text"), T.from_pg_array(T.pg_array(F.split("p_name", " "))).alias("parts")),
    "merge_same_speaker": lambda s, d: transcripts.merge_same_speaker(b.fragments(s, d)),
    "recent_context": lambda s, d: transcripts.recent_context(b.utterances(s, d)),
    "fragment_batches": lambda s, d: transcripts.fragment_batches(b.fragments(s, d)),
    "overlap_batches": lambda s, d: transcripts.overlap_batches(b.fragments(s, d)),
    "format_dialogue": lambda s, d: transcripts.format_dialogue(b.utterances(s, d)),
    "write_dialogue_json": lambda s, d: transcripts.dialogue_json(b.utterances(s, d)),
    "customer_script": lambda s, d: transcripts.customer_script(b.utterances(s, d), ["the ", "and "]),
    "dialogue_refine_join": lambda s, d: transcripts.refine_join(b.utterances(s, d), b.utterances(s, d).filter("seq % 2 = 0").select("session_id", "seq", F.when(F.col("seq") % 4 == 0, "").otherwise(F.reverse("message")).alias("refined"))),
    "near_duplicate_turns": lambda s, d: transcripts.near_duplicate_turns(b.fragments(s, d).withColumn("seq", F.col("seq") * 1000 + F.col("pos")).select("session_id", "seq", "speaker", "message")),
    "merge_batches": lambda s, d: transcripts.merge_batches(_batches(s, d)),
    "sequence_ratio": lambda s, d: transcripts.sequence_ratio(_script_pairs(s, d), "before", "after"),
    "word_diff": lambda s, d: transcripts.word_diff(_script_pairs(s, d), "before", "after"),
    "correction_summary": lambda s, d: transcripts.correction_summary(_script_pairs(s, d), "before", "after"),
    "diarization_confusion": _confusion,
    "style_sample": lambda s, d: transcripts.style_sample(b.utterances(s, d).filter("length(message) >= 4").select((F.col("session_id") * 1000 + F.col("seq")).alias("id"), "message"), "id", 300, {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}).groupBy("style").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("style") == "plain").alias("plain")).agg(F.sum("n").alias("n")),
    "train_test_split": lambda s, d: transcripts.train_test_split(b.utterances(s, d).select((F.col("session_id") * 1000 + F.col("seq")).alias("id"), "message"), "id", 5000).select("id", "is_test"),
    "category_hints": lambda s, d: b.table(s, d, "part").select("p_partkey", T.category_hints(F.split("p_name", " "), ["l", "ar", "ring", "co"], ("ring", "co", "cold ring")).alias("hints")).select("p_partkey", "hints", T.priority_terms(F.col("hints"), {"ring": ["cold ring", "ring first"], "cold ring": ["cold ring"], "co": ["cobalt"]}).alias("terms")),
    "clean_items": lambda s, d: transcripts.clean_items(b.utterances(s, d).select("session_id", "seq", _said("customer", F.col("seq") % 4, ["customer", "client", "손님", "someone"]).alias("speaker"), F.when(F.col("seq") % 9 == 0, " \n<NEW_START>").otherwise(F.concat("message", F.lit(" [new_start]"))).alias("message"))),
    "correction_similarity": lambda s, d: transcripts.correction_similarity(_script_pairs(s, d).withColumn("said", F.replace("before", F.lit("the"), F.lit("teh"))), "said", "after", "before"),
    "diarization_accuracy": lambda s, d: transcripts.speaker_accuracy(_diarized(s, d)),
    "json_or_default": lambda s, d: b.table(s, d, "events").select("event_id", T.struct_or_default(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken"), "props")).when(F.col("event_id") % 7 == 0, '{"tone": "warm"}').otherwise(F.replace("props", F.lit('"k"'), F.lit('"speed"'))), "tone string, speed string", {"tone": "neutral", "speed": "moderate"}).alias("j")).select("event_id", "j.tone", "j.speed"),
}

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_U = "u AS (SELECT conv_id AS session_id, turn AS seq, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' END AS speaker, text AS message FROM conversations WHERE role IN ('user', 'assistant'))"
_F = "WITH " + _U + ", x AS (SELECT session_id, seq, speaker, string_split(message, chr(10)) AS parts FROM u), y AS (SELECT session_id, seq, speaker, unnest(parts) AS message, CAST(unnest(range(len(parts))) AS BIGINT) AS pos FROM x), g AS (SELECT * FROM y WHERE trim(message, ' ') <> '')"
_PAIRS = "WITH " + _U + ", p AS (SELECT session_id * 1000 + seq AS id, message AS before, replace(message, ' the ', ' a ') AS after FROM u)"
_ORDERS = "b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS down, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders)"
_WORDS = "(['부정','중립','긍정'])"


def _step(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 3 WHEN {a} = '부정' AND {b} = '중립' THEN 5 WHEN {b} = '긍정' THEN 10 WHEN {a} = '긍정' AND {b} = '중립' THEN 5 ELSE 0 END"


ORACLE_SQL = {
    "sentence_split": "WITH " + _U + r""", p AS (SELECT session_id, seq, CASE WHEN length(message) <= 120 THEN [message] ELSE flatten(list_transform(list_filter(list_transform(regexp_extract_all(message, '([^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$)'),
 lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), lambda s: list_transform(range(0, CAST(ceil(length(s) / 120.0) AS BIGINT)), lambda i: s[i * 120 + 1:i * 120 + 120]))) END AS s FROM u)
SELECT session_id, seq, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM p""",
    "dedupe_blocks": "WITH " + _U + r""", x AS (SELECT session_id, seq, list_filter(regexp_split_to_array(message, '\n+'), lambda b: regexp_matches(b, '\S')) AS w FROM u),
k AS (SELECT session_id, seq, list_transform(w, lambda b: trim(regexp_replace(lower(b), '\s+', ' ', 'g'))) AS k, list_transform(w, lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')) AS w FROM x)
SELECT session_id, seq, array_to_string(list_filter(w, lambda b, i: list_position(k, k[i]) = i), chr(10) || chr(10)) AS text FROM k""",
    "retrieval_cache_key": r"""SELECT item_id, sha1('{"route":"card_info","query":' || to_json(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) || ',"filters":["a","b"],"k":5}') AS key FROM benchmark""",
    "redact_text": r"""WITH a AS (SELECT doc_id AS id, text, regexp_replace(text, '(?i)https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|\S+\.(?:com|kr)\b', '', 'g') AS t FROM documents),
c AS (SELECT id, text, regexp_replace(t, '\(\s*\d{2,4}\s*[-–—‑]\s*\d{3,4}\s*[-–—‑]\s*\d{4}\s*\)|\b\d{2,4}\s*[-–—‑]\s*\d{3,4}\s*[-–—‑]\s*\d{4}\b|\b\d{2,4}[-–—‑]\d{4}\b|\b\d{8,11}\b', '', 'g') AS t FROM a),
r AS (SELECT id, text, regexp_replace(replace(regexp_replace(t, '(?:there|dans)[^\n]*', '', 'g'), 'rights', ''), '\(\s*\)', '', 'g') AS clean FROM c)
SELECT id, sha256(clean) AS redacted, clean <> text AS changed FROM r""",
    "handled_categories": f"""WITH e AS (SELECT event_id AS id, event_type AS c, CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:8] AS BIGINT) AS seed FROM events),
o AS (SELECT *, CASE c {' '.join(f"WHEN '{m}' THEN {names}[seed // 100 % {len(names)} + 1]" for m, names in RELATED.items())} END AS other FROM e)
SELECT id, CASE WHEN seed % 100 < 7 AND other IS NOT NULL THEN [c, other] ELSE [c] END AS handled FROM o""",
    "train_test_split": f"WITH {_U}, r AS (SELECT session_id * 1000 + seq AS id, row_number() OVER (ORDER BY md5('42:' || (session_id * 1000 + seq)), session_id * 1000 + seq) AS n, least(count(*) OVER (), 5000) AS most FROM u) SELECT id, n <= ceil(most * 10 / 100) AS is_test FROM r WHERE n <= most",
    "category_hints": "WITH t AS (SELECT p_partkey, flatten(list_transform(string_split(p_name, ' '), lambda t: list_filter(['l', 'ar', 'ring', 'co'], lambda h: contains(t, h)))) AS h FROM part), j AS (SELECT p_partkey, CASE WHEN list_contains(h, 'ring') AND list_contains(h, 'co') THEN list_append(h, 'cold ring') ELSE h END AS h FROM t), k AS (SELECT p_partkey, list_filter(h, lambda x, i: list_position(h, x) = i) AS hints FROM j), p AS (SELECT p_partkey, hints, flatten(list_transform(hints, lambda x: CASE x WHEN 'ring' THEN ['cold ring', 'ring first'] WHEN 'cold ring' THEN ['cold ring'] WHEN 'co' THEN ['cobalt'] ELSE [] END)) AS q FROM k) SELECT p_partkey, hints, list_filter(q, lambda x, i: list_position(q, x) = i) AS terms FROM p",
    "clean_items": f"WITH {_U} SELECT session_id, seq, speaker, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS message FROM u WHERE seq % 9 > 0 AND NOT (speaker = 'customer' AND seq % 4 = 3) AND trim(regexp_replace(message, '\\s+', ' ', 'g')) <> ''",
    "json_or_default": f"SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 7 = 0 THEN 'warm' ELSE 'neutral' END AS tone, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'moderate' ELSE CAST({_K} AS VARCHAR) END AS speed FROM events",
    "write_dialogue_json": f"WITH {_U} SELECT 'stt:' || session_id AS key, CAST(to_json(list({{'seq': seq, 'speaker': speaker, 'message': message}} ORDER BY seq, speaker, message)) AS VARCHAR) AS value FROM u GROUP BY session_id",
    "card_name_synonyms": "WITH n AS (SELECT p_name AS name FROM part UNION SELECT 'No.1-' || s_name FROM supplier) SELECT name, list_sort(list_filter(list_distinct([replace(name, ' ', ''), replace(name, ' ', '-'), replace(name, '-', ''), replace(name, '-', ' '), replace(name, '.', ''), replace(name, '.', ' ')]), lambda x: x <> name)) AS variants FROM n",
    "composite_actions": r"SELECT doc_id AS id, list_filter([CASE WHEN regexp_matches(text, '(?s)!!.*!!') THEN 'shout' END, CASE WHEN regexp_matches(text, '\| \w+ \|') THEN 'table' END, CASE WHEN regexp_matches(text, '[Rr]ights.{0,9}reserved') THEN 'licence' END], lambda x: x IS NOT NULL) AS actions FROM documents",
    "normalize_category": "SELECT p_partkey, replace(replace(replace(trim(p_name), 'small ', 'small-'), 'ring', 'band'), 'large ', 'large-') AS normalized FROM part",
    "map_category": "SELECT event_id AS id, CASE event_type WHEN 'view' THEN '결제/승인' WHEN 'purchase' THEN '결제/승인' WHEN 'click' THEN '한도' ELSE '기타' END AS category_main, CASE event_type WHEN 'view' THEN '조회/안내' WHEN 'purchase' THEN '발급' WHEN 'click' THEN '변경' ELSE '기타' END AS category_sub, event_type AS normalized FROM events",
    "category_keywords": "SELECT p_partkey, list_filter(regexp_split_to_array(p_name || '/' || p_type, '[/\\s]+'), lambda x: x <> '') AS words FROM part",
    "conform_call_time": "WITH t AS (SELECT event_id AS id, event_id AS s, CAST(ts AS DATE) AS day FROM events), h AS (SELECT *, 9 + (s // 100) % 9 AS h0, 9 + (s // 1000) % 8 AS h1 FROM t) SELECT id, lpad(CAST(CASE WHEN h0 = 12 AND s % 100 < 30 THEN CASE WHEN h1 >= 12 THEN h1 + 1 ELSE h1 END ELSE h0 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS call_time, CASE WHEN isodow(day) >= 6 THEN DATE '2024-01-01' + CAST(id % 5 AS INTEGER) ELSE day END AS call_day FROM h",
    "seed_from_md5": "WITH m AS (SELECT c_custkey AS id, md5(c_mktsegment) AS h FROM customer) SELECT id, ((((((((0) * 67296 + CAST('0x' || substr(h, 1, 8) AS BIGINT)) % 100000) * 67296 + CAST('0x' || substr(h, 9, 8) AS BIGINT)) % 100000) * 67296 + CAST('0x' || substr(h, 17, 8) AS BIGINT)) % 100000) * 67296 + CAST('0x' || substr(h, 25, 8) AS BIGINT)) % 100000 AS seed FROM m",
    "new_consultation_id": f"SELECT event_id AS id, 'CS-A' || CAST({_K} % 20 AS VARCHAR) || '-' || strftime(ts, '%Y%m%d%H%M') AS consultation_id FROM events",
    "processing_timeline": "WITH t AS (SELECT event_id AS id, hour(ts) * 3600 + minute(ts) * 60 AS s, CASE WHEN floor(value) > 0 THEN CAST(floor(value) AS BIGINT) ELSE 300 END AS d FROM events), a AS (SELECT id, s % 86400 AS a0, (s + d // 3) % 86400 AS a1, (s + 2 * d // 3) % 86400 AS a2 FROM t) SELECT id, ['intake ' || printf('%02d:%02d:%02d', a0 // 3600, a0 // 60 % 60, a0 % 60), 'check ' || printf('%02d:%02d:%02d', a1 // 3600, a1 // 60 % 60, a1 % 60), 'close ' || printf('%02d:%02d:%02d', a2 // 3600, a2 // 60 % 60, a2 % 60)] AS steps FROM a",
    "upsert_latest": f"WITH {_ORDERS}, n AS (SELECT * FROM b WHERE down = 1) SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE o_orderpriority END AS grade, CASE WHEN o_custkey IS NULL THEN 'new' WHEN c_custkey IS NULL THEN st ELSE coalesce(st, 'new') END AS status, c_name AS name FROM customer FULL JOIN n ON o_custkey = c_custkey",
    "insert_ignore": f"WITH {_ORDERS}, t AS (SELECT c_custkey AS id, c_mktsegment AS grade, 'new' AS status, c_name AS name FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM t UNION ALL SELECT o_custkey, o_orderpriority, st, 'order' FROM b WHERE up = 1 AND o_custkey NOT IN (SELECT id FROM t)",
    "flatten_keywords": "SELECT DISTINCT p_name AS keyword, p_type AS category, CAST(coalesce(CASE WHEN p_size % 4 > 0 THEN p_size % 10 END, 5) AS INTEGER) AS priority, 'medium' AS urgency, CAST(1.0 AS DOUBLE) AS weight FROM part WHERE p_size % 4 > 0 UNION ALL SELECT DISTINCT p_name, p_type, 5, 'medium', 1.0 FROM part WHERE p_size % 4 = 0",
    "flatten_synonyms": "SELECT DISTINCT b.p_brand AS synonym, a.p_name AS canonical, a.p_type AS category FROM part a JOIN part b ON a.p_name = b.p_name",
    "dictionary_priority": "WITH e AS (SELECT DISTINCT p_name AS keyword, p_type AS category, CASE WHEN p_size % 4 > 0 THEN p_size % 10 END AS p FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY coalesce(p, 5) DESC, category, p NULLS FIRST) AS n FROM e) SELECT keyword, category FROM o WHERE n = 1",
    "exact_duplicate_docs": "WITH k AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS first_id FROM documents) SELECT * FROM k WHERE id <> first_id",
    "normalize_query": "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS query FROM benchmark",
    "answer_class": "WITH h AS (SELECT doc_id AS id, list_filter([CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') OR contains(lower(text), 'que ') THEN 'FUNCTION' END, CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'heit') OR contains(lower(text), 'ment') THEN 'ENDING' END, CASE WHEN contains(text, '|') OR contains(text, '!!') THEN 'MARK' END], lambda x: x IS NOT NULL) AS m FROM documents) SELECT id, coalesce(m[1], 'OTHER') AS primary, m[2:] AS secondary FROM h",
    "search_mode": "SELECT doc_id AS id, CASE WHEN contains(text, '!!') THEN 'ISSUE' WHEN contains(text, '|') THEN 'BENEFIT' ELSE 'GENERAL' END AS mode FROM documents",
    "search_gating": "WITH s AS (SELECT doc_id AS id, text, CAST(" + " + ".join(f"CASE WHEN contains(lower(text), '{t}') OR contains(replace(lower(text), ' ', ''), '{t}') THEN 1 ELSE 0 END" for t in _TERMS) + " AS BIGINT) AS score FROM documents) SELECT id, score, score = 0 AND (length(trim(text)) <= 3 OR regexp_full_match(lower(trim(text)), '(ok|okay)')) AS no_search, CASE WHEN score < 5 THEN 'keyword_only' ELSE 'hybrid' END AS retrieval_mode FROM s",
    "correction_map": f"WITH {_U} SELECT session_id, seq, replace(replace(replace(message, 'there', 'dar'), 'the', 'da'), 'and', 'und') AS message FROM u",
    "clean_utterance": f"WITH {_U} SELECT session_id, seq, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS message FROM u",
    "spam_repetition": _F + " SELECT session_id, seq, pos, length(regexp_replace(message, '\\s', '', 'g')) >= 10 AND len(list_distinct(string_split(regexp_replace(message, '\\s', '', 'g'), ''))) <= 2 AS spam FROM g",
    "emotion_score": f"WITH e AS (SELECT event_id AS id, {_K} AS k FROM events), m AS (SELECT id, k, {_WORDS}[k % 3 + 1] AS a, {_WORDS}[k // 3 % 3 + 1] AS b, {_WORDS}[k // 9 % 3 + 1] AS c FROM e) SELECT id, CAST({_step('a', 'b')} + {_step('b', 'c')} AS BIGINT) AS points, CAST(CASE WHEN k * 3 <= 90 THEN 20 WHEN k * 3 < 120 THEN 15 WHEN k * 3 < 150 THEN 10 WHEN k * 3 < 200 THEN 5 ELSE 0 END AS BIGINT) AS work FROM m",
    "pg_array_text": "SELECT p_partkey, '{' || replace(p_name, ' ', ',') || '}' AS text, string_split(p_name, ' ') AS parts FROM part",
    "merge_same_speaker": _F + ", m AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY session_id ORDER BY seq, pos) THEN 1 ELSE 0 END AS c FROM g), n AS (SELECT *, CAST(sum(c) OVER (PARTITION BY session_id ORDER BY seq, pos) AS BIGINT) AS turn FROM m) SELECT session_id, turn, min(speaker) AS speaker, string_agg(message, ' ' ORDER BY seq, pos) AS message FROM n GROUP BY session_id, turn",
    "recent_context": f"WITH {_U}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM u) SELECT session_id, seq, speaker, message FROM r WHERE n <= 10",
    "fragment_batches": _F + ", r AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) - 1) // 3 AS batch FROM g) SELECT session_id, seq, pos, batch, CASE WHEN count(*) OVER (PARTITION BY session_id, batch) = 1 THEN 'agent' ELSE speaker END AS speaker FROM r",
    "overlap_batches": _F + ", r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) - 1 AS place FROM g) SELECT session_id, unnest(range(place // 6, (place + 2) // 6 + 1)) AS batch, place FROM r",
    "format_dialogue": f"WITH {_U} SELECT session_id, string_agg(speaker || ': ' || message, chr(10) ORDER BY seq) AS dialogue FROM u GROUP BY session_id",
    "dialogue_refine_join": f"WITH {_U} SELECT session_id, seq, speaker, CASE WHEN seq % 4 = 2 THEN reverse(message) ELSE message END AS message FROM u",
    "correction_summary": _PAIRS + " SELECT count(*) AS utterances, count(*) FILTER (before <> after) AS changed, CAST(round(count(*) FILTER (before <> after) * 100.0 / count(*), 6) AS DOUBLE) AS percent FROM p",
    "style_sample": f"WITH {_U}, n AS (SELECT count(*) AS n FROM u WHERE length(message) >= 4) SELECT plain, CASE WHEN plain THEN n - least(n, 300) ELSE least(n, 300) END AS n FROM n, (VALUES (true), (false)) AS v(plain) WHERE NOT plain OR n > 300",
}
