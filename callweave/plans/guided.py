"""Queries of guidance gates, live transcripts and load checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave.functions import routing as R
from callweave.operators import checks, grounding, guidance
from callweave.plans.search import stream_query
from callweave.plans.texts import _batches, _F, _U
from callweave.sources import bindings as b
from callweave.streaming import live

# Parts' names are two invented words, so the tables' words are some of them.
TAGS = {"cold": ["cold", "blue"], "big": ["large", "new"], "tool": ["gear", "bolt"], "phone": ["rod"]}
CORE = {"cold": ["cold"], "tool": ["bolt", "ring"], "phone": ["anvil"]}
BRANDS = ["hot", "red", "brand#1"]


def _guides(s, d):
    part = b.table(s, d, "part")
    k = F.col("p_partkey")
    intents = F.when(k % 100 == 0, F.array(F.lit("Big"), F.lit(" "), F.lit("plate"))).when(k % 150 == 0, F.array(F.lit("widget")))
    asked = part.filter("p_partkey % 50 = 0").select(k.alias("query_id"), "p_size", F.concat_ws(" ", "p_name", "p_brand").alias("query"), F.split("p_name", " ").alias("terms"), intents.alias("intents"), (k % 350 == 0).alias("phone"))
    guides = part.select(k.alias("id"), "p_size", F.col("p_name").alias("title"), F.col("p_type").alias("tag_text"), F.col("p_brand").alias("content"), F.when(k % 40 == 7, k % 3).alias("pin_rank"), (k % 5 - 1).cast("double").alias("score"))
    return asked, guides, ["p_size"]


def _gates(s, d):
    return guidance.guidance_gates_on(*_guides(s, d), tags=TAGS, core=CORE, brands=BRANDS)


def _ends(rows, *order):
    """rows with ts in order, and `last` on the last row of a session."""
    down = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in order])
    at = F.timestamp_seconds(F.col(order[0]) * 60 + 1_704_067_200)  # from 2024 on: the first watermark, 1970, makes rows of that time late
    return rows.withColumn("ts", at).withColumn("last", F.row_number().over(down) == 1)


# Patterns that the tables' invented prose holds, so that every rule takes effect.
RULES = grounding.GroundingRules(title=r"^(Th.*|.*ung\.)$", question=r"(en|on)\?$", noise="(schl|ción)", legal="(der|los) ", private="(quel|ther) ", general=r"^.*(ent|es|en)\.?$", link=r"\S+\.(com|kr)\b", by_title=("see '", "'."), default="none")
KEYWORDS = ["the", "der", "que", "en", "es "]


def _sentences(s, d):
    """Every three documents are a query's guides; the fourth query of each ten may say telephone numbers."""
    k = F.col("doc_id")
    query = F.floor(k / 3)
    rows = b.table(s, d, "documents").select(query.alias("query_id"), (k % 3 + 1).alias("rank"), F.substring("text", 1, 12).alias("title"), F.when(k % 7 > 0, F.col("text")).alias("content"), F.when(query % 4 > 0, F.array(*map(F.lit, KEYWORDS))).alias("keywords"), (query % 10 == 4).alias("phone"))
    return grounding.grounding_sentence(rows, RULES)


FIXES = {"the": "teh", "there": "thar", "und": "unt"}
SPOKEN = dict(cards={"Gold": ["ing teh"], "Blue Sky": ["ere a"]}, actions=["and", "on", "que", "unt"], payments={"Pay": ["ed a"], "Cash": ["de l"]}, intents={"limit": ["die", "los"], "fee": ["les"], "on": ["an"]}, patterns={"shout": "!!", "and": "and teh"}, stop=["on"])


def _spoken(s, d):
    rows = b.utterances(s, d).select("session_id", "seq", R.extract_keywords(F.col("message"), FIXES, **SPOKEN).alias("k"))
    return rows.select("session_id", "seq", *[f"k.{c}" for c in ("cards", "actions", "payments", "intents", "query")], F.length("k.corrected").cast("long").alias("characters"))


QUERIES = {
    "grounding_sentence": _sentences,
    "extract_keywords": _spoken,
    "guidance_gates": _gates,
    "guidance_documents": lambda s, d: guidance.guidance_documents_on(*_guides(s, d), tags=TAGS, core=CORE, brands=BRANDS),
    "stream_fragments": stream_query(live.fragment_batches, lambda s, d: _ends(b.fragments(s, d), "seq", "pos").select("session_id", "seq", "pos", "ts", "message", "last")),
    "stream_transcript_merge": stream_query(live.transcript_merge, lambda s, d: _ends(_batches(s, d), "batch", "seq")),
    "skip_if_loaded": lambda s, d: checks.load_states({t: b.table(s, d, t).filter("o_orderkey < 0") if t == "orders" else b.table(s, d, t) for t in ("supplier", "orders", "customer", "events", "nation")}, {"supplier": 10, "nation": 32}, {"customer": F.col("c_name") == "no default"}),
}


def _some(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _tags(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_some(x, terms)} THEN '{tag}' END" for tag, terms in TAGS.items()) + "], lambda v: v IS NOT NULL)"


def _terms(tags: str, table: dict[str, list[str]]) -> str:
    return "list_distinct(flatten([" + ", ".join(f"CASE WHEN list_contains({tags}, '{tag}') THEN {terms} ELSE [] END" for tag, terms in table.items()) + "]))"


def _count(x: str, terms: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains({x}, t)))"


def _steps(flags: list[str]) -> str:
    """CTEs g0, g1, ...: each keeps rows with its flag where a row of the query has it; (flag, among) pairs."""
    out = []
    for i, (flag, among) in enumerate(flags):
        out.append(f"g{i + 1} AS (SELECT * EXCLUDE (h, found) FROM (SELECT *, max(CAST(h AS INT)) OVER (PARTITION BY query_id) AS found FROM (SELECT *, coalesce(({among}) AND ({flag}), false) AS h FROM g{i})) WHERE NOT ({among}) OR h OR found = 0)")
    return ", ".join(out)


_GATES = f"""WITH q0 AS (SELECT p_partkey AS query_id, p_size, lower(p_name || ' ' || p_brand) AS query, string_split(p_name, ' ') AS terms, CASE WHEN p_partkey % 100 = 0 THEN ['big', 'plate'] WHEN p_partkey % 150 = 0 THEN ['widget'] ELSE [] END AS told, p_partkey % 350 = 0 AS phone FROM part WHERE p_partkey % 50 = 0),
q1 AS (SELECT *, {_tags('query')} AS own, list_filter({BRANDS}, lambda x: contains(query, x)) AS brands FROM q0),
q2 AS (SELECT *, CASE WHEN phone THEN list_distinct(list_append(own, 'phone')) ELSE own END AS asked FROM q1),
q3 AS (SELECT *, {_terms('asked', CORE)} AS core, list_distinct(list_concat(list_concat({_terms('told', TAGS)}, list_filter(told, lambda x: NOT list_contains({list(TAGS)}, x))), {_terms('own', TAGS)})) AS intent FROM q2),
g0 AS (SELECT query_id, p_partkey AS id, lower(p_name) AS title, lower(p_name || ' ' || p_type) AS tagged, lower(p_name || ' ' || p_type || ' ' || p_brand) AS everything, CASE WHEN p_partkey % 40 = 7 THEN p_partkey % 3 END AS pin_rank, CAST(p_partkey % 5 - 1 AS DOUBLE) AS score, asked, core, brands, intent, list_distinct(list_concat(terms, intent)) AS words FROM part JOIN q3 USING (p_size)),
""" + _steps(
    [
        (f"len(asked) = 0 OR list_has_any({_tags('tagged')}, asked)", "true"),
        (f"len(core) = 0 OR {_count('title', 'core')} > 0", "true"),
        (f"CASE WHEN len(brands) > 0 THEN {_count('everything', 'brands')} > 0 ELSE NOT {_some('everything', BRANDS)} END", "true"),
        (f"{_count('title', 'intent')} > 0", "true"),
        (f"{_count('everything', 'intent')} > 0", "pin_rank IS NULL"),
        (f"{_count('everything', 'words')} > 0", "pin_rank IS NULL"),
        ("score >= 0", "pin_rank IS NULL"),
    ]
) + f", o AS (SELECT query_id, id, pin_rank, CAST({_count('everything', 'words')} AS BIGINT) AS hits, score, {_count('title', 'brands')} > 0 AS entity FROM g7)"

def _re(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}', 'i')"


_STRIP = r"'^\s+|\s+$', '', 'g'"
_SENTENCES = rf"""WITH d AS (SELECT doc_id // 3 AS query_id, doc_id % 3 AS rank, regexp_replace(text[1:12], {_STRIP}) AS title, regexp_replace(regexp_replace(CASE WHEN doc_id % 7 > 0 THEN text ELSE '' END, {_STRIP})[1:420], {_STRIP}) AS snippet FROM documents),
p AS (SELECT query_id, rank, string_split(regexp_replace(snippet, '([.!?])\s+|\n+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d),
u AS (SELECT query_id, rank, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM p),
s AS (SELECT query_id, rank, pos, regexp_replace(regexp_replace(regexp_replace(raw, {_STRIP}), '^\s*([0-9]+[).]|[①②③④⑤⑥⑦⑧⑨]|[-•]\s+)\s*', ''), {_STRIP}) AS s FROM u),
g AS (SELECT *, CASE WHEN query_id % 4 > 0 THEN {" + ".join(f"CAST(contains(s, '{k}') AS INT)" for k in KEYWORDS)} ELSE 0 END - CAST(s LIKE '%?' AS INT) - CAST(regexp_matches(s, '{RULES.general}') AND length(s) < 25 AS INT) AS score FROM s
 WHERE length(s) >= 8 AND NOT regexp_matches(s, '{RULES.title}') AND NOT {_re('s', RULES.question)} AND NOT {_re('s', RULES.noise)} AND NOT ({_re('s', RULES.legal)} AND length(s) < 45) AND NOT {_re('s', RULES.private)}),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY pos) AS n FROM g WHERE score >= 2),
b AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS n FROM a WHERE n = 1),
c AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS n FROM g WHERE score >= 0),
t AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM d WHERE title <> ''),
o AS (SELECT q.query_id, coalesce(b.s, c.s) AS s, title FROM (SELECT DISTINCT query_id FROM d) q LEFT JOIN b ON b.query_id = q.query_id AND b.n = 1 LEFT JOIN c ON c.query_id = q.query_id AND c.n = 1 LEFT JOIN t ON t.query_id = q.query_id AND t.n = 1),
w AS (SELECT query_id, title, regexp_replace(s, '\S+\.(com|kr)\b', '', 'gi') AS s FROM o),
x AS (SELECT query_id, title, CASE WHEN query_id % 10 = 4 THEN s ELSE regexp_replace(s, '\b\d{{2,4}}\s*[-–—]\s*\d{{3,4}}\s*[-–—]\s*\d{{4}}\b|\b\d{{8,11}}\b', '', 'g') END AS s FROM w)
SELECT query_id, coalesce(regexp_replace(regexp_replace(regexp_replace(s, '\s{{2,}}', ' ', 'g'), '\(\s*\)', '', 'g'), {_STRIP}), 'see ' || chr(39) || title || chr(39) || '.', 'none') AS sentence FROM x"""


def _firsts(x: str) -> str:
    return f"list_filter({x}, lambda v, nth: v IS NOT NULL AND list_position({x}, v) = nth)"


_SPOKEN = rf"""WITH {_U}, f AS (SELECT session_id, seq, replace(replace(replace(message, 'there', 'thar'), 'the', 'teh'), 'und', 'unt') AS m FROM u),
w AS (SELECT *, list_filter(regexp_split_to_array(m, '\s+'), lambda t: t <> '') AS w, replace(lower(m), ' ', '') AS tight FROM f),
h AS (SELECT session_id, seq, length(m) AS characters,
 list_filter([CASE WHEN contains(lower(m), 'gold') OR contains(lower(m), 'ing teh') OR contains(tight, 'gold') OR contains(tight, 'ingteh') THEN 'Gold' END, CASE WHEN contains(lower(m), 'blue sky') OR contains(lower(m), 'ere a') OR contains(tight, 'bluesky') OR contains(tight, 'erea') THEN 'Blue Sky' END], lambda v: v IS NOT NULL) AS cards,
 list_concat(list_filter(w, lambda t: t IN ('and', 'que', 'unt')), [CASE WHEN contains(m, '!!') THEN 'shout' END, CASE WHEN contains(m, 'and teh') THEN 'and' END]) AS a,
 list_filter([CASE WHEN contains(tight, 'pay') OR contains(tight, 'eda') THEN 'Pay' END, CASE WHEN contains(tight, 'cash') OR contains(tight, 'del') THEN 'Cash' END], lambda v: v IS NOT NULL) AS payments,
 list_transform(w, lambda t: CASE WHEN t IN ('limit', 'die', 'los') THEN 'limit' WHEN t IN ('fee', 'les') THEN 'fee' END) AS i FROM w),
k AS (SELECT session_id, seq, cards, {_firsts('a')} AS actions, payments, {_firsts('i')} AS intents, characters FROM h), j AS (SELECT *, list_concat(cards, list_concat(actions, intents)) AS j FROM k)
SELECT session_id, seq, cards, actions, payments, intents, coalesce(array_to_string({_firsts('j')}, ' '), '') AS query, characters FROM j"""

ORACLE_SQL = {
    "grounding_sentence": _SENTENCES,
    "extract_keywords": _SPOKEN,
    "guidance_gates": _GATES + " SELECT * FROM o",
    "guidance_documents": _GATES + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pin_rank NULLS LAST, hits DESC, score DESC, id) AS place FROM o), k AS (SELECT *, max(CAST(score > 0 OR entity AS INT)) OVER (PARTITION BY query_id) AS found FROM r WHERE place <= 4) SELECT query_id, id, hits, place FROM k WHERE score > 0 OR entity OR found = 0",
    "stream_fragments": _F + ", r AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) - 1) // 3 AS batch FROM g) SELECT session_id, batch, count(*) AS n, CASE WHEN count(*) = 1 THEN 'agent' END AS speaker, string_agg(message, ' ' ORDER BY seq, pos) AS message FROM r GROUP BY session_id, batch",
    "skip_if_loaded": "SELECT 'supplier' AS name, count(*) AS rows, count(*) >= 10 AS skip FROM supplier UNION ALL SELECT 'orders', 0, false UNION ALL SELECT 'customer', count(*), false FROM customer UNION ALL SELECT 'events', count(*), count(*) > 0 FROM events UNION ALL SELECT 'nation', count(*), count(*) >= 25.6 FROM nation",
}
