"""Queries of document filters, staged lookup, snippets and error spans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import filters, transcripts
from callweave.sources import bindings as b


def _guides(s, d):
    """Documents with the metadata that filters read; every fourth names a card."""
    return b.guide_documents(s, d).select("id", "title", "content", "category", F.col("category").alias("category1"), F.col("document_type").alias("category2"), F.when(F.col("id") % 4 == 0, F.col("title")).alias("card_name"))


def _cards(s, d):
    return b.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("card_name"), F.concat_ws(" ", "p_brand", "p_name").alias("title"), F.col("p_type").alias("content"))


def _candidates(s, d):
    """One lookup for each of the stages."""
    asked = {"equal": (["brand #11", "small ring"], ["eco"], False), "holds": (["ll ri"], ["nothing so"], False), "terms": (["no such"], ["small"], False), "none": (["no such"], ["small"], True)}
    out = None
    for label, (names, terms, require) in asked.items():
        part = filters.card_candidates(_cards(s, d), names, terms, require).select(F.lit(label).alias("lookup"), "id", F.col("stage").cast("long").alias("stage"))
        out = part if out is None else out.unionByName(part)
    return out


def _snippets(s, d):
    docs = b.guide_documents(s, d).select("id", F.replace("content", F.lit(". "), F.lit(".\n\n")).alias("content"))
    return filters.relevant_snippets(docs, F.array(F.lit("water"), F.lit("wasser"), F.lit("agua"))).select("id", F.md5("snippet").alias("snippet"))


def _spans(s, d):
    rows = b.utterances(s, d)
    guess = rows.withColumn("kind", F.lit("predicted")).withColumn("speaker", F.when(F.col("seq") % 5 == 0, "agent").otherwise(F.col("speaker")))
    return transcripts.longest_error_spans(rows.withColumn("kind", F.lit("truth")).unionByName(guess))


QUERIES = {
    "guide_filter": lambda s, d: _guides(s, d).filter(filters.guide_filter(category2=["en", "de"], exclude_terms=["HTTP"], exclude_patterns=["%lorem_ipsum%"], terms=["And ", " und"], not_card_specific=True)).select("id"),
    "guide_phone_filter": lambda s, d: _guides(s, d).filter(filters.guide_filter(id_prefix="1", phone=True, phone_terms=["+", "MAIL", "55"])).select("id"),
    "card_filter": lambda s, d: _guides(s, d).filter(filters.card_filter(names=["the", "e r"])).select("id").unionByName(_guides(s, d).filter(filters.card_filter(categories=["E"], payments=["pay", "zahl"])).select("id")),
    "card_candidates": _candidates,
    "relevant_snippets": _snippets,
    "longest_error_spans": _spans,
}

_CARDS = "WITH c AS (SELECT p_partkey AS id, p_name AS name, p_brand AS card_name, p_brand || ' ' || p_name AS title, p_type AS content FROM part)"
_CUT = "regexp_replace(regexp_replace(text, '(?ims)^[ \\t]*#\\s*(" + "|".join(filters.CUT_SECTIONS) + ").*', '', 'g'), '(?m)^.*((" + "|".join(filters.CONTACT_WORDS) + ")\\s*[:：]?\\s*" + filters.PHONE_NUMBER + "|\\b" + filters.PHONE_NUMBER + "\\b).*$\\n?', '', 'g')"

ORACLE_SQL = {
    "guide_filter": "SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'de') AND NOT (text[1:40] ILIKE '%http%' OR text ILIKE '%http%') AND NOT (text ILIKE '%lorem_ipsum%') AND (text ILIKE '%and %' OR text ILIKE '% und%') AND (doc_id % 4 <> 0 OR coalesce(text[1:40], '') = '')",
    "guide_phone_filter": "SELECT doc_id AS id FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '1%' AND (contains(text, '+') OR text ILIKE '%mail%' OR contains(text, '55'))",
    "card_filter": "SELECT doc_id AS id FROM documents WHERE doc_id % 4 = 0 AND (replace(text[1:40], ' ', '') ILIKE '%the%' OR replace(text[1:40], ' ', '') ILIKE '%er%' OR text[1:40] ILIKE '%the%' OR text[1:40] ILIKE '%e r%') UNION ALL SELECT doc_id FROM documents WHERE (source ILIKE '%e%' OR lang ILIKE '%e%') AND (text ILIKE '%pay%' OR text ILIKE '%zahl%')",
    "card_candidates": _CARDS + ", e AS (SELECT *, content ILIKE '%eco%' AS told FROM (SELECT * FROM c WHERE lower(replace(card_name, ' ', '')) IN ('brand#11', 'smallring') OR lower(replace(name, ' ', '')) IN ('brand#11', 'smallring') OR starts_with(name, 'small ring') ORDER BY id LIMIT 20)), h AS (SELECT * FROM c WHERE name ILIKE '%ll ri%' OR replace(name, ' ', '') ILIKE '%llri%' ORDER BY id LIMIT 5), t AS (SELECT * FROM c WHERE content ILIKE '%small%' ORDER BY id LIMIT 5) SELECT 'equal' AS lookup, id, 1 AS stage FROM (SELECT id FROM e WHERE told OR NOT (SELECT bool_or(told) FROM e) ORDER BY id LIMIT 5) UNION ALL SELECT 'holds', id, 2 FROM h UNION ALL SELECT 'terms', id, 3 FROM t",
    "relevant_snippets": "WITH d AS (SELECT doc_id AS id, coalesce(replace(text, '. ', '.' || chr(10) || chr(10)), '') AS text FROM documents), x AS (SELECT id, trim(" + _CUT + ", ' ') AS t FROM d), p AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id, list_filter(list_transform(string_split_regex(t, '\\n{2,}'), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '') AS ps FROM x)), h AS (SELECT *, regexp_matches(regexp_replace(lower(p), '[\\s\\-_/]+', '', 'g'), 'water|wasser|agua') AS hit FROM p), n AS (SELECT * FROM (SELECT *, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS near FROM h WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE near), r AS (SELECT *, sum(length(p) + 1) OVER (PARTITION BY id ORDER BY i) AS upto, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM n), g AS (SELECT id, string_agg(p, chr(10) ORDER BY i) AS s FROM r WHERE k = 1 OR upto <= 280 GROUP BY id), o AS (SELECT id, coalesce(s, t) AS s, CASE WHEN s IS NULL THEN 420 ELSE 280 END AS n FROM x LEFT JOIN g USING (id)) SELECT id, md5(CASE WHEN length(s) > n THEN regexp_replace(s[1:n], '\\s+$', '') || '...' ELSE s END) AS snippet FROM o",
}
