"""Which documents a search reads: filters of guides and cards, staged card lookup, and the paragraphs that answer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Terms that a question for a telephone number looks for.
PHONE_TERMS = ["전화", "전화번호", "고객센터", "콜센터", "ars", "대표번호", "연락처", "문의", "상담원", "번호"]
# Headings after which a document says nothing about its own subject.
CUT_SECTIONS = [r"금융소비자\s*보호제도\s*안내", r"기타\s*안내", r"해외이용\s*확인사항", r"연회비\s*반환\s*기준"]
# Words before a number, and the number, of lines with contacts.
CONTACT_WORDS = ["고객센터", "콜센터", "센터", "문의", "연락처"]
PHONE_NUMBER = r"\d{2,4}-\d{3,4}-\d{4}"


def like_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """A column holds a term, whatever the case; % and _ of a term stand for themselves. No terms: false."""
    each = [F.contains(F.lower(c), F.lower(F.lit(t))) for t in terms for c in columns]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _common(id_prefix: str | None, category1: Sequence[str], category2: Sequence[str]) -> list[Column]:
    parts = [F.startswith(F.col("id").cast("string"), F.lit(id_prefix))] if id_prefix else []
    return parts + [F.col(c).isin(*values) for c, values in (("category1", category1), ("category2", category2)) if values]


def guide_filter(id_prefix: str | None = None, category1: Sequence[str] = (), category2: Sequence[str] = (), exclude_terms: Sequence[str] = (), exclude_patterns: Sequence[str] = (), phone: bool = False, phone_terms: Sequence[str] = PHONE_TERMS, terms: Sequence[str] = (), not_card_specific: bool = False) -> Column:
    """All of the given conditions on id, title, content, category1, category2 and card_name. exclude_patterns are ILIKE
    patterns. As in SQL, a row whose title is null is not known to be free of an excluded term, and goes."""
    parts = _common(id_prefix, category1, category2)
    if exclude_terms:
        parts.append(~like_any(["title", "content"], exclude_terms))
    if exclude_patterns:
        parts.append(~reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(p) for p in exclude_patterns for c in ("content", "title", "id")]))
    if phone:
        parts.append(like_any(["content", "title"], phone_terms))
    if terms:
        parts.append(like_any(["content", "title"], terms))
    if not_card_specific:
        parts.append(F.coalesce("card_name", F.lit("")) == "")
    return _all(parts)


def card_filter(id_prefix: str | None = None, category1: Sequence[str] = (), category2: Sequence[str] = (), categories: Sequence[str] = (), names: Sequence[str] = (), payments: Sequence[str] = (), intents: Sequence[str] = ()) -> Column:
    """All of the given conditions. Names go before payments: these count only without names, and only beside an intent or
    a category, since a payment alone says nothing of the card."""
    parts = _common(id_prefix, category1, category2)
    if categories:
        parts.append(like_any(["category", "category1", "category2"], categories))
    if names:
        bare = [n.replace(" ", "") for n in names]
        parts.append(reduce(lambda a, b: a | b, [F.contains(F.lower(F.replace(F.col("card_name"), F.lit(" "), F.lit(""))), F.lit(n.lower())) for n in bare]) | like_any(["card_name"], names))
    elif payments and (intents or category1 or category2 or categories):
        parts.append(like_any(["content", "title"], payments))
    return _all(parts)


def card_candidates(cards: DataFrame, names: Sequence[str], terms: Sequence[str] = (), require_name: bool = False, most: int = 20, limit: int = 5) -> DataFrame:
    """cards (id, name, card_name, title, content and others) that the names mean, with `stage`, at most `limit` by id.

    Stage 1: an equal name without spaces, or a name that begins so; stage 2, if none: a name that holds one; stage 3, if
    none again and no name is required: content that holds a term. Of the first `most` of stage 1 or 2 those whose content
    holds a term, or all where none does. Only `most` rows leave the tasks, as the first by (stage, id)."""
    labels = ["card_name", "name", "title"]
    bare = [n.replace(" ", "") for n in names]
    spaceless = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    some = lambda parts: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False)), F.lit(False))
    equal = some([spaceless(c).isin([n.lower() for n in bare]) for c in labels[:2] if bare] + [F.startswith(c, F.lit(n)) for c in labels for n in names])
    holds = some([F.contains(spaceless(c), F.lit(n.lower())) for c in labels[:2] for n in bare] + [F.contains(F.lower(c), F.lower(F.lit(n))) for c in labels for n in names])
    told = some([F.contains(F.lower("content"), F.lower(F.lit(t))) for t in terms])
    stage = F.when(equal, 1).when(holds, 2)
    if not require_name and names:
        stage = stage.when(told, 3)
    first = cards.withColumn("stage", stage).filter("stage IS NOT NULL").orderBy("stage", "id").limit(most)
    chosen = Window.partitionBy(F.lit(1))  # over `most` rows
    first = first.withColumn("__told", told).withColumn("__best", F.min("stage").over(chosen)).filter("stage = __best").withColumn("__any", F.max("__told").over(chosen))
    return first.filter("__told OR NOT __any").orderBy("id").limit(limit).drop("__told", "__best", "__any")


def relevant_snippets(rows: DataFrame, terms: Column, limit: int = 280, fallback: int = 420) -> DataFrame:
    """rows (id, content and others) with `snippet`: the paragraphs that hold a term and their neighbours, as far as they
    fit in `limit` characters (the first always, cut); the content's first `fallback` characters if none does, its first
    `limit` without terms; what is cut ends in three dots. Sections after fixed headings and lines with telephone numbers are left out; paragraphs end at
    blank lines. Null content gives an empty snippet."""
    cut = r"(?ims)^[ \t]*#\s*(" + "|".join(CUT_SECTIONS) + r").*"
    contact = r"(?m)^.*((" + "|".join(CONTACT_WORDS) + r")\s*[:：]?\s*" + PHONE_NUMBER + r"|\b" + PHONE_NUMBER + r"\b).*$\n?"
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), cut, ""), contact, ""))
    once = lambda df, name, value: df.select("*", F.inline(F.array(F.struct(value.alias(name)))))  # noqa: E731 - a lambda that names it doesn't work it out again
    rows = once(once(rows, "__text", clean), "__terms", F.transform(terms, F.lower))
    paragraphs = F.filter(F.transform(F.split("__text", r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = once(rows, "__paragraphs", paragraphs)
    rows = once(rows, "__hits", F.transform("__paragraphs", lambda p: F.exists("__terms", lambda t: F.contains(F.regexp_replace(F.lower(p), r"[\s\-_/]+", ""), t))))
    near = lambda i: reduce(lambda a, b: a | b, [F.coalesce(F.get("__hits", i + d), F.lit(False)) for d in (-1, 0, 1)])
    rows = once(rows, "__near", F.filter("__paragraphs", lambda p, i: near(i)))
    shortened = lambda c, n: F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), r"\s+$", ""), F.lit("..."))).otherwise(c)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("total"))

    def step(acc, p):
        total = acc["total"] + F.length(p) + 1
        fits = (acc["total"] == 0) | (total <= limit)
        text = F.when(acc["total"] == 0, p).otherwise(F.concat(acc["text"], F.lit("\n"), p))
        return F.struct(F.when(fits, text).otherwise(acc["text"]).alias("text"), total.alias("total"))

    joined = F.aggregate("__near", start, step, lambda acc: shortened(acc["text"], limit))
    snippet = F.when(F.coalesce(F.size("__terms"), F.lit(0)) <= 0, shortened(F.col("__text"), limit)).when(F.size("__near") == 0, shortened(F.col("__text"), fallback)).otherwise(joined)
    return rows.withColumn("snippet", snippet).drop("__text", "__terms", "__paragraphs", "__hits", "__near")
