"""The sentence of a query's guides that a spoken answer rests on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as T


# Results depend on them. Patterns of sentences that no answer rests on, and what is said without one.
@dataclass
class GroundingRules:
    enumeration: str = r"^\s*([0-9]+[).]|[①②③④⑤⑥⑦⑧⑨]|[-•]\s+)\s*"
    title: str = r"^(제\d+조.*|.*안내$|.*방법$|.*세부사항$)$"
    question: str = r"(하셨나요|하셨습니까|되었나요|되셨나요)\?$"
    noise: str = r"(문의하신|확인해볼게요|안내해\s*드릴게요|안내\s*도와드릴게요|이렇게\s.*(하세요|해요)|예방하세요|피해\s*예방|참고해\s*주세요|문의해\s*주세요)"
    legal: str = r"(약관|조문|규정|제\d+조|제\d+항|제\d+호)"
    private: str = r"(전화번호|연락처|주소|계좌|카드번호|비밀번호|주민|생년월일|인증번호|CVC|CVV|유효기간)"
    general: str = r"^.*(가능합니다|입니다|됩니다)\.?$"
    link: str = r"(https?://\S+|www\.\S+|\S+\.(com|kr)\b)"
    phone: str = r"\b\d{2,4}\s*[-–—]\s*\d{3,4}\s*[-–—]\s*\d{4}\b|\b\d{8,11}\b"
    by_title: tuple[str, str] = ("관련 안내는 '", "' 기준으로 진행하시면 됩니다.")
    default: str = "문서 안내 기준에 따라 순서대로 진행하시면 됩니다."


def _hit(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?Ui)" + pattern))


def sentence_scores(snippet: Column, keywords: Column, rules: GroundingRules) -> Column:
    """array<struct<score, sentence>> of the usable sentences of eight characters or more, in order: a point a keyword, one
    less for a question, one less for a short general statement."""
    bare = lambda s: T.strip(F.regexp_replace(T.strip(s), "(?U)" + rules.enumeration, ""))
    parts = F.filter(F.transform(F.split(snippet, r"(?U)(?<=[.!?])\s+|\n+"), bare), lambda s: F.length(s) >= 8)
    bad = lambda s: F.rlike(s, F.lit("(?U)" + rules.title)) | _hit(s, rules.question) | _hit(s, rules.noise) | (_hit(s, rules.legal) & (F.length(s) < 45)) | _hit(s, rules.private)
    held = lambda s: F.size(F.filter(keywords, lambda k: (k != "") & F.contains(s, k)))
    less = lambda s: F.when(F.endswith(s, F.lit("?")), 1).otherwise(0) + F.when(F.rlike(s, F.lit(rules.general)) & (F.length(s) < 25), 1).otherwise(0)
    return F.transform(F.filter(parts, lambda s: ~bad(s)), lambda s: F.struct((held(s) - less(s)).alias("score"), s.alias("sentence")))


def redacted(text: Column, phone: Column, rules: GroundingRules) -> Column:
    out = F.regexp_replace(text, "(?Ui)" + rules.link, "")
    out = F.when(phone, out).otherwise(F.regexp_replace(out, "(?U)" + rules.phone, ""))
    return T.strip(F.regexp_replace(T.strip(F.regexp_replace(out, r"(?U)\s{2,}", " ")), r"(?U)\(\s*\)", ""))


def grounding_sentence(rows: DataFrame, rules: GroundingRules | None = None, docs: int = 3, characters: int = 420) -> DataFrame:
    """query_id, sentence. rows: query_id, rank (from 1), title, content, keywords, phone (numbers may be said).

    The first `docs` guides count, with their first `characters` characters. In each, the first sentence of two points or
    more wins, of several guides the last one's; else the first of the best sentences of zero points or more; else a
    sentence with the first title; else a fixed one. Links and numbers are removed from what is chosen. Nulls count as empty
    and false; an empty table gives no rows. A query's guides are cut to `docs` before they are gathered, so groups are small."""
    rules = rules or GroundingRules()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words, phone = F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("phone", F.lit(False))
    snippet = T.strip(F.substring(T.strip(text("content")), 1, characters))
    guides = rows.filter(F.col("rank") <= docs).select("query_id", "rank", phone.alias("phone"), T.strip(text("title")).alias("title"), sentence_scores(snippet, words, rules).alias("scored"))
    found = guides.groupBy("query_id").agg(F.bool_or("phone").alias("phone"), F.array_sort(F.collect_list(F.struct("rank", "title", "scored"))).alias("guides"))
    firsts = F.transform("guides", lambda g: F.get(F.filter(g["scored"], lambda s: s["score"] >= 2), F.lit(0)))
    strong = F.try_element_at(F.filter(firsts, lambda s: s.isNotNull()), F.lit(-1))
    every = F.filter(F.flatten(F.transform("guides", lambda g: g["scored"])), lambda s: s["score"] >= 0)
    best = F.array_max(F.transform(every, lambda s: s["score"]))
    weak = F.get(F.filter(every, lambda s: s["score"] == best), F.lit(0))
    titles = F.filter(F.transform("guides", lambda g: redacted(g["title"], F.col("phone"), rules)), lambda t: t != "")
    named = F.concat(F.lit(rules.by_title[0]), F.get(titles, F.lit(0)), F.lit(rules.by_title[1]))
    chosen = redacted(F.coalesce(strong, weak)["sentence"], F.col("phone"), rules)
    return found.select("query_id", F.coalesce(chosen, named, F.lit(rules.default)).alias("sentence"))
