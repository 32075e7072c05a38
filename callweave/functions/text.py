"""Column functions for conforming, normalising and classifying call-centre text. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
MASK_REPLACEMENTS = {
    "[카드사명#1]": "테디카드",
    "[카드사명#2]": "테디카드",
    "[서비스명#1]": "테디페이",
    "[서비스명#2]": "테디페이",
    "[페이서비스#1]": "테디페이",
}
CATEGORY_RULES = {
    "가상 계좌": "가상계좌",
    "이용 내역": "이용내역",
    "결제 계좌": "결제계좌",
    "결제 일": "결제일",
    "도난/분실": "분실/도난",
}
MAIN_TERMS = {
    "분실/도난": ["분실", "도난"],
    "한도": ["한도"],
    "결제/승인": ["결제", "승인", "매출", "즉시출금", "선결제", "가상계좌"],
    "이용내역": ["이용내역"],
    "수수료/연체": ["연체", "수수료", "연회비"],
    "포인트/혜택": ["포인트", "혜택", "이벤트", "마일리지"],
    "정부지원": ["바우처", "정부지원"],
}
SUB_TERMS = {
    "조회/안내": ["안내", "조회"],
    "신청/등록": ["신청", "등록"],
    "변경": ["변경"],
    "취소/해지": ["취소", "해지"],
    "처리/실행": ["처리", "실행"],
    "발급": ["발급"],
    "확인서": ["확인서", "증명서", "소득공제"],
    "배송": ["배송", "재발송", "수령지"],
    "즉시출금": ["즉시출금"],
    "상향/증액": ["상향", "증액", "임시한도", "특별한도"],
    "이체/전환": ["전환", "이체"],
    "환급/반환": ["환급", "반환"],
    "정지/해제": ["정지", "해제", "신고"],
    "결제일": ["결제일"],
}
OTHER = "기타"
ANSWER_CLASSES = {
    "TROUBLESHOOTING": ["오류", "안돼", "안됨", "실패", "결제", "승인", "등록", "연동"],
    "PROCEDURE_STEPS": ["분실", "도난", "재발급", "해지", "발급", "신청"],
    "FEE_INTEREST": ["연회비", "수수료", "이자", "연체", "요율", "금리"],
    "ELIGIBILITY": ["조건", "대상", "가능", "자격", "제한"],
    "BENEFIT_SUMMARY": ["혜택", "할인", "적립", "포인트", "캐시백"],
    "DEFINITION": ["무엇", "뭐", "의미", "설명", "정의"],
}
DOMAIN_TERMS = ["분실", "도난", "재발급", "해지", "발급", "신청", "연회비", "혜택", "수수료", "이자", "결제", "승인", "오류", "안돼", "안됨", "한도", "청구", "할부", "포인트", "적립", "카드", "등록", "연동", "고객센터", "전화번호"]
ACKNOWLEDGEMENT = "^(네|아니요|아뇨|응|어|음|흠|하|헉|헐|ㅋㅋ+|ㅎㅎ+|ㄷㄷ+|오케이|ok|okay)$"
PARTICLES = ["으로", "에서", "에게", "로", "와", "과", "은", "는", "이", "가", "을", "를", "에", "도", "만", "요", "죠"]
STOP_TERMS = ["무엇", "무엇인가요", "뭔가요", "뭐야", "뭐에요", "뭐예요", "뭔지", "어떤", "어떻게", "왜", "언제", "어디", "가능", "되나요", "되요", "해주세요", "알려줘", "알려주세요", "알려줘요", "방법", "소개", "정의", "란", "카드"]
ISSUE_TERMS = ["발급", "신청", "재발급", "대상", "서류", "오류", "에러"]
BENEFIT_TERMS = ["적립", "혜택", "할인", "포인트"]
CATEGORY_HINTS = ["발급", "신청", "재발급", "대상", "서류", "적립", "혜택"]
JOINED_HINT = ("발급", "대상", "발급 대상")
PRIORITY_TERMS = {
    "발급": ["발급 대상"],
    "신청": ["발급 대상"],
    "재발급": ["발급 대상"],
    "적립": ["적립 서비스", "일상 생활비 적립", "필수 생활비 적립", "포인트 적립"],
}
ISSUE_FILTER = ["발급", "신청", "재발급", "대상", "서류"]
BENEFIT_FILTER = ["적립", "혜택", "유의", "제외", "포인트", "할인"]
SPEAKERS = {"agent": ["agent", "counselor", "상담사", "상담원"], "customer": ["customer", "client", "손님", "고객"]}
COMPOSITE_ACTIONS = {
    "결제오류": "(결제|승인).*(안|오류|실패|불가)",
    "분실신고": "(카드|분실).*(신고|접수)",
    "한도상향": "(한도).*(상향|올|높)",
    "한도하향": "(한도).*(하향|낮|줄)",
}
SCRIPT_NOISE = ["안녕하세요", "예", "네", "알겠습니다", "수고하십니다", "감사합니다"]
EMOTION_STEPS = {("부정", "중립"): 5, ("부정", "긍정"): 10, ("중립", "긍정"): 10, ("긍정", "중립"): 5}
SOURCE_SCOPES = {
    "guide_merged": ["%_merged"],
    "terms": ["sinhan_terms_%"],
}

STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, STRIP, "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def replace_all(text: Column, rules: dict[str, str]) -> Column:
    """Literal replacements one after another; equal pairs are skipped."""
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), ((a, b) for a, b in rules.items() if a != b and a), text)


def correct_terms(text: Column, rules: dict[str, str], longest_first: bool = True) -> Column:
    ordered = sorted(rules.items(), key=lambda r: -len(r[0])) if longest_first else list(rules.items())
    return replace_all(text, dict(ordered))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def first_with(text: Column, table: dict[str, Sequence[str]], default: str) -> Column:
    """The first key one of whose terms occurs."""
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(key)) for key, terms in table.items()], F.lit(default))


def normalize_category(raw: Column, masks: dict[str, str] = MASK_REPLACEMENTS, rules: dict[str, str] = CATEGORY_RULES) -> Column:
    return F.coalesce(replace_all(replace_all(strip(raw), masks), rules), F.lit(""))


def category_words(raw: Column) -> Column:
    return F.filter(F.split(raw, r"[/\s]+"), lambda x: x != "")


def conform_status(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s.isin("in_progress", "진행중"), "in_progress").when(s.isin("incomplete", "미완료"), "incomplete").otherwise("completed")


def conform_date(text: Column) -> Column:
    """ISO date or datetime, or yyyy.MM.dd; anything else null."""
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(text, 1, 10), "yyyy.MM.dd"))


def seed_of(source_id: Column) -> Column:
    """Last run of digits of an id; without one the md5 of the id modulo 100000, by Horner's rule on 8-digit chunks."""
    digits = F.regexp_extract_all(source_id, F.lit(r"(\d+)"), F.lit(1))
    md5, rest = F.md5(source_id), F.lit(0).cast("long")
    for i in range(4):
        rest = (rest * (2**32 % 100000) + F.conv(F.substring(md5, 8 * i + 1, 8), 16, 10).cast("long")) % 100000
    return F.when(F.size(digits) > 0, F.try_element_at(digits, F.lit(-1)).cast("long")).otherwise(rest)


def call_time_of(seed: Column) -> Column:
    """HH:MM from a seed: working hours, fewer calls at noon."""
    hour = 9 + F.floor(seed / 100) % 9
    early = 9 + F.floor(seed / 1000) % 8
    hour = F.when((hour == 12) & (seed % 100 < 30), F.when(early >= 12, early + 1).otherwise(early)).otherwise(hour)
    return F.format_string("%02d:%02d", hour.cast("long"), (seed % 60).cast("long"))


def weekday_only(day: Column, row: Column, days: Sequence[str]) -> Column:
    """A weekend date becomes days[row % n]."""
    table = F.array(*[F.lit(d).cast("date") for d in days])
    return F.when(F.weekday(day) >= 5, F.get(table, (row % len(days)).cast("int"))).otherwise(day)


def consultation_id(agent: Column, minute: Column) -> Column:
    return F.concat(F.lit("CS-"), F.replace(agent, F.lit("-"), F.lit("")), F.lit("-"), F.date_format(minute, "yyyyMMddHHmm"))


def normalize_query(text: Column) -> Column:
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s\-/.]", "")


def strip_particle(term: Column, particles: Sequence[str] = PARTICLES) -> Column:
    """Without its first matching ending, if two characters or more stay."""
    return F.coalesce(*[F.when(term.endswith(p) & (F.length(term) > len(p) + 1), F.substring(term, F.lit(1), F.length(term) - len(p))) for p in particles], term)


def query_terms(text: Column, stop: Sequence[str] = STOP_TERMS, particles: Sequence[str] = PARTICLES) -> Column:
    """Distinct terms in order: what stands between blanks, without its marks. No stop words, numbers or single characters;
    a final `란` and one ending are removed."""
    words = F.transform(F.split(normalize_query(text), " "), lambda t: F.regexp_replace(t, r"(?U)[^\w]+", ""))
    known = lambda t: (t != "") & ~t.isin(list(stop))
    fine = lambda t: known(t) & (F.length(t) >= 2) & ~t.rlike(r"^\d+$")
    named = F.transform(F.filter(words, known), lambda t: F.when(t.endswith("란") & (F.length(t) > 1), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    return F.array_distinct(F.filter(F.transform(named, lambda t: strip_particle(t, particles)), fine))


def search_mode(text: Column, issue: Sequence[str] = ISSUE_TERMS, benefit: Sequence[str] = BENEFIT_TERMS) -> Column:
    return F.when(contains_any(text, issue), "ISSUE").when(contains_any(text, benefit), "BENEFIT").otherwise("GENERAL")


def category_hints(terms: Column, hints: Sequence[str] = CATEGORY_HINTS, joined: tuple[str, str, str] = JOINED_HINT) -> Column:
    """The hints that terms contain, in order of terms and hints, each once; two certain ones together add a third."""
    held = F.flatten(F.transform(terms, lambda t: F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(t, h))))
    first, second, both = joined
    pair = F.array_contains(held, first) & F.array_contains(held, second)
    return F.array_distinct(F.when(pair, F.array_append(held, F.lit(both))).otherwise(held))


def priority_terms(hints: Column, table: dict[str, Sequence[str]] = PRIORITY_TERMS) -> Column:
    """The search terms that each hint puts first, each once."""
    none = F.array().cast("array<string>")
    found = lambda h: F.coalesce(*[F.when(h == c, F.array(*map(F.lit, terms))) for c, terms in table.items()], none)
    return F.array_distinct(F.flatten(F.transform(hints, found)))


def blocked_by_mode(terms: Column, text: Column, issue: Sequence[str] = ISSUE_FILTER, benefit: Sequence[str] = BENEFIT_FILTER) -> Column:
    """Whether a card's text holds words of the other kind than the query's: benefits for a query with an issue term, else
    issues for one with a benefit term. Without such a term nothing is blocked."""
    asks = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    return F.coalesce(F.when(asks(issue), contains_any(text, benefit)).when(asks(benefit), contains_any(text, issue)), F.lit(False))


def domain_score(text: Column, terms: Sequence[str] = DOMAIN_TERMS, cards: Column | None = None, actions: Column | None = None) -> Column:
    t, c = F.lower(text), F.replace(F.lower(text), F.lit(" "), F.lit(""))
    score = F.size(F.filter(F.array(*map(F.lit, terms)), lambda k: t.contains(k) | c.contains(k))).cast("long")
    if cards is not None:
        score = score + F.when(F.size(cards) > 0, 2).otherwise(0)
    return score + F.when(F.size(actions) > 0, 1).otherwise(0) if actions is not None else score


def search_gate(text: Column, score: Column) -> Column:
    """struct(no_search, retrieval_mode)."""
    t = strip(F.coalesce(text, F.lit("")))
    none = (score == 0) & ((F.length(t) <= 3) | F.lower(t).rlike(ACKNOWLEDGEMENT))
    return F.struct(none.alias("no_search"), F.when(score < 5, "keyword_only").otherwise("hybrid").alias("retrieval_mode"))


def answer_class(text: Column, classes: dict[str, Sequence[str]] = ANSWER_CLASSES, default: str = "BENEFIT_SUMMARY") -> Column:
    """struct(primary, secondary): classes are in order of priority."""
    hits = F.array_compact(F.array(*[F.when(contains_any(F.lower(text), terms), F.lit(name)) for name, terms in classes.items()]))
    return F.struct(F.coalesce(F.get(hits, F.lit(0)), F.lit(default)).alias("primary"), F.slice(hits, 2, len(classes)).alias("secondary"))


def applepay_intent(text: Column, payments: Column) -> Column:
    t = F.lower(text)
    has = contains_any(t, ["애플페이", "apple pay", "applepay", "지갑", "wallet"]) & (F.array_contains(payments, "애플페이") | (F.size(payments) == 0))
    rules = {
        "applepay_add_card": ["등록", "추가", "카드", "지갑"],
        "applepay_payment": ["결제"],
        "applepay_transport": ["티머니", "교통", "충전", "탑승"],
        "applepay_where_to_use": ["사용처", "어디", "가능", "가맹점", "이용처"],
        "applepay_security": ["분실", "도난", "보안", "삭제"],
    }
    return F.when(has, first_with(t, rules, "applepay_general"))


def composite_actions(text: Column, patterns: dict[str, str] = COMPOSITE_ACTIONS) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(a)) for a, p in patterns.items()]))


def clean_utterance(text: Column) -> Column:
    """Without line breaks and start marks of either bracket and any case, single spaces."""
    return collapse(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"(?i)[\[<]?NEW_START[\]>]?", " "))


def speaker_of(name: Column, table: dict[str, Sequence[str]] = SPEAKERS) -> Column:
    """agent or customer by the names each goes by, else null."""
    return F.coalesce(*[F.when(name.isin(list(names)), F.lit(s)) for s, names in table.items()])


def is_spam(text: Column) -> Column:
    """Ten or more characters without spaces, of two kinds at most."""
    t = F.regexp_replace(text, r"(?U)\s", "")
    return (F.length(t) >= 10) & (F.size(F.array_distinct(F.split(t, ""))) <= 2)


def sentences(text: Column, longest: int = 120) -> Column:
    """A short text as it is; a longer one split after sentence marks, pieces over `longest` cut hard."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$)"), F.lit(1)), strip), lambda s: s != "")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / longest).cast("int") - 1), lambda i: F.substring(s, i * longest + 1, F.lit(longest)))
    return F.when(F.length(text) <= longest, F.array(text)).otherwise(F.flatten(F.transform(parts, cut)))


# Results depend on them. Words that begin a contact phrase, names that are left out.
CONTACT_WORDS = ["고객센터", "콜센터", "문의", "연락처"]
LEFT_OUT_NAMES = ["테디카드", "신용정보 알림서비스"]
_DASH = "[-–—‑]"
_WEB = r"(?i)https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|\S+\.(?:com|kr)\b"
_LONG_PHONE = rf"\d{{2,4}}\s*{_DASH}\s*\d{{3,4}}\s*{_DASH}\s*\d{{4}}"
_PHONE = rf"\(\s*{_LONG_PHONE}\s*\)|\b{_LONG_PHONE}\b|\b\d{{2,4}}{_DASH}\d{{4}}\b|\b\d{{8,11}}\b"


def redact(text: Column, keep_phone: bool = False, contacts: Sequence[str] = CONTACT_WORDS, names: Sequence[str] = LEFT_OUT_NAMES) -> Column:
    """Without web and e-mail addresses and the given names; unless phones are asked for, also without telephone numbers
    (any dash, blanks around it, in brackets), runs of 8 to 11 digits, and contact phrases up to the end of their line."""
    out = F.regexp_replace(text, _WEB, "")
    if not keep_phone:
        out = F.regexp_replace(out, _PHONE, "")
        if contacts:
            out = F.regexp_replace(out, rf"(?:{'|'.join(contacts)})[^\n]*", "")
    for name in names:
        out = F.replace(out, F.lit(name), F.lit(""))
    return F.regexp_replace(out, r"\(\s*\)", "")


def handled_categories(category: Column, main: Column, key: Column, related: dict[str, Sequence[str]], percent: int = 7) -> Column:
    """The category, and for `percent` of the keys one that is related to the main category; the choice follows the key's MD5."""
    seed = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    other = F.coalesce(*[F.when(main == m, F.get(F.array(*map(F.lit, names)), (F.floor(seed / 100) % len(names)).cast("int"))) for m, names in related.items() if names], F.lit(None).cast("string"))
    own = F.when(F.coalesce(category, F.lit("")) != "", F.array(category)).otherwise(F.array().cast("array<string>"))
    return F.when((seed % 100 < percent) & other.isNotNull(), F.array_append(own, other)).otherwise(own)


def dedupe_blocks(text: Column) -> Column:
    """Blocks between blank lines, repeats (case and white space aside) dropped, order kept."""
    blocks = F.transform(F.filter(F.split(text, r"\n{2,}"), lambda b: strip(b) != ""), lambda b: F.struct(normalize_query(b).alias("key"), strip(b).alias("block")))
    firsts = F.filter(blocks, lambda b, i: F.array_position(F.transform(blocks, lambda x: x["key"]), b["key"]) == i + 1)
    return F.array_join(F.transform(firsts, lambda b: b["block"]), "\n\n")


def step_score(before: Column, after: Column, steps: dict[tuple[str, str], int] = EMOTION_STEPS) -> Column:
    out = F.when(before == after, 3)
    for (a, b), points in steps.items():
        out = out.when((before == a) & (after == b), points)
    return out.otherwise(0)


def transition_score(early: Column, middle: Column, late: Column, steps: dict[tuple[str, str], int] = EMOTION_STEPS) -> Column:
    """Points of both changes of a call's three emotions."""
    return step_score(early, middle, steps) + step_score(middle, late, steps)


def work_score(seconds: Column) -> Column:
    return F.when(seconds <= 90, 20).when(seconds < 120, 15).when(seconds < 150, 10).when(seconds < 200, 5).otherwise(0)


def timeline(start_seconds: Column, duration: Column, steps: Sequence[str]) -> Column:
    """array<struct<step, at>>: steps spread over the call, HH:MM:SS wrapped at midnight; a bad duration counts as 300 s."""
    d = F.when(duration > 0, duration).otherwise(300)
    at = lambda i: (start_seconds + F.floor(i * d / len(steps))) % 86400
    clock = lambda s: F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.array(*[F.struct(F.lit(name).alias("step"), clock(at(F.lit(i))).alias("at")) for i, name in enumerate(steps)])


def cache_key(route: Column, text: Column, filters: Column, k: int) -> Column:
    return F.sha1(F.to_json(F.struct(route.alias("route"), normalize_query(text).alias("query"), F.array_sort(filters).alias("filters"), F.lit(k).alias("k"))))


def pg_array(values: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(values, ","), F.lit("}"))


def from_pg_array(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def struct_or_default(text: Column, schema: str, defaults: dict[str, str]) -> Column:
    """struct of JSON text; members that are null, and all of them where the text is no JSON object, take their default."""
    found = F.from_json(text, schema)
    return F.struct(*[F.coalesce(found[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased words padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))
