"""Column functions that route a query: dictionary fallbacks, term expansion, the route decision, guidance flags and slots.

Term lists are short parameters; the defaults are those that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.functions.signals import any_of, flagged, loss_intent, region

INFO, USAGE = "card_info", "card_usage"


# Results depend on them.
@dataclass
class RouteTerms:
    benefit: list[str] = field(default_factory=lambda: ["혜택", "할인", "자동납부", "자동이체", "통신료", "통신요금", "전월실적", "적립", "캐시백"])
    reissue: list[str] = field(default_factory=lambda: ["재발급", "재발행", "재교부"])
    sources: list[str] = field(default_factory=lambda: ["이자", "수수료", "연체", "리볼빙", "약관", "요율", "적용", "적용대상", "거래조건", "한도", "금리"])
    loss: list[str] = field(default_factory=lambda: ["분실", "도난", "분실도난", "도난분실", "잃어버", "잃음"])
    error: list[str] = field(default_factory=lambda: ["오류", "에러", "안돼", "불가", "거절", "되지않음"])
    registration: list[str] = field(default_factory=lambda: ["등록", "추가", "신청", "인증"])
    trigger_actions: list[str] = field(default_factory=lambda: ["분실", "분실도난", "오류"])
    force: list[tuple[list[str], list[str]]] = field(
        default_factory=lambda: [
            (["리볼빙", "일부결제금액이월", "이월약정"], ["신청", "해지", "변경", "방법", "가능", "절차"]),
            (["애플페이", "apple pay"], ["등록", "추가", "인증", "안돼", "오류", "실패"]),
            (["재발급", "재발행", "재교부", "재발급신청"], ["방법", "신청", "절차", "해당"]),
        ]
    )
    phone: list[str] = field(default_factory=lambda: ["전화번호", "고객센터", "콜센터", "ars", "연락처", "상담원"])
    reissue_name: str = "재발급"
    issue_name: str = "발급"
    issue_template: str = "카드 발급 조건"
    card_word: str = "카드"
    info_word: str = "정보"
    how_word: str = "방법"
    use_word: str = "사용 방법"


#: Query words that ask for guidance on card information.
GUIDANCE_TRIGGERS = ["추천", "비교", "얼마", "조건", "가능", "연회비", "혜택", "신청", "발급", "한도", "전월", "실적", "통신", "자동납부", "통신사", "편의점", "배달"]
#: Spellings of the loss and theft term.
LOSS_VARIANTS = ["분실 도난", "분실·도난", "분실/도난", "분실-도난", "도난 분실", "도난·분실", "도난/분실", "도난-분실"]
LOSS_TERM, LOSS_TERMS = "분실도난", ["분실", "도난", "분실도난", "도난분실", "잃어버", "분실/도난", "분실·도난", "분실-도난", "분실 도난", "도난 분실"]
_NONE = "array<string>"


def no_terms() -> Column:
    return F.array().cast(_NONE)


def fallback_contains(text: Column, synonyms: dict[str, list[str]], found: Column | None = None) -> Column:
    """Where `found` is empty: the canonical terms that, or a synonym of which, the text holds, with or without blanks."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    held = flagged([(c, any_of(text, low) | any_of(tight, [t.replace(" ", "") for t in low])) for c, terms in synonyms.items() for low in [[t.lower() for t in (c, *terms) if t]]])
    return held if found is None else F.when(F.size(found) > 0, found).otherwise(held)


def signals(text: Column, cards: dict, actions: dict, payments: dict, weak: dict, patterns: dict[str, str], info: list[str], usage: list[str], issuance: list[str]) -> Column:
    """struct of what a query names: cards, actions, payments, weak, patterns (also added to the actions) and three flags."""
    t = T.normalize_query(text)
    hits = T.composite_actions(text, patterns)
    return F.struct(
        t.alias("normalized"), fallback_contains(t, cards).alias("cards"), F.array_distinct(F.concat(fallback_contains(t, actions), hits)).alias("actions"), fallback_contains(t, payments).alias("payments"),
        fallback_contains(t, weak).alias("weak"), hits.alias("patterns"), any_of(t, info).alias("info"), any_of(t, usage).alias("usage"), any_of(t, issuance).alias("issuance"),
    )


def route_decision(s: Column, applepay: Column, words: RouteTerms, weak_routes: dict[str, str]) -> Column:
    """s: of signals(). struct<route, db_route, filters map, template, trigger, search, sources, exclude, policy>.

    A telephone question and a force rule (subject and action) come first; then the first case of an ordered table that holds."""
    t, cards, actions, payments, weak = s["normalized"], s["cards"], s["actions"], s["payments"], s["weak"]
    some = lambda a: F.size(a) > 0
    head = lambda a: F.get(a, F.lit(0))
    none = F.lit(None).cast("string")
    filters = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, v: F.size(v) > 0)
    one = lambda x: F.array(F.lit(x))
    join = lambda *parts: F.concat_ws(" ", *parts)
    plain = applepay.isNull()
    weak_route = F.coalesce(*[F.when(head(weak) == w, F.lit(r)) for w, r in weak_routes.items()], F.lit(USAGE))
    card_or_both = F.when(some(cards), "card_tbl").otherwise("both")
    row = lambda route, db, kv, template, trigger=F.lit(True): F.struct(route.alias("route"), db.alias("db_route"), kv.alias("filters"), template.alias("template"), trigger.alias("trigger"))
    word = lambda x: F.lit(x)
    cases = [
        (any_of(t, words.reissue) & plain, row(F.lit(USAGE), F.lit("guide_tbl"), filters(intent=one(words.reissue_name)), none)),
        (any_of(t, words.benefit) & plain, row(F.lit(INFO), card_or_both, filters(card_name=cards), none)),
        (
            s["info"] & ~s["usage"] & ~some(payments) & ~some(s["patterns"]),
            row(F.lit(INFO), F.when(some(actions) | some(weak), "both").otherwise(card_or_both), filters(card_name=cards, intent=actions, weak_intent=weak), F.when(some(cards), join(head(cards), word(words.info_word))).when(some(actions), join(word(words.card_word), head(actions), word(words.info_word)))),
        ),
        (s["issuance"] & ~some(cards), row(F.lit(INFO), F.lit("card_tbl"), filters(intent=one(words.issue_name)), F.lit(words.issue_template))),
        (some(cards) & some(actions), row(F.lit(USAGE), F.lit("both"), filters(card_name=cards, intent=actions, payment_method=payments, weak_intent=weak), join(head(cards), head(actions), word(words.how_word)))),
        (some(cards) & some(payments), row(F.lit(USAGE), F.lit("card_tbl"), filters(card_name=cards, payment_method=payments), join(head(cards), head(payments), word(words.use_word)))),
        (some(cards) & some(weak), row(weak_route, F.lit("both"), filters(card_name=cards, weak_intent=weak), F.when(weak_route == INFO, join(head(cards), head(weak))).otherwise(join(head(cards), head(weak), word(words.how_word))))),
        (some(cards), row(F.lit(INFO), F.lit("card_tbl"), filters(card_name=cards), join(head(cards), word(words.info_word)))),
        (some(actions), row(F.lit(USAGE), F.lit("guide_tbl"), filters(intent=actions, payment_method=payments), join(word(words.card_word), head(actions), word(words.how_word)), F.arrays_overlap(actions, F.array(*map(F.lit, words.trigger_actions))))),
        (some(payments), row(F.lit(USAGE), F.lit("card_tbl"), filters(payment_method=payments), join(head(payments), word(words.use_word)))),
    ]
    empty = F.create_map().cast("map<string,array<string>>")
    default = row(F.lit(USAGE), F.lit("both"), empty, none)
    chosen = F.coalesce(*[F.when(c, r) for c, r in cases], default)
    phone = any_of(t, words.phone)
    force = F.lit(False)
    for subjects, acts in words.force:
        force = force | (any_of(t, subjects) & any_of(t, acts))
    strong = some(cards) | some(actions) | some(payments) | some(weak) | some(s["patterns"])
    single = F.size(F.split(t, " ")) == 1
    mute = (~strong & single) | (some(cards) & ~some(actions) & ~some(payments) & ~some(weak) & single)
    among = lambda terms: F.arrays_overlap(actions, F.array(*map(F.lit, terms)))
    listed = lambda *x: F.array(*map(F.lit, x))
    guides = listed("guide_merged", "guide_general")
    with_terms = (chosen["route"] == USAGE) & any_of(t, words.sources)
    sources = F.when(~plain, listed("hyundai_applepay", "guide_general")).when(with_terms, listed("guide_with_terms"))
    sources = sources.when(among(words.loss) | among(words.error) | among(words.registration), guides).when(chosen["route"] == INFO, listed("card_products", "guide_merged", "guide_general")).otherwise(guides)
    exclude = F.when(~plain, listed("terms", "card_products")).when(with_terms, no_terms()).otherwise(listed("terms"))
    policy = F.when(~plain | ((chosen["route"] == INFO) & some(cards)), "A").when(some(actions), "B").when(some(cards) & some(payments), "B").otherwise("C")
    decided = F.struct(*[chosen[c].alias(c) for c in ("route", "db_route", "filters", "template")], (chosen["trigger"] & ~mute).alias("trigger"), (strong & (F.length(t) >= 2) & ~mute).alias("search"), sources.alias("sources"), exclude.alias("exclude"), policy.alias("policy"))
    fixed = lambda route, db, kv, src, pol: F.struct(F.lit(route).alias("route"), F.lit(db).alias("db_route"), kv.alias("filters"), none.alias("template"), F.lit(True).alias("trigger"), F.lit(True).alias("search"), src.alias("sources"), listed("terms").alias("exclude"), F.lit(pol).alias("policy"))
    return F.when(phone, fixed("phone_lookup", "guide_tbl", filters(intent=one("phone_lookup")), guides, "B")).when(force, fixed(USAGE, "card_tbl", empty, no_terms(), "C")).otherwise(decided)


# Results depend on them.
@dataclass
class FilterTerms:
    loss_strong: list[str] = field(default_factory=lambda: ["분실", "잃어버", "도난", "훔", "없어졌", "주운", "주웠"])
    loss_action: list[str] = field(default_factory=lambda: ["정지", "신고", "재발급", "부정사용", "승인", "결제됐", "피해"])
    loss_names: list[str] = field(default_factory=lambda: ["분실", "도난"])
    info: list[str] = field(default_factory=lambda: ["괜찮", "좋아", "혜택", "추천", "연회비", "조건", "신청", "발급", "한도", "실적", "할인", "서류", "방법"])
    no_name: list[str] = field(default_factory=lambda: ["좋아요", "괜찮", "추천", "혜택", "연회비", "조건", "신청", "서류", "방법", "얼마", "한도", "할인"])
    name_below: int = 18
    programme: list[str] = field(default_factory=lambda: ["k패스", "k-pass", "케이패스"])
    programme_name: str = "K-패스"
    benefits: dict[str, list[str]] = field(default_factory=lambda: {"다자녀": ["다자녀", "2자녀", "세자녀", "자녀", "미성년 자녀"], "체크": ["체크", "체크카드"], "청년": ["청년", "만 19", "만19", "만 34", "만34"]})
    regions: dict[str, list[str]] = field(default_factory=lambda: {"경기": ["경기", "경기도"], "충남": ["충남", "충청남도"], "충북": ["충북", "충청북도"], "서울": ["서울", "서울시"]})


def settled_filters(decided: Column, text: Column, words: FilterTerms | None = None) -> Column:
    """The filters of a route_decision() for its normalized text: names that can't be card names go; without a loss intent so
    do intents of loss, and all intents if the text asks for information; the text of one card programme adds the
    programme's name (if no card is named), region and benefits. Telephone and forced routes keep theirs. A null text has
    none of the words."""
    words = words or FilterTerms()
    text = F.coalesce(text, F.lit(""))
    filters = decided["filters"]
    name = lambda x: ~any_of(F.lower(x), words.no_name) & (F.length(x) < words.name_below)
    lost = loss_intent(text, words.loss_strong, words.loss_action, words.info)
    intents = lambda v: F.when(lost, v).when(any_of(text, words.info), no_terms()).otherwise(F.filter(v, lambda x: ~any_of(x, words.loss_names)))
    clean = F.transform_values(filters, lambda k, v: F.when(k == "card_name", F.filter(v, name)).when(k.isin("intent", "weak_intent"), intents(v)).otherwise(v))
    named = F.size(F.coalesce(F.try_element_at(clean, F.lit("card_name")), no_terms())) > 0
    place = region(text, words.regions)
    more = F.create_map(
        F.lit("card_name"), F.when(named, no_terms()).otherwise(F.array(F.lit(words.programme_name))),
        F.lit("region"), F.when(place.isNull(), no_terms()).otherwise(F.array(place)),
        F.lit("benefit_type"), flagged([(k, any_of(text, p)) for k, p in words.benefits.items()]),
    )
    more = F.map_filter(more, lambda k, v: any_of(text, words.programme) & (F.size(v) > 0))
    kept = F.map_filter(clean, lambda k, v: (F.size(v) > 0) & ~F.map_contains_key(more, k))
    return F.when((decided["route"] == "phone_lookup") | (F.size(decided["sources"]) == 0), filters).otherwise(F.map_concat(kept, more))


# Results depend on them. Words that are actions or intents, and those that never count.
ACTION_WORDS = ["방법", "어떻게", "신청", "등록", "추가", "설정", "변경", "해지", "취소", "안됨", "오류", "실패", "인증", "재발급", "재발행", "재교부", "분실", "도난", "발급", "결제", "승인", "환불", "에러", "안돼", "불가", "거절", "신고", "서류", "사용", "사용처", "교통", "충전", "연체", "수수료", "이자", "이자율", "대출", "현금서비스", "카드론", "리볼빙", "입금", "납부", "한도"]
INTENT_WORDS = {w: [] for w in ("혜택", "연회비", "조건", "추천", "비교", "좋아", "좋은", "괜찮", "정보", "소개", "어떤", "뭐가")}
KEYWORD_STOP = ["체크", "신용", "card", "check", "신용카드", "체크카드", "있어요", "있나요", "있나", "뭐에요", "뭐예요", "뭐야", "어떻게", "어떤", "그", "이", "저", "그런", "이런"]
PAYMENT_NAMES = {
    "iM유페이": ["iM 유페이", "iM유 페이", "im유페이"],
    "네이버페이": ["naver pay", "네이버 페이"],
    "삼성페이": ["samsung pay", "삼성 페이"],
    "애플페이": ["apple pay", "applepay", "애플 페이"],
    "카카오페이": ["kakao pay", "카카오 페이"],
    "티머니": ["t-money", "tmoney", "t머니", "티 머니"],
}


def extract_keywords(text: Column, corrections: dict[str, str], cards: dict[str, list[str]], actions: list[str] = ACTION_WORDS, payments: dict[str, list[str]] = PAYMENT_NAMES, intents: dict[str, list[str]] = INTENT_WORDS, patterns: dict[str, str] = T.COMPOSITE_ACTIONS, stop: list[str] = KEYWORD_STOP) -> Column:
    """struct<corrected, cards, actions, payments, intents, query> of a spoken text: known errors corrected (longest first),
    cards by containment, actions and intents by words between white space (stop words aside) in order, actions also by
    patterns, payments anywhere without blanks; query joins cards, actions and intents, each once. Null is an empty text."""
    fixed = T.correct_terms(F.coalesce(text, F.lit("")), corrections)
    words = F.array_distinct(F.filter(F.split(fixed, r"(?U)\s+"), lambda w: w != ""))
    acts = F.filter(words, lambda w: w.isin(actions) & ~w.isin(stop))
    acts = F.array_distinct(F.concat(acts, T.composite_actions(fixed, patterns)))
    canonical = {w: c for c, terms in intents.items() for w in (c, *terms)}
    table = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])
    means = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda i: i.isNotNull() & ~i.isin(stop)))
    tight = F.replace(F.lower(fixed), F.lit(" "), F.lit(""))
    pays = flagged([(c, any_of(tight, [t.replace(" ", "").lower() for t in (c, *terms)])) for c, terms in payments.items()])
    named = fallback_contains(F.lower(fixed), cards)
    return F.struct(fixed.alias("corrected"), named.alias("cards"), acts.alias("actions"), pays.alias("payments"), means.alias("intents"), F.array_join(F.array_distinct(F.concat(named, acts, means)), " ").alias("query"))


def expand_terms(terms: Column, synonyms: dict[str, list[str]], no_space: bool = False) -> Column:
    """The terms, then the synonyms of each, distinct in order; with no_space also every term without its blanks."""
    table = F.create_map(*[x for c, s in synonyms.items() for x in (F.lit(c), F.array(*map(F.lit, s)))])
    out = F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), no_terms())))))
    if not no_space:
        return out
    tight = F.transform(out, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.array_distinct(F.concat(out, F.filter(tight, lambda t: t != "")))


def guide_terms(terms: Column, generic: list[str], most: int = 3) -> Column:
    """Loss and theft terms as one with its spellings, terms also without separators, at most `most`; of these the generic
    ones go if others remain."""
    key = lambda t: F.regexp_replace(F.lower(T.strip(t)), r"[\s\-/·.]", "")
    forms = F.flatten(F.transform(terms, lambda t: F.concat(
        F.array(F.when(t.isin(LOSS_TERMS), F.lit(LOSS_TERM)).otherwise(t)), F.when(key(t) != t, F.array(key(t))).otherwise(no_terms()),
        F.when(key(t).isin("분실도난", "도난분실"), F.array(*map(F.lit, LOSS_VARIANTS))).otherwise(no_terms()),
    )))
    kept = F.slice(F.array_distinct(F.filter(forms, lambda t: t != "")), 1, most)
    rare = F.filter(kept, lambda t: ~key(t).isin(generic))
    return F.when((F.size(kept) > 1) & (F.size(rare) > 0), rare).otherwise(kept)


def info_guidance(query: Column, intents: Column, triggers: list[str] = GUIDANCE_TRIGGERS) -> Column:
    """Whether the query, or one of its intents, holds a trigger term; an empty query doesn't."""
    return (T.strip(F.coalesce(query, F.lit(""))) != "") & (any_of(query, triggers) | F.exists(intents, lambda i: any_of(i, triggers)))


def expand_card_info(query: Column, cards: Column, db_route: Column, tokens: list[str]) -> Column:
    """With a card filter: whether guides are searched too, by the route or by a guide token in the query without blanks."""
    return (F.size(cards) > 0) & (db_route.isin("both", "guide_tbl") | any_of(F.replace(F.lower(query), F.lit(" "), F.lit("")), tokens))


def card_keywords(terms: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.concat(F.lit("#"), F.regexp_replace(t, r"^#", ""))))


def guidance_slots(cards: Column, regions: Column, benefits: Column) -> Column:
    """struct<card_names (distinct, shortest first), region (the first, or ''), benefit_types (sorted set)>."""
    full = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    short = F.transform(F.array_sort(F.transform(full(cards), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda x: x["x"])
    return F.struct(short.alias("card_names"), F.coalesce(F.get(regions, F.lit(0)), F.lit("")).alias("region"), F.array_sort(full(benefits)).alias("benefit_types"))


def chat_template(instruction: Column, output: Column, system: str) -> Column:
    """JSON messages of one training row: system, user, assistant."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(turn("system", F.lit(system)), turn("user", instruction), turn("assistant", output)))
