"""Dictionary machines, fuzzy ratios and the chain of signals against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions import fuzzy
from callweave.operators import lexicon
from callweave.plans import routing

short = st.text("abc d한글", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[-1]))
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0 if b else 100
    one = lambda x, y: max(ratio(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def weighted(a, b):
    if not a or not b:
        return 0
    span = max(len(a), len(b)) / min(len(a), len(b))
    x, y = a.split(), b.split()
    common, only_a, only_b = (" ".join(sorted(z)) for z in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    ordered = " ".join(sorted(x)), " ".join(sorted(y))
    if span < 1.5:
        both = [f"{common} {z}".strip() for z in (only_a, only_b)]
        words = 100 if common and not (only_a and only_b) else max(ratio(*ordered), ratio(*both), *([ratio(common, z) for z in both] if common else [0]))
        return max(ratio(a, b), 0.95 * words)
    scale = 0.9 if span <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * (100 if common else max(partial(*ordered), partial(only_a, only_b))))


@settings(max_examples=400, deadline=None)
@given(short, short)
def test_ratios(a, b):
    assert fuzzy.common_length(a, b) == lcs(a, b)
    assert fuzzy.partial_ratio(a, b) == pytest.approx(partial(a, b))
    assert fuzzy.weighted_ratio(a, b) == pytest.approx(weighted(a, b))
    for least in (60, 78, 85):
        for bounded, whole in ((fuzzy.partial_ratio(a, b, least), partial(a, b)), (fuzzy.weighted_ratio(a, b, least), weighted(a, b))):
            assert bounded == pytest.approx(whole) if whole >= least else bounded < least


def scanned(text, table):
    """Leftmost-longest whole terms, else contained ones, of {canonical: terms}."""
    entries = [(t.lower(), c) for c, terms in table.items() for t in (c, *terms) if t.strip()]
    inner = set("abcdefghijklmnopqrstuvwxyz0123456789_")
    found, at = [], 0
    while at < len(text):
        fits = [(len(t), i, c) for i, (t, c) in enumerate(entries) if text.startswith(t, at) and not (at and text[at - 1] in inner) and not (at + len(t) < len(text) and text[at + len(t)] in inner)]
        if fits:
            size, _, canonical = max(fits)
            found.append(canonical)
            at += size
        else:
            at += 1
    tight = text.replace(" ", "")
    held = [c for c, terms in table.items() if any(t.strip() and (t.lower() in text or t.lower().replace(" ", "") in tight) for t in (c, *terms))]
    return list(dict.fromkeys(found)) or held


def guessed(text, table, kind):
    known = {}
    for c, terms in table.items():
        for t in (c, *terms):
            if t.strip():
                known.setdefault(t.lower(), c)
    tight = "".join(ch for ch in text if ch.isalnum())
    score = (lambda t: partial("".join(ch for ch in t if ch.isalnum()), tight)) if kind == "partial" else (lambda t: weighted(text, t))
    hits = sorted(((-score(t), i, c) for i, (t, c) in enumerate(known.items()) if score(t) >= (78 if kind == "partial" else 85)), key=lambda x: x[:2])
    return list(dict.fromkeys(c for _, _, c in hits[:3])) if len(text) >= 3 else []


def by_words(text, table):
    words = [w for w in "".join(c if c.isalnum() else " " for c in text).split() if len(w) >= 2]
    forms = [f for w in words for f in ({w} | ({w.removesuffix("카드"), w.removeprefix("카드")} if len(w) > 2 else set())) if f]
    scores = {c: sum(len(f) + 2 * any(ch.isascii() and ch.isalnum() for ch in f) for f in forms if f in "".join(ch for ch in c.lower() if ch.isalnum())) for c in table}
    best = max(scores.values(), default=0)
    hits = [c for c, s in scores.items() if s == best and best >= 3]
    return hits if len(hits) <= 3 else sorted(hits, key=len)[:3]


def chained(text, tables, patterns):
    t = " ".join(text.lower().split())
    card, action, payment, weak = (scanned(t, tables[k]) for k in ("card", "action", "payment", "weak"))
    card = card or by_words(t, tables["card"]) or guessed(t, tables["card"], "partial")
    action = action or guessed(t, tables["action"], "weighted")
    payment = payment or guessed(t, tables["payment"], "weighted")
    weak_terms = {x.lower() for terms in tables["weak"].values() for x in terms}
    if weak:
        held = lambda x: x.lower() in t or x.lower().replace(" ", "") in t.replace(" ", "")
        action = [a for a in action if any(x.lower() not in weak_terms and held(x) for x in tables["action"].get(a, []))]
    hits = [name for name, p in patterns.items() if p in text]
    return card, list(dict.fromkeys([*action, *hits])), payment, weak


TABLES = {
    "card": {"Gold Card": ["gold", "gold plus"], "Gold": ["goldcard"], "국민행복 카드": ["국민행복"], "Blue Sky": ["bluesky", "sky blue"], "K-패스": []},
    "action": {"분실": ["lost", "lost card", "잃어버"], "발급": ["issue", "issue card", "limit"], "해지": ["cancel it"]},
    "payment": {"pay": ["apple pay", "pay"], "wallet": ["my wallet"]},
    "weak": {"limit": ["limit", "한도"], "fee": ["annual fee"]},
}


def test_signals(spark):
    rng = random.Random(9)
    pieces = ["gold", "gold card", "goldcards", "Gold  Plus", "국민행복카드", "국민 행복", "lost", "lostcard", "issue card", "isue crad", "limit", "한도", "apple pay", "aple pay", "mywallet", "cancel  it", "cancle it", "sky", "blue skye", "!!", "k패스", "x", "잃어버", "annual fee", "_gold_"]
    texts = [None, "", "  ", "go", *pieces, *[" ".join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(150)]]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, message string, cards0 string")
    terms = lexicon.dictionaries(spark, TABLES)
    got = {r.id: (r.cards, r.actions, r.payments, r.weak) for r in lexicon.signals(rows, "message", terms, {"shout": "!!"}, [], [], []).collect()}
    want = {i: chained(t or "", TABLES, {"shout": "!!"}) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert lexicon.signals(rows.limit(0), "message", terms, {}, [], [], []).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["lost card and gold plus", "blue skye", "isue crad limit", "sky blue goldcard"])], "id long, message string")
    terms = lexicon.dictionaries(spark, TABLES)
    find = lambda: sorted(map(str, lexicon.signals(rows, "message", terms, {}, [], [], []).collect()))
    whole = find()
    monkeypatch.setattr(lexicon, "MOST_TERMS", 4)
    assert find() == whole


def test_registered_queries(spark, tmp_path):
    """extract_signals and dictionary_terms on small tables, against the same brute force."""
    lines = ["ing th and open", "the tion of ed", "blue skies und s", "heit la !! que s", "nothing here", "ere a   ere", "opne", "gold"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(lines)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    tables = {"card": routing.CARDS, "action": routing.ACTIONS, "payment": routing.PAYMENTS, "weak": routing.WEAK}
    got = {r.session_id: (r.cards, r.actions, r.payments, r.weak) for r in routing.QUERIES["extract_signals"](spark, str(tmp_path)).collect()}
    assert got == {i: chained(t, tables, {"shout": "!!"}) for i, t in enumerate(lines)}
    spark.createDataFrame([(1, "One two. Three one"), (2, "two"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = ["one two three one", "stone two; onetwo", "Two  three", None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: sorted(r.found) for r in routing.QUERIES["dictionary_terms"](spark, str(tmp_path)).collect()}
    assert found == {0: ["ONE TWO", "THREE ONE"], 1: ["ONE TWO"], 2: ["TWO THREE"], 3: [], 4: []}


def test_named_by_dictionary(spark):
    """Terms of different dictionaries may overlap; within one the longest at a place counts."""
    terms = lexicon.dictionaries(spark, {"a": {"X": ["new york"], "Y": ["york city"]}, "b": {"Z": ["york"]}})
    row = lexicon.with_spans(spark.createDataFrame([("new york city",)], "t string"), "t", terms)
    assert row.select(lexicon.named(F.col("spans"), "a").alias("a"), lexicon.named(F.col("spans"), "b").alias("b")).first() == (["X"], ["Z"])


def test_product_candidates(spark, monkeypatch):
    """The whole cascade against a plain form of its rules, in one block and in several."""
    from callweave.functions import matching

    general = ["카드", "체크", "신용", "신용카드", "체크카드", "card", "check"]
    products = [("아이사랑 플러스 카드", ["아이사랑"]), ("국민행복 카드", ["구민행복", "국민 행복"]), ("Deep Dream Check", []), ("K-패스", ["케이패스"]), ("내일배움 테디카드", []), ("Dream", ["drim"])]
    pieces = ["아이", "플러스", "사랑", "국민행복", "국민햄복", "카드", "배움카드", "deep", "Dreem", "drim", "check", "k-패스", "케이파스", "x", "테디", "좋은"]
    rng = random.Random(1)
    texts = [None, "", " ", *pieces, *[" ".join(rng.choices(pieces, k=rng.randrange(1, 4))) for _ in range(120)]]
    tight = lambda t: "".join(t.lower().split())

    def scored(text, name, others):
        asked = []
        for w in text.split():
            low = tight(w)
            if len(w) > 1 and low not in general:
                for g in sorted(general, key=len, reverse=True):
                    low = low.replace(g, "")
                asked += [low] if len(low) >= 2 else []
        whole, words, parts = tight(name), [tight(w) for w in name.split() if len(w) > 1], []
        for q in asked:
            if any(q in w or w in q for w in words) or q in whole:
                parts.append(q)
            else:
                cuts = [q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1) if q[i:j] in whole and q[i:j] not in general]
                parts += [max(cuts, key=len)] if cuts else []
        if parts:
            share = len(parts) / len(asked)
            both = 0.7 + 0.2 * share if len(parts) > 1 else 0.75 + 0.15 * share if len(parts[0]) >= 3 else 0.5 + 0.2 * share
            if both >= 0.6:
                return both
        heard = [s for s in [matching.phonetic_similarity(text, name)] if s >= 0.6]
        return max(heard + [0.9 * s for s in (matching.phonetic_similarity(text, o) for o in others) if s >= 0.6], default=0)

    want = {}
    for i, t in enumerate(texts):
        if not (t or "").strip():
            continue
        straight = [(0.88 + 0.1 * len(tight(t)) / len(tight(n)) if tight(t) in tight(n) else 0.95, p, n) for p, (n, _) in enumerate(products) if tight(t) in tight(n) or tight(n) in tight(t)]
        rest = [(s, p, n) for p, (n, o) in enumerate(products) if (s := scored(t, n, o))]
        best = sorted(straight or rest, key=lambda x: (-x[0], x[1]))[:3]
        want |= {i: [(n, round(s, 6)) for s, _, n in best]} if best else {}
    table = spark.createDataFrame([(n, o, p) for p, (n, o) in enumerate(products)], "product string, others array<string>, place long")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, said string")
    for most in (200_000, 2):
        monkeypatch.setattr(lexicon, "MOST_TERMS", most)
        got = {}
        for r in lexicon.product_candidates(rows, "said", table).orderBy("rank").collect():
            got.setdefault(r.id, []).append((r.product, r.score))
        assert {i: (texts[i], got.get(i), want.get(i)) for i in {*got, *want} if got.get(i) != want.get(i)} == {} and len(want) > 80
