"""Column functions that read intents, names and sections out of queries and documents. Dictionaries are short parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import text as T


def any_of(text: Column, terms: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def flagged(pairs: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))


def loss_intent(text: Column, strong: list[str], action: list[str], info: list[str]) -> Column:
    """A strong loss word, unless the query asks for card information and names no action."""
    return any_of(text, strong) & (~any_of(text, info) | any_of(text, action))


def region(text: Column, patterns: dict[str, list[str]]) -> Column:
    """The first region with a pattern in the text, else null."""
    return F.get(flagged([(k, any_of(text, p)) for k, p in patterns.items()]), 0)


def benefit_types(text: Column, patterns: dict[str, list[str]]) -> Column:
    return flagged([(k, any_of(text, p)) for k, p in patterns.items()])


# Where an ASCII word begins or ends, and where not. Java's own \b also counts letters beyond ASCII as parts of words.
_EDGE = {"b": r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", "B": r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"}


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges outside brackets as SQL engines take them: only ASCII letters, digits and _ make words."""
    out, at, inside = [], 0, 0
    while at < len(pattern):
        sign = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        if len(sign) == 2 and sign[1] in _EDGE and not inside:
            out.append(_EDGE[sign[1]])
        else:
            inside = max(0, inside + (sign == "[") - (sign == "]"))
            out.append(sign)
        at += len(sign)
    return "".join(out)


def compound_patterns(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Categories of the rules whose pattern is found; one entry a rule."""
    return flagged([(category, F.rlike(text, F.lit(pattern))) for category, pattern in rules])


def filter_weak_actions(actions: Column, weak_intents: Column, text: Column, synonyms: dict[str, list[str]], weak_terms: set[str]) -> Column:
    """Where weak intents were found: the actions that some other term than a weak one supports (as written or without
    blanks). Otherwise all actions."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    strong = {a: [t.lower() for t in terms if t and t.lower() not in weak_terms] for a, terms in synonyms.items()}
    held = flagged([(a, any_of(text, terms) | any_of(tight, [t.replace(" ", "") for t in terms])) for a, terms in strong.items()])
    return F.when(F.size(weak_intents) == 0, actions).otherwise(F.filter(actions, lambda a: F.array_contains(held, a)))


def card_token_match(tokens: Column, names: list[str], least: int = 3, most: int = 3) -> Column:
    """The names with the highest score: per token found in the name without blanks, its length, and 2 more if it has an
    ASCII letter or digit. None below `least`; of more than `most`, the shortest. names is a dictionary, not a table."""
    def score(name: str, held: Column) -> Column:
        tight = F.lit(name.replace(" ", "").lower())
        return F.aggregate(held, F.lit(0), lambda s, t: s + F.when(F.contains(tight, t["token"]), t["weight"]).otherwise(0))

    def chosen(scored: Column, best: Column) -> Column:
        hits = F.transform(F.filter(scored, lambda x: x["score"] == best), lambda x: x["name"])
        short = F.transform(F.array_sort(F.transform(hits, lambda n, i: F.struct(F.length(n).alias("length"), i.alias("at"), n.alias("name")))), lambda x: x["name"])
        return F.when(best < least, F.array().cast("array<string>")).when(F.size(hits) > most, F.slice(short, 1, most)).otherwise(hits)

    # tokens in no name count for nothing; what is used several times is worked out once, as a lambda's variable
    every = "\0".join(name.replace(" ", "").lower() for name in names)
    found = F.filter(tokens, lambda t: (t != "") & F.contains(F.lit(every), t))
    weighed = F.transform(found, lambda t: F.struct(t.alias("token"), (F.length(t) + F.when(t.rlike("[A-Za-z0-9]"), 2).otherwise(0)).alias("weight")))
    scored = _once(weighed, lambda held: F.array(*(F.struct(score(n, held).alias("score"), F.lit(n).alias("name")) for n in names)))
    return _once(scored, lambda all: _once(F.array_max(F.transform(all, lambda x: x["score"])), lambda best: chosen(all, best)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matching_sections(text: Column, terms: Column, most: int = 2) -> Column:
    """The first sections (headings of one to three #) whose title contains a term, else the whole text."""
    sections = F.split(text, r"\n(?=[ \t]*#{1,3} )")
    title = lambda s: F.lower(F.regexp_extract(s, r"^[ \t]*#{1,3} +([^\n]*)", 1))
    hits = F.filter(sections, lambda s: F.exists(terms, lambda t: F.contains(title(s), F.lower(t))))
    return F.when(F.size(hits) > 0, F.array_join(F.slice(F.transform(hits, T.strip), 1, most), "\n\n")).otherwise(text)


def anchor_choice(query: Column, context: Column, anchors: list[tuple[str, str, list[str]]], default: str) -> Column:
    """anchors: label, pattern, keywords. 10 for a pattern in the query, 2 a keyword in query and context; the first of the
    best, the default if none scores."""
    both = F.concat_ws(" ", query, context)
    points = lambda pattern, words: reduce(Column.__add__, [F.when(F.contains(both, F.lit(w)), 2).otherwise(0) for w in words], F.when(F.rlike(query, F.lit(pattern)), 10).otherwise(0))
    best = F.array_max(F.array(*(F.struct(points(p, w).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, p, w) in enumerate(anchors))))
    return F.when(best["score"] > 0, best["label"]).otherwise(F.lit(default))


def strict_grounding(script: Column, content: Column) -> Column:
    """The script if each of its sentences occurs in the content (both in lower case, blanks collapsed), else ''."""
    parts = F.filter(F.transform(F.split(script, r"[.!?\n]+"), T.strip), lambda s: s != "")
    ground = T.normalize_query(content)
    return F.when((T.strip(content) != "") & F.forall(parts, lambda s: F.contains(ground, T.normalize_query(s))), script).otherwise(F.lit(""))


def base_card(id: Column, title: Column, content: Column, preview: int = 140) -> Column:
    """JSON of a preview card without its empty members."""
    full = lambda c: F.nullif(c, F.lit(""))
    return F.to_json(F.struct(id.alias("id"), full(T.strip(title)).alias("title"), full(F.substring(T.collapse(content), 1, preview)).alias("content")), {"ignoreNullFields": "true"})
