"""How well a text names a product: containment, shared keywords, sound. Small and Spark-free."""

from __future__ import annotations

from collections.abc import Iterable

from callweave.functions import fuzzy, matching

# Results depend on them. Words too general to name a product; what a synonym's or variation's sound counts.
GENERAL = ["카드", "체크", "신용", "신용카드", "체크카드", "card", "check"]
OTHER_NAME = 0.9


def tight(text: str) -> str:
    return "".join(text.lower().split())


def direct(text: str, name: str) -> float:
    """Of tight forms: the text stands in the name (better the more of it it is), or the name in the text."""
    if not text or not name:
        return 0.0
    if text in name:
        return 0.88 + 0.10 * len(text) / len(name)
    return 0.95 if name in text else 0.0


def keywords(text: str) -> list[str]:
    """Words of two characters or more without general words, as far as two characters are left."""
    out = []
    for word in text.split():
        low = tight(word)
        if len(word) > 1 and low not in GENERAL:
            for general in sorted(GENERAL, key=len, reverse=True):
                low = low.replace(general, "")
            if len(low) >= 2:
                out.append(low)
    return out


def shared_part(keyword: str, name: str, words: list[str]) -> str:
    """The keyword, if a word of the name holds it or is held by it, or the whole name holds it; else its first longest piece
    of two characters or more that the name holds and that is not general; else nothing."""
    if keyword in name or any(keyword in w or w in keyword for w in words):
        return keyword
    for size in range(len(keyword) - 1, 1, -1):
        for i in range(len(keyword) - size + 1):
            piece = keyword[i : i + size]
            if piece in name and piece not in GENERAL:
                return piece
    return ""


def combined(asked: list[str], name: str, words: list[str]) -> float:
    parts = [p for p in (shared_part(k, name, words) for k in asked) if p]
    if not parts:
        return 0.0
    share = len(parts) / len(asked)
    if len(parts) > 1:
        return 0.7 + 0.2 * share
    return 0.75 + 0.15 * share if len(parts[0]) >= 3 else 0.5 + 0.2 * share


def sound(a: str, b: str, least: float) -> float:
    """Similarity of two strings of letters; 0 where their lengths or the letters both have show that `least` can't be reached."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    if min(len(a), len(b)) < least * longest - 1e-9 or fuzzy.shared(a, b) < least * longest - 1e-9:
        return 0.0
    return 1.0 - matching.edit_distance(a, b) / longest


class Product:
    """A name with its other names, prepared once."""

    def __init__(self, name: str, others: Iterable[str]):
        self.name = tight(name)
        self.words = [tight(w) for w in name.split() if len(w) > 1]
        self.letters = matching.letters(self.name)
        self.others = [matching.letters(o) for o in others if o]

    def scored(self, asked: list[str], letters: str, least: float) -> float:
        """Shared keywords, else the best of the name's sound and those of its other names; 0 below `least`."""
        both = combined(asked, self.name, self.words) if asked else 0.0
        if both >= least:
            return both
        heard = [sound(letters, self.letters, least), *(OTHER_NAME * s for s in (sound(letters, o, least) for o in self.others) if s >= least)]
        return max((s for s in heard if s >= OTHER_NAME * least), default=0.0)
