"""Fuzzy ratios of two short strings, 0 to 100, on longest common subsequences. Small and Spark-free."""

from __future__ import annotations

from collections import Counter


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a's places at once in the bits of a number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every  # a's places that no subsequence so far ends at
    for c in b:
        hit = open_ & masks.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over all characters."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def shared(a: str, b: str) -> int:
    """Characters that both have, repeats counted: no common subsequence is longer."""
    return (Counter(a) & Counter(b)).total()


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter string with a window of the longer one, which may stick out at either end; 0 where
    the characters that both have show that `least` can't be reached."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    both = shared(a, b)
    if 200.0 * both < least * (len(a) + both):
        return 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b)


def _windows(a: str, b: str) -> float:
    """The best ratio of a with b's windows. One that ends with a sign that a lacks is no better than the one before it; at
    b's end the same holds of its first sign and the one after it."""
    n, best, known = len(a), 0.0, set(a)
    for at in range(1 - n, len(b)):
        window = b[max(0, at) : at + n]
        if window[-1 if at + n <= len(b) else 0] in known and 200.0 * min(n, len(window)) > best * (n + len(window)):
            best = max(best, ratio(a, window))
    return best


def _tokens(a: str, b: str) -> tuple[list[str], list[str], str, str, str]:
    x, y = a.split(), b.split()
    join = lambda words: " ".join(sorted(words))
    return sorted(x), sorted(y), join(set(x) & set(y)), join(set(x) - set(y)), join(set(y) - set(x))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted words, and of the common words with and without the others."""
    x, y, common, only_a, only_b = _tokens(a, b)
    best = ratio(" ".join(x), " ".join(y))
    if common and not (only_a and only_b):
        return 100.0
    whole_a, whole_b = f"{common} {only_a}".strip(), f"{common} {only_b}".strip()
    best = max(best, ratio(whole_a, whole_b))
    return max(best, ratio(common, whole_a), ratio(common, whole_b)) if common else best


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    """100 with a common word, else the better partial ratio of sorted words and of distinct ones."""
    x, y, common, only_a, only_b = _tokens(a, b)
    if common:
        return 100.0
    best = partial_ratio(" ".join(x), " ".join(y), least)
    return max(best, partial_ratio(only_a, only_b, least)) if len(set(x)) < len(x) or len(set(y)) < len(y) else best


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best of ratio, partial ratio and word ratios, those weighed down: words by 0.95, parts by 0.9, or 0.6 where one
    string is over eight times as long. 0 where a bound shows that `least` can't be reached."""
    if not a or not b:
        return 0.0
    short, long = sorted((len(a), len(b)))
    scale = 1.0 if long < 1.5 * short else 0.9 if long <= 8 * short else 0.6
    if scale * 100 < least:
        return 0.0
    best = ratio(a, b)
    if scale == 1.0:
        return max(best, 0.95 * token_ratio(a, b))
    best = max(best, scale * partial_ratio(a, b, least / scale))
    return max(best, 0.95 * scale * partial_token_ratio(a, b, least / (0.95 * scale)))
