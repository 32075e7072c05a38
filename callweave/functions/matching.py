"""String helpers for tasks: sequence ratios, turn folding, Hangul letters, cover density. Small and Spark-free."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]


#: Ranges of texts with no more pairs of characters than this are left to difflib. Base of the hashes, modulo 2**64: odd, so it has an inverse.
FEW_PAIRS, _BASE = 4_000, 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Windows:
    """Hashes of all windows of one length of a text: differences of running sums, moved to a common place."""

    def __init__(self, text: str, powers: np.ndarray, inverse: np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)])
        self.inverse = inverse

    def of(self, size: int, low: int, high: int) -> np.ndarray:
        return (self.sums[low + size : high + 1] - self.sums[low : high + 1 - size]) * self.inverse[low : high + 1 - size]


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the equal stretches, as SequenceMatcher finds them without junk: the longest one (of
    several the first in a, then in b), then the same to its left and its right. Its length is searched for by halving over
    hashes of windows, and each hit is compared, so a long text takes some sorts where difflib visits pairs of places."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    found, open_ = [], [(0, len(a), 0, len(b))]
    x = y = None
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        n, m = ahi - alo, bhi - blo
        if not n or not m:
            continue
        if n == m and a[alo:ahi] == b[blo:bhi]:
            found.append((alo, blo, n))
            continue
        if n * m <= FEW_PAIRS:
            found += [(alo + i, blo + j, k) for i, j, k in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks() if k]
            continue
        if x is None:
            powers, inverse = (_powers(base, max(len(a), len(b)) + 1) for base in (_BASE, _INVERSE))
            x, y = _Windows(a, powers, inverse), _Windows(b, powers, inverse)

        def first(size: int, x=x, y=y, alo=alo, ahi=ahi, blo=blo, bhi=bhi) -> tuple[int, int] | None:
            known = np.sort(y.of(size, blo, bhi))
            asked = x.of(size, alo, ahi)
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            for i in np.flatnonzero(known[at] == asked).tolist():
                j = b.find(a[alo + i : alo + i + size], blo, bhi)
                if j >= 0:
                    return alo + i, j
            return None

        size, best, high, step = 0, None, min(n, m), 1
        while size < high:
            size_now = min(high, size + step) if step else (size + high + 1) // 2
            hit = first(size_now)
            if hit is None:
                high, step = size_now - 1, 0
                continue
            i, j = hit
            size, best = size_now, hit
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size, best = size + 1, None
            step *= 4
        if size:
            i, j = best or first(size)
            found.append((i, j, size))
            open_ += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """2 * matching / total characters; 0 as soon as a bound shows that `least` can't be reached."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    total = len(a) + len(b)
    if least:
        if 2 * min(len(a), len(b)) < least * total:
            return 0.0
        if 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
            return 0.0
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / total


def partial_ratio(short: str, text: str) -> float:
    """Best ratio of the shorter text against a window of the longer one that starts at a matching block."""
    if len(short) > len(text):
        short, text = text, short
    if not short:
        return 0.0
    best = 0.0
    for _, at, _ in SequenceMatcher(None, short, text, autojunk=False).get_matching_blocks():
        best = max(best, ratio(short, text[max(0, at) : max(0, at) + len(short)]))
    return best


def word_changes(a: str, b: str) -> list[tuple[str, str, str]]:
    x, y = a.split(), b.split()
    return [(tag, " ".join(x[i:j]), " ".join(y[k:m])) for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal"]


# Results depend on them. Turns looked back at, letters of a filler, and letters and likeness of an overlap.
LOOK_BACK, FILLER, OVERLAP, OVERLAP_LIKE, ENDING_LIKE = 3, 3, 12, 0.92, 0.94
MARKS = re.compile(r"""[\s"'`·•…,.!?:;()\[\]{}]+""")


def bare(message: str) -> str:
    """A message without blanks and marks."""
    return MARKS.sub("", message)


def shared_edge(tail: str, head: str, shortest: int = OVERLAP, least: float = OVERLAP_LIKE) -> int:
    """The largest n, `shortest` at least, for which the last n characters of tail and the first n of head are alike; 0 if
    there is none. Counts of characters, kept up from n to n, rule most lengths out before they are compared."""
    n = min(len(tail), len(head))
    surplus = Counter(tail[len(tail) - n :])
    surplus.subtract(head[:n])
    apart = sum(map(abs, surplus.values()))
    while n >= max(shortest, 1):
        if 2 * n - apart >= 2 * n * least and ratio(tail[-n:], head[:n]) >= least:
            return n
        for c, step in ((tail[len(tail) - n], -1), (head[n - 1], 1)):
            apart -= abs(surplus[c])
            surplus[c] += step
            apart += abs(surplus[c])
        n -= 1
    return 0


def past(message: str, n: int) -> str:
    """What follows the first n characters that are not blank."""
    places = [i for i, c in enumerate(message) if not c.isspace()]
    return " ".join(message[places[n - 1] + 1 :].split())


def _without_repeat(merged: list, batch: list, least: float) -> list:
    """The batch without its first turn, if one of the last turns says the same or ends with it, or without its second, if
    that repeats one of them after a filler."""

    def again(turn: tuple, ending: bool) -> bool:
        new = bare(turn[1])
        for speaker, message in merged[-LOOK_BACK:]:
            old = bare(message)
            if new and old and speaker == turn[0]:
                if ratio(old, new, least) >= least:
                    return True
                if ending and OVERLAP <= len(new) <= len(old) and ratio(old[-len(new) :], new, ENDING_LIKE) >= ENDING_LIKE:
                    return True
        return False

    if batch and again(batch[0], True):
        return batch[1:]
    if len(batch) > 1 and len(bare(batch[0][1])) <= FILLER and again(batch[1], False):
        return batch[:1] + batch[2:]
    return batch


def _without_overlap(merged: list, batch: list) -> list:
    """The batch whose first turn, or second after a filler, lacks what the last turn of its speaker ends with."""
    for at, turn in enumerate(batch[:2]):
        if turn[0] == merged[-1][0] and (at == 0 or len(bare(batch[0][1])) <= FILLER):
            n = shared_edge(bare(merged[-1][1]), bare(turn[1]))
            if n:
                rest = past(turn[1], n)
                return batch[:at] + ([(turn[0], rest)] if rest else []) + batch[at + 1 :]
    return batch


def append_turns(merged: list, batch: list, most: int, least: float) -> list:
    """Append a batch whose first turns may repeat the last ones: a repeat at the boundary goes, then the longest exact
    overlap in turns, then a similar one, then what the next turn repeats of the end of the last."""
    if not merged:
        return merged + batch
    batch = _without_repeat(merged, batch, least)
    tight = lambda x: "".join(x.split())
    exact = lambda p, q: tight(p) == tight(q)
    similar = lambda p, q: bool(bare(p) and bare(q)) and ratio(bare(p), bare(q), least) >= least
    for same in (exact, similar):
        for k in range(min(most, len(merged), len(batch)), 0, -1):
            if all(p[0] == q[0] and same(p[1], q[1]) for p, q in zip(merged[-k:], batch[:k])):
                batch = batch[k:]
                break
    return merged + _without_overlap(merged, batch)


def tidy_turns(turns: list) -> list:
    """Same-speaker merge, spam removal, near-duplicate removal against the last kept turn."""
    out: list = []
    for speaker, message in turns:
        dense = message.replace(" ", "")
        if len(dense) >= 10 and len(set(dense)) <= 2:
            continue
        if out and out[-1][0] == speaker and ratio(out[-1][1], message, 0.95) >= 0.95:
            out[-1] = (speaker, max(out[-1][1], message, key=len))
        elif out and out[-1][0] == speaker:
            out[-1] = (speaker, f"{out[-1][1]} {message}")
        else:
            out.append((speaker, message))
    return out


def _owners(side: list, numbers: dict) -> np.ndarray:
    """The number of the speaker of every character."""
    return np.repeat(np.array([numbers.setdefault(s, len(numbers)) for s, _ in side], np.int64), np.array([len(m) for _, m in side], np.int64))


def aligned_speakers(truth: list, predicted: list) -> list[tuple[str, str, int]]:
    texts = ["".join(m for _, m in side) for side in (truth, predicted)]
    numbers: dict = {}
    owners = [_owners(side, numbers) for side in (truth, predicted)]
    names, counts = list(numbers), Counter()
    for i, j, n in matching_blocks(*texts):
        pairs, many = np.unique(owners[0][i : i + n] * len(names) + owners[1][j : j + n], return_counts=True)
        counts.update(dict(zip(pairs.tolist(), many.tolist())))
    return sorted((names[p // len(names)], names[p % len(names)], n) for p, n in counts.items())


def error_spans(truth: list, predicted: list, least: int = 20, most: int = 20) -> list[tuple]:
    """(length, truth start, predicted start, truth speaker, predicted speaker) of the `most` longest runs of at least
    `least` aligned characters whose speakers differ; the speaker is the run's most frequent one."""
    texts = ["".join(m for _, m in side) for side in (truth, predicted)]
    numbers: dict = {}
    owners = [_owners(side, numbers) for side in (truth, predicted)]
    names, out = list(numbers), []
    for i, j, n in matching_blocks(*texts):
        wrong = owners[0][i : i + n] != owners[1][j : j + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], wrong, [False]]).astype(np.int8)))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= least:
                major = [names[Counter(side[at + begin : at + end].tolist()).most_common(1)[0][0]] for side, at in ((owners[0], i), (owners[1], j))]
                out.append((end - begin, i + begin, j + begin, *major))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:most]


def letters(text: str) -> str:
    """Lower case without blanks, Hangul syllables as compatibility letters."""
    out = []
    for c in text.lower():
        code = ord(c) - 0xAC00
        if c.isspace():
            continue
        out.append(INITIALS[code // 588] + VOWELS[code % 588 // 28] + FINALS[code % 28] if 0 <= code < 11172 else c)
    return "".join(out)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def phonetic_similarity(a: str, b: str) -> float:
    x, y = letters(a), letters(b)
    longest = max(len(x), len(y))
    return 1.0 - edit_distance(x, y) / longest if longest else 1.0


def cover_density(tokens: list[str], terms: list[str]) -> float:
    """Sum over shortest covers of all terms of 0.1 (one term) or terms / cover length."""
    need = set(terms)
    if not need <= set(tokens):
        return 0.0
    if len(need) == 1:
        return 0.1 * sum(t in need for t in tokens)
    total, last = 0.0, {}
    for i, t in enumerate(tokens):
        if t in need:
            last[t] = i
            if len(last) == len(need):
                begin = min(last.values())
                total += 0.1 * len(need) / (i - begin + 1)
                last = {k: v for k, v in last.items() if v > begin}
    return total


def split_text(text: str, size: int = 500, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest mark that allows it, each beginning `overlap` before the last cut."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in marks:
                cut = text.rfind(mark, at + overlap + 1, end)
                if cut > at + overlap:
                    end = cut + len(mark)
                    break
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out
