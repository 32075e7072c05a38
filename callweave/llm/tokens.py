"""Tokenizer access for tasks: whole texts to ids, each distinct piece encoded once a worker.

For a vocabulary file with the normaliser and splitter below, a text's ids are its pieces' ids in turn. Pieces are found
with numpy in the batch's bytes: runs of letters (ASCII and U+00C0 to U+00FF), single digits, runs of other ASCII signs;
a word with anything else (apostrophes, control signs, other letters) is one piece, which the library splits itself.
Pieces are looked up by a 64-bit hash of their lower-cased bytes in a table of bounded size; the library encodes those
not yet seen. Two pieces share a hash with a chance of 2**-45 for each one looked up. Pieces longer than LONGEST bytes
and words that can hold a special token are never kept. Files with another normaliser, splitter or model are recognised
on load, and the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from callweave.llm.kernels import BLANK, U, run_hashes, text_buffer

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: What the file must say for pieces to be independent of each other.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Table slots (a power of two), pieces kept at most, ids kept at most, bytes of a piece that is kept.
SLOTS, KEPT, KEPT_IDS, LONGEST = 1 << 21, 1 << 19, 1 << 21, 64
_SHIFT = U(65 - SLOTS.bit_length())
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _OTHER
_KIND[BLANK] = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, passing, runs): pieces of a batch's texts; passing ones are not to be kept, runs are of one kind."""
    n = len(raw)
    kind = _KIND[raw]
    pairs = np.flatnonzero(raw[: n - 1] == 0xC3) if n else np.zeros(0, np.int64)
    second = raw[pairs + 1]
    latin = (second != 0x97) & (second != 0xB7)
    pairs, second = pairs[latin], second[latin]
    kind[pairs] = kind[pairs + 1] = _LETTER
    capitals = pairs[second <= 0x9E] + 1
    if len(capitals):
        raw = raw.copy()
        raw[capitals] |= 0x20
    inside = kind != 0
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    word = inside.copy()
    word[1:] &= ~inside[:-1] | first[1:]
    begins = np.flatnonzero(word)
    blanks = np.concatenate([[0], np.cumsum(~inside)])
    ends_of = lambda starts: (last := np.append(starts[1:], n)) - (blanks[last] - blanks[starts])
    other = np.flatnonzero(kind == _OTHER)
    special = np.flatnonzero((raw[: n - 1] == 60) & (raw[1:] == 124)) if n else other
    uncut = np.unique(np.searchsorted(begins, np.concatenate([other, special]), "right") - 1)
    new = inside.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    if len(uncut):
        edge = np.zeros(n + 1, np.int8)
        edge[begins[uncut]] += 1
        np.subtract.at(edge, ends_of(begins)[uncut], 1)
        new &= np.cumsum(edge[:-1], dtype=np.int8) == 0
    starts = np.flatnonzero(new | word)
    runs = np.ones(len(starts), bool)
    runs[np.searchsorted(starts, begins[uncut])] = False
    ends = ends_of(starts)
    passing = ends - starts > LONGEST
    passing[np.searchsorted(starts, special, "right") - 1] = True
    return starts, ends, run_hashes(raw, starts, ends), passing, runs


class PieceEncoder:
    """encode() gives ids of whole texts. Its table holds KEPT pieces and KEPT_IDS ids at most, some 40 MB."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.by_piece = (
            (file["normalizer"], file["pre_tokenizer"], model["type"], model.get("end_of_word_suffix")) == (NORMALIZER, SPLITTER, "BPE", "</w>")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix"))
            and not file["truncation"]
            and all(t["content"].startswith("<|") and not any(x.isspace() for x in t["content"]) for t in file["added_tokens"])
        )
        self.ends_word = np.zeros(self.vocabulary, bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.begin, self.many, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, how many each has)."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        many = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(many.sum())), many

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_library() of texts that are one run each: encoded together, each ends with an id that ends a word."""
        ids, _ = self._library([" ".join(texts[i : i + 1000]) for i in range(0, len(texts), 1000)])
        upto = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(upto, prepend=0)) if len(upto) == len(texts) else self._library(texts)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for those not kept."""
        out = np.full(len(hashes), -1, np.int64)
        at, todo = (hashes >> _SHIFT).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            key = self.key[at]
            hit = key == hashes[todo]
            out[todo[hit]] = self.number[at[hit]]
            on = ~hit & (key != 0)
            todo, at = todo[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Add distinct hashes that are not there."""
        number = len(self.many) + np.arange(len(hashes), dtype=np.int32)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.ids = np.concatenate([self.ids, ids])
        at = (hashes >> _SHIFT).astype(np.int64)
        while len(hashes):
            free = self.key[at] == 0
            self.key[at[free]] = hashes[free]
            mine = free & (self.key[at] == hashes)
            self.number[at[mine]] = number[mine]
            hashes, number, at = hashes[~mine], number[~mine], (at[~mine] + 1) & (SLOTS - 1)

    def encode(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """column: Arrow strings. (ids of all texts in turn, how many each has); end_id follows each text's own ids."""
        if not self.by_piece:
            found = [x.ids + [end_id] * (end_id is not None) for x in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        raw, offsets = text_buffer(column)
        starts, ends, hashes, passing, runs = pieces(raw, offsets)
        hashes |= U(1)  # 0 marks a free slot
        number = self._find(hashes)
        number[passing] = -1
        missing = np.flatnonzero((number < 0) & ~passing)
        if len(missing):
            distinct, one = np.unique(hashes[missing], return_index=True)
            if len(self.many) + len(distinct) > KEPT or len(self.ids) > KEPT_IDS:
                self._clear()
                missing = np.flatnonzero(~passing)
                distinct, one = np.unique(hashes[missing], return_index=True)
            if len(distinct) > KEPT:  # a very long text: what doesn't fit is encoded where it stands
                passing |= np.isin(hashes, distinct[KEPT:])
                number[passing] = -1
                missing = np.flatnonzero((number < 0) & ~passing)
                distinct, one = np.unique(hashes[missing], return_index=True)
            text = raw.tobytes()
            for alike, learn in ((True, self._runs), (False, self._library)):
                some = runs[missing[one]] == alike
                at = missing[one[some]]
                self._keep(distinct[some], *learn([text[a:b].decode("utf-8", "replace") for a, b in zip(starts[at], ends[at])]))
            number[missing] = self._find(hashes[missing])
        source, begin, many = self.ids, self.begin, self.many
        extra = np.flatnonzero(passing)
        if len(extra):
            text = raw.tobytes()
            ids, own = self._library([text[a:b].decode("utf-8", "replace") for a, b in zip(starts[extra], ends[extra])])
            number[extra] = len(many) + np.arange(len(extra))
            source, begin, many = np.concatenate([source, ids]), np.concatenate([begin, len(source) + np.cumsum(own) - own]), np.concatenate([many, own])
        bounds = np.searchsorted(starts, offsets)
        if end_id is not None:
            number = np.insert(number, bounds[1:], len(many))
            bounds = bounds + np.arange(len(bounds))
            source, begin, many = np.append(source, np.uint32(end_id)), np.append(begin, len(source)), np.append(many, 1)
        width = many[number]
        upto = np.concatenate([[0], np.cumsum(width)])
        ids = source[np.arange(upto[-1]) + np.repeat(begin[number] - upto[:-1], width)]
        return ids, np.diff(upto[bounds])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; Spark reuses Python workers, so later tasks find the pieces that earlier ones met."""
    return PieceEncoder(path)
