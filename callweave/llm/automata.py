"""Weighted acyclic automata over sequences of words, as arrays.

An automaton reads sequences of a fixed depth; label 0 ends a shorter one. Level by level it has states, each a run of arcs
(label, target), labels ascending; arcs of the last level carry weights. It is built from sorted, distinct sequences the
incremental way: a state is finished once the next sequence leaves its prefix, finished states are looked up in a register,
and equal ones (same labels, targets and weights) become one. Here a whole sorted block is taken at once, from the last
level up, so the register of a level is one sort.

The weight of a prefix is the sum of the weights below it. union() walks many automata together from the root, adds up the
weights of each prefix and leaves a prefix once its sum is too small, so what is below rare prefixes is never expanded.
compose() walks two automata together and gives the first one's weights of the second one's sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from callweave.llm.kernels import U, mix


@dataclass
class Level:
    starts: np.ndarray  # first arc of each state, and the number of arcs
    labels: np.ndarray
    targets: np.ndarray  # state of the next level; on the last level the weight


@dataclass
class Automaton:
    words: pa.Array  # binary, ascending; label i is words[i - 1]
    levels: list[Level]


def build(words: pa.Array, columns: Sequence[np.ndarray], weights: np.ndarray) -> Automaton:
    """columns: labels of sorted, distinct sequences, one array a depth."""
    n, depth = len(weights), len(columns)
    new = np.zeros(n, bool)
    new[:1] = True
    opens = []  # of each depth: where a prefix of so many labels begins
    for c in columns[:-1]:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        opens.append(new)
    rows, targets, levels = np.arange(n), weights.astype(np.int64), []
    for d in range(depth - 1, -1, -1):
        first = np.flatnonzero(opens[d - 1][rows]) if d else np.zeros(min(1, n), np.int64)
        labels = columns[d][rows].astype(np.int64)
        level, state = _registered(first, labels, targets)
        levels.append(level)
        rows, targets = rows[first], state
    return Automaton(words, levels[::-1])


def _registered(first: np.ndarray, labels: np.ndarray, targets: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of the distinct states, and the state of each run of arcs."""
    if not len(first):
        return Level(np.zeros(1, np.int64), labels, targets), np.zeros(0, np.int64)
    ends = np.append(first[1:], len(labels))
    sizes = ends - first
    arc = mix(mix(labels.astype(np.uint64)) ^ targets.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    _, chosen, state = np.unique(np.add.reduceat(arc, first) + sizes.astype(np.uint64), return_index=True, return_inverse=True)
    # a signature is a hash: runs that share one are compared arc by arc
    like = chosen[state]
    same = (sizes == sizes[like]).all()
    if same:
        at = np.repeat(first[like] - first, sizes) + np.arange(len(labels))
        same = (labels == labels[at]).all() and (targets == targets[at]).all()
    if not same:
        chosen = state = np.arange(len(first))
    order = np.argsort(chosen)  # states are numbered by where they first occur
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    chosen = chosen[order]
    arcs = _runs(first[chosen], sizes[chosen])
    return Level(np.concatenate([[0], np.cumsum(sizes[chosen])]), labels[arcs], targets[arcs]), number[state]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def dump(a: Automaton) -> bytes:
    """One compressed block: each array as its width, its length and its numbers in as few bytes as they need."""
    _, offsets, data = a.words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[a.words.offset : a.words.offset + len(a.words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(a.words) else np.zeros(0, np.uint8)
    arrays = [raw, np.diff(offsets)]
    for level in a.levels:
        arrays += [np.diff(level.starts), level.labels, level.targets]
    out = []
    for values in map(_narrow, arrays):
        out += [np.array([values.dtype.itemsize, len(values)], np.int64).tobytes(), values.tobytes()]
    whole = b"".join(out)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def load(block: bytes) -> Automaton:
    whole = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    at, arrays = 0, []
    while at < len(whole):
        width, n = np.frombuffer(whole, np.int64, 2, at)
        arrays.append(np.frombuffer(whole, f"<u{width}", n, at + 16))
        at += 16 + int(width) * int(n)
    raw, sizes, *rest = arrays
    levels = [Level(np.concatenate([[0], np.cumsum(rest[i], dtype=np.int64)]), rest[i + 1].astype(np.int64), rest[i + 2].astype(np.int64)) for i in range(0, len(rest), 3)]
    return Automaton(binary(raw, sizes), levels)


def binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of the runs of so many bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words ascending by bytes, label of each word)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _together(parts: Sequence[Automaton]) -> Automaton:
    """All parts side by side over one list of words: state i of the first level is the root of part i."""
    words, labels = ranked(pa.concat_arrays([p.words for p in parts]))
    begin = np.concatenate([[0], np.cumsum([len(p.words) for p in parts])])
    levels = []
    for d in range(len(parts[0].levels)):
        last = d == len(parts[0].levels) - 1
        starts, names, targets, arcs, states = [], [], [], 0, 0
        for i, p in enumerate(parts):
            level = p.levels[d]
            starts.append(level.starts[:-1] + arcs)
            names.append(np.concatenate([[0], labels[begin[i] : begin[i + 1]]]).astype(np.int64)[level.labels])
            targets.append(level.targets if last else level.targets + states)
            arcs += len(level.labels)
            states += 0 if last else len(p.levels[d + 1].starts) - 1
        levels.append(Level(np.append(np.concatenate(starts), arcs), np.concatenate(names), np.concatenate(targets)))
    return Automaton(words, levels)


def union(parts: Sequence[Automaton], least: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, sum of weights) of every prefix whose sum is `least` or more, and of those on the first and the last path,
    whose sum may go on in a neighbouring range."""
    parts = [p for p in parts if len(p.levels[-1].labels)]
    if not parts:
        return
    all_ = _together(parts)
    below, totals = None, []  # weights below each arc, by level
    for level in reversed(all_.levels):
        arcs = level.targets if below is None else below[level.targets]
        totals.append(arcs)
        below = np.add.reduceat(arcs, level.starts[:-1])
    totals.reverse()
    group, state = np.zeros(len(parts), np.int64), np.arange(len(parts))
    paths: list[list[bytes]] = [[]]
    for level, total in zip(all_.levels, totals):
        sizes = level.starts[state + 1] - level.starts[state]
        arcs = _runs(level.starts[state], sizes)
        key = np.repeat(group, sizes) << 32 | level.labels[arcs]
        order = np.argsort(key, kind="stable")
        key, arcs = key[order], arcs[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return
        sums = np.add.reduceat(total[arcs], first)
        kept = sums >= least
        kept[[0, -1]] = True
        labels = key[first] & 0xFFFFFFFF
        kept &= labels > 0
        chosen = np.flatnonzero(kept)
        names = all_.words.take(pa.array(labels[chosen] - 1)).to_pylist()
        paths = [[*paths[g], w] for g, w in zip((key[first[chosen]] >> 32).tolist(), names)]
        yield from zip(paths, sums[chosen].tolist())
        number = np.cumsum(kept) - 1
        run = np.cumsum(np.bincount(first, minlength=len(key))) - 1
        on = kept[run]
        group, state = number[run[on]], level.targets[arcs[on]]


def compose(counts: Automaton, asked: Automaton) -> np.ndarray:
    """The weight in `counts` of each sequence of `asked`, in their order; 0 where it has none."""
    _, labels = ranked(pa.concat_arrays([counts.words, asked.words]))
    of_counts = np.concatenate([[0], labels[: len(counts.words)]]).astype(np.int64)
    of_asked = np.concatenate([[0], labels[len(counts.words) :]]).astype(np.int64)
    here, there = np.zeros(1, np.int64), np.zeros(1, np.int64)  # here: -1 once a sequence has left `counts`
    for a, b in zip(counts.levels, asked.levels):
        sizes = b.starts[there + 1] - b.starts[there]
        arcs = _runs(b.starts[there], sizes)
        here, there = np.repeat(here, sizes), b.targets[arcs]
        owner = np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts))
        known = owner << 32 | of_counts[a.labels]  # ascending, as states and their labels are
        want = here << 32 | of_asked[b.labels[arcs]]
        at = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
        hit = (here >= 0) & (known[at] == want) if len(known) else np.zeros(len(want), bool)
        here = np.where(hit, a.targets[at] if len(known) else -1, -1)
    return np.maximum(here, 0)
