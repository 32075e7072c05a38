"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are its byte 3-grams and 4-grams (A-Z lower-cased, other ASCII signs one boundary byte), hashed into
2**16 buckets. Its vector is the mean of its subwords' embeddings; class scores are linear in it. fit() learns both by
stochastic gradient descent in numpy on at most `sample` labelled rows, those with the smallest hashes of id and text
(the documented bound of the fit; ties go by language and counts, so repeated ids change nothing); a fifth of them sets the temperature and the rejection level. predict() is one narrow pass over whole
texts: as everything is linear, a subword adds one row of the table embeddings x weights.

Defined cases: null text and text without a letter give `und` with score 0; null lang is never learned from; without any
labelled row everything is `und`; equal chances go to the first label in order; a text of any length is read whole, by one
task, in numpy arrays of some 30 bytes a byte of it; repeated rows are predicted each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, key_crc, read_table
from callweave.llm.kernels import slices, text_buffer

BUCKETS = 1 << 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x label: embeddings times weights, divided by the temperature
    bias: np.ndarray
    level: float  # texts with a lower score are rejected


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): the hashed 3- and 4-grams of each text; none spans two texts or lies on boundaries alone."""
    folded = _FOLD[raw].astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, owners = [], []
    for width, factor in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if len(folded) < width:
            continue
        n = len(folded) - width + 1
        code = folded[:n].copy()
        for j in range(1, width):
            code |= folded[j : n + j] << np.uint32(8 * j)
        fine = (owner[:n] == owner[width - 1 :]) & (code & np.uint32(0xFFFFFF) != 0x202020)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(factor)
        code ^= code >> np.uint32(13)
        out.append((code[fine] * np.uint32(0xC2B2AE3D)) >> np.uint32(16))
        owners.append(owner[:n][fine])
    return (np.concatenate(out), np.concatenate(owners)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=1 << 17):
            raw, offsets = text_buffer(part.column("text"))
            buckets, owners = subwords(raw, offsets)
            keys, counts = np.unique(owners.astype(np.int64) << 16 | buckets.astype(np.int64), return_counts=True)
            cuts = np.searchsorted(keys >> 16, np.arange(part.num_rows + 1))
            ids = [(keys[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            many = [counts[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict({"place": part.column("place"), "lang": part.column("lang"), "ids": ids, "many": many})


def _counted_rows(rows: DataFrame) -> DataFrame:
    return rows.transform(in_tasks, _counted, "place long, lang string, ids binary, many binary")


def fit(docs: DataFrame, sample: int = 3000, size: int = 16, epochs: int = 6, rate: float = 0.4, lost: float = 0.002, seed: int = 7) -> Model:
    """docs: text, lang, doc_id. lost: share of the calibration rows that the rejection level may reject."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # the text is part of the place, so that rows are told apart where ids are missing or repeated
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("place"))
    total = docs.filter(F.col("lang").isNotNull()).count()
    share = min(1.0, 1.25 * sample / max(total, 1))
    top = F.lit(min(int((2.0 * share - 1.0) * 2**63), 2**63 - 1))
    # rows that are alike in id and text tie: their langs come in the order of a hash
    order = ["place", F.xxhash64("lang", F.lit(seed)), "lang", "ids", "many"]
    chosen = _counted_rows(rows.filter(F.col("place") <= top)).orderBy(*order).limit(sample).collect()
    if share < 1 and len(chosen) < sample:  # many alike rows beyond the bound
        chosen = _counted_rows(rows).orderBy(*order).limit(sample).collect()
    chosen = sorted(chosen, key=lambda r: (r["lang"], r["ids"], r["many"]))
    labels = sorted({r["lang"] for r in chosen})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    rng = np.random.default_rng(seed)
    ids = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in chosen]
    weights = [(w := np.frombuffer(r["many"], "<u4").astype(np.float32)) / max(1.0, w.sum()) for r in chosen]
    truth = np.array([labels.index(r["lang"]) for r in chosen])
    order = rng.permutation(len(chosen))
    held = order[: max(1, len(order) // 5)]
    learned = order[len(held) :] if len(order) > 1 else order
    table = rng.uniform(-1, 1, (BUCKETS, size)).astype(np.float32) / size
    linear = np.zeros((size, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = max(1, epochs * len(learned)), 0
    for _ in range(epochs):
        rng.shuffle(learned)
        for at in range(0, len(learned), 16):
            batch = learned[at : at + 16]
            step = rate * (1 - done / steps) * 16
            done += len(batch)
            where, share_of = np.concatenate([ids[i] for i in batch]), np.concatenate([weights[i] for i in batch])
            if not len(where):
                continue
            owner = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            mean = np.zeros((len(batch), size), np.float32)
            np.add.at(mean, owner, table[where] * share_of[:, None])
            score = mean @ linear + bias
            error = np.exp(score - score.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), truth[batch]] -= 1
            error /= len(batch)
            back = error @ linear.T
            linear -= step * (mean.T @ error)
            bias -= step * error.sum(axis=0)
            np.subtract.at(table, where, step * len(batch) * share_of[:, None] * back[owner])
    flat = table @ linear
    scores = np.array([weights[i] @ flat[ids[i]] + bias if len(ids[i]) else bias for i in held])
    heat = min(np.geomspace(0.02, 20, 61), key=lambda t: -_log_softmax(scores / t)[np.arange(len(held)), truth[held]].mean())
    best = np.exp(_log_softmax(scores / heat)).max(axis=1)
    level = float(np.quantile(best, lost, method="lower"))
    return Model(labels, np.ascontiguousarray(flat / heat, np.float32), (bias / heat).astype(np.float32), min(level, 0.9))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _scored(part: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label number, or the number of labels for none; score; rejected) of each text of a batch."""
    texts = part.column("text")
    raw, offsets = text_buffer(texts)
    n, labels = part.num_rows, len(model.labels)
    lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    best, top = np.full(n, labels), np.zeros(n)
    if labels and n:
        buckets, owners = subwords(raw, offsets)
        many = np.maximum(np.bincount(owners, minlength=n), 1)
        logits = np.stack([np.bincount(owners, model.table[:, k][buckets], n) / many + model.bias[k] for k in range(labels)], axis=1)
        chance = np.exp(_log_softmax(logits))
        best = np.where(lettered, chance.argmax(axis=1), labels)
        top = np.where(lettered, np.minimum(chance.max(axis=1), 1.0), 0.0)
    return best, top, (top < model.level) | (best == labels)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, lang_pred, score, rejected (no letter, or score below the model's level)."""
    model.table = np.asfortranarray(model.table)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.labels, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                best, top, rejected = _scored(part, shared.value)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(names[best], pa.string()), "score": top, "rejected": rejected})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_tasks, score, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; same columns, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                yield part.filter(pa.array(~_scored(part, shared.value)[2]))

    return docs.transform(in_tasks, run, docs.schema)


def held_out() -> Column:
    return F.coalesce(key_crc(F.col("doc_id")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, **options) -> Model:
    """fit() on the rows that are not held out."""
    return fit(docs.filter(~held_out()), **options)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text's language from a model of the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
