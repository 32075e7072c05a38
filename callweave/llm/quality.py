"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

features() makes one narrow pass over whole texts. fit() sums each class's first and second moments over all labelled
rows in Spark (class x feature pairs reach the driver, whatever the row count), shrinks each covariance to a mix of the
pooled covariance and its diagonal, and keeps the inverse Cholesky factors, so that scoring is one product a class. The
score is the posterior of label 1 from the difference of Gaussian log densities.

Defined cases: null and empty texts have the statistics of an empty text and a score; null labels are not learned from;
with one class or none labelled, every score is that class's share or 0.5; repeated rows count and are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, key_crc, materialise, read_table
from callweave.llm.kernels import Words, distinct_in_groups, mix, slices, text_buffer

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "wide": range(128, 256),
    "symbol": b"#*$%&|<>",
    "shout": b"!?",
    "pause": b".,;:",
    "other": b"\"'()+-/=@[\\]^_`{}~",
}
_CODE = np.zeros((256, len(_CLASSES)), np.float64)
for _i, _members in enumerate(_CLASSES.values()):
    _CODE[list(_members), _i] = 1
_CODE_OF = np.where(_CODE.any(axis=1), _CODE.argmax(axis=1), len(_CLASSES))
FEATURES = ["size", "words", *_CLASSES, "word_bytes", "distinct_words", "repeated_next", "repeated_triples", "top_word", "line_words"]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """text x feature: logarithms of sizes, square roots of shares."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * (len(_CLASSES) + 1) + _CODE_OF[raw], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    words = Words(raw, offsets)
    hashes, counts = words.hashes(), words.counts
    many = np.maximum(counts, 1).astype(float)
    of = np.repeat(np.arange(n), counts)
    kept = distinct_in_groups(hashes, counts)[1]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    triple = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else np.zeros(0, np.uint64)
    triple_of = of[:-2][of[:-2] == of[2:]] if len(hashes) > 2 else np.zeros(0, np.int64)
    triples = np.bincount(triple_of, minlength=n)
    single = distinct_in_groups(triple[of[:-2] == of[2:]], triples)[1] if len(triple_of) else np.zeros(n)
    # the commonest word of each text: longest run in the sorted hashes
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(hashes)]]))
    top = np.zeros(n)
    np.maximum.at(top, of[order][at], runs)
    lines = np.bincount(owner[raw == 10], minlength=n) + 1
    out = [np.log1p(size), np.log1p(counts)]
    out += [np.sqrt(kinds[:, i] / np.maximum(size, 1)) for i in range(len(_CLASSES))]
    out += [np.log1p(size / many), np.sqrt(kept / many), np.sqrt(np.bincount(of[same], minlength=n) / many), np.sqrt(1 - single / np.maximum(triples, 1)) * (triples > 0), np.sqrt(top / many), np.log1p(counts / lines)]
    return np.stack(out, axis=1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 17):
                x = statistics(*text_buffer(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_tasks, run, "doc_id long, x array<double>")


@dataclass
class Model:
    prior: np.ndarray  # of labels 0 and 1
    mean: np.ndarray
    whiten: np.ndarray  # inverse Cholesky factors of the class covariances
    offset: np.ndarray  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), self.prior[1])
        z = np.stack([o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.mean, self.whiten, self.offset)], axis=1)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, diagonal: float = 0.1, floor: float = 1e-4) -> Model:
    """labelled: x array<double>, label 0 or 1. shrink: weight of the pooled covariance; diagonal: of its diagonal."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column("label").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(label), -1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for k in np.unique(label):
                sums[int(k)] = sums.get(int(k), 0) + x[label == k].T @ x[label == k]
        for k, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(s.size, k, np.int32)), "i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "total": s.ravel()})

    rows = labelled.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "x")
    d = len(FEATURES) + 1
    sums = np.zeros((2, d, d))
    for r in rows.transform(in_tasks, moments, "label int, i int, j int, total double").groupBy("label", "i", "j").agg(F.sum("total").alias("total")).collect():
        sums[r["label"], r["i"], r["j"]] = r["total"]
    counts = sums[:, 0, 0]
    if (counts < 2).any():
        share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        return Model(np.array([1 - share, share]), np.zeros((0, d - 1)), np.zeros((0, d - 1, d - 1)), np.zeros(0))
    mean = sums[:, 0, 1:] / counts[:, None]
    scatter = np.stack([sums[k, 1:, 1:] - counts[k] * np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = scatter.sum(axis=0) / counts.sum()
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled))
    own = [(1 - shrink) * scatter[k] / counts[k] + shrink * pooled + floor * np.eye(d - 1) for k in (0, 1)]
    lower = np.linalg.cholesky(np.stack(own))
    prior = counts / counts.sum()
    return Model(prior, mean, np.linalg.inv(lower), np.log(prior) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows: doc_id, x. Gives doc_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": shared.value.score(x)})

    return rows.select("doc_id", "x").transform(in_tasks, run, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(key_crc(F.col("doc_id")) % 5 == 0, F.lit(False))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every whole text's score from a model of the labelled rows that are not held out."""
    rows = materialise(features(read_table(spark, sf_dir, "documents")), "quality-features")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter(~held_out())
    model = fit(rows.join(labels, "doc_id"))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
