"""Centroid clustering with a Walsh-Hadamard progressive search.

Vectors are whole numbers. Their Walsh-Hadamard transform is exact, and the squared distance of two transforms is the
length times that of the vectors. A task transforms its vectors and the centroids once, and adds up squared differences of
coefficients from coarse to fine (by sequency). After each stretch the centroid that leads a vector is finished to the last
coefficient; centroids whose partial sum is already larger than that are strictly worse and go. What is left is finished
over all coefficients, so ties stay ties and the smallest number wins.

A round moves sums, not vectors: each task adds up its vectors by centroid, Spark adds up the tasks' sums, and the driver
gets one row a centroid and component, whatever the corpus. The centroids are a broadcast of k vectors.

Defined cases: vectors that are null, of another length, with a null, NaN or infinite component, or with one beyond
+-65,536 (its integer would pass 24 bits, and sums of squares 64) are left out; null ids hash as an empty id; rows that
repeat an id are vectors of their own, in order of their components where ids tie; fewer vectors than centroids make as
many centroids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, materialise, read_table

SCALE = 256
LARGEST = 65_536.0
#: Pairs of a vector and a centroid that are looked at together.
PAIRS = 1 << 16


def quantised(rows: DataFrame, size: int = 64) -> DataFrame:
    """vec_id, v (whole numbers): the vectors that take part. size: a power of two."""
    x = F.col("embedding")
    fine = F.coalesce(F.size(x) == size, F.lit(False)) & F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double"))), F.lit(False))
    return rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("int")).alias("v"))


def _butterflies(rows: np.ndarray) -> np.ndarray:
    out, n, step = rows.astype(np.int64), rows.shape[1], 1
    while step < n:
        pairs = out.reshape(len(out), n // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        step *= 2
    return out


def walsh(rows: np.ndarray) -> np.ndarray:
    """The transform of each row; coefficients by the number of sign changes of their pattern, the mean first."""
    patterns = _butterflies(np.eye(rows.shape[1], dtype=np.int64))
    changes = (np.diff(patterns, axis=0) != 0).sum(axis=0)
    return _butterflies(rows)[:, np.argsort(changes, kind="stable")]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) of each vector."""
    fine = walsh(centroids)
    step = max(1, PAIRS // len(centroids))
    parts = [_progressive(walsh(vectors[at : at + step]), fine) for at in range(0, len(vectors), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _progressive(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = a.shape
    owner, number = np.repeat(np.arange(n), len(b)), np.tile(np.arange(len(b)), n)
    sums = np.zeros(len(owner), np.int64)
    low, high = 0, min(4, size)
    while True:
        sums += ((a[owner, low:high] - b[number, low:high]) ** 2).sum(axis=1)
        lead = _leaders(owner, sums)
        if high == size:
            return number[lead], sums[lead] // size
        bound = sums[lead] + ((a[:, high:] - b[number[lead], high:]) ** 2).sum(axis=1)
        alive = sums <= bound[owner]
        owner, number, sums = owner[alive], number[alive], sums[alive]
        low, high = high, 2 * high


def _leaders(owner: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Where each vector's smallest sum stands, the first of equal ones. Pairs ascend by vector and centroid."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    least = np.minimum.reduceat(sums, first)
    at = np.flatnonzero(sums == least[owner])
    return at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `2:` and their id."""
    place = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.select("v", place.alias("place")).orderBy("place", "v").limit(k).collect()], np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of their vectors' mean, or as they were where they have none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)  # the last column counts
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch)
                number, _ = nearest(v, shared.value)
                np.add.at(total, number, np.concatenate([v, np.ones((len(v), 1), v.dtype)], axis=1))
        some, width = np.flatnonzero(total[:, -1]), size + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width).astype(np.int32)), pa.array(np.tile(np.arange(width), len(some)).astype(np.int32)), pa.array(total[some].ravel())], ["cluster", "place", "total"])

    sums = vectors.transform(in_tasks, run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    shared.unpersist()
    total = np.zeros((k, size + 1), np.int64)
    for r in sums:
        total[r["cluster"], r["place"]] = r["total"]
    out = centroids.copy()
    some = total[:, -1] > 0
    out[some] = total[some, :-1] // total[some, -1:]
    return out


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_matrix(batch), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.transform(in_tasks, run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, size: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector that takes part; the centroids). rows: vec_id, embedding."""
    vectors = materialise(quantised(rows, size), "vectors")
    centroids = seeds(vectors, k)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    return materialise(_assigned(vectors, centroids), "assigned"), centroids


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every embedding's cluster, with sums of distances and the digest of its centroid."""
    assigned, centroids = cluster(read_table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    by_cluster = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(i, by_cluster.get(i, 0), sum(by_cluster.values()), d) for i, d in digests]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL: every vector against every centroid in each round."""
    near = "min(struct_pack(d := CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(k.v, c.v)]) AS BIGINT), c := c.c))"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding]))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.rid, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, {near} AS best FROM kept k, c{i} c GROUP BY k.rid)")
        if i < rounds:
            sums = f"SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2"
            parts.append(f"m{i} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS v FROM ({sums}) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""
WITH {', '.join(parts)}
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""
