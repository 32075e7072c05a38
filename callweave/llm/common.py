"""What the corpus operators share: tables in the shared folder, word patterns, tokenizer access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: One run of what separates words (space, tab to carriage return), as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory of this process back to the system: Arrow's and, where the C library can, numpy's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of a batch of rows on the way to a task's Python worker, one row at least. Each worker and its JVM hold some copies.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def in_tasks(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) whose tasks release what they freed. Spark reuses Python workers, and what each kind of
    task leaves in them adds up over a pipeline. Batches hold BATCH_BYTES at most, unless the session has its own setting."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return rows.mapInArrow(tidied, schema)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared root that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex}"


#: Slots of a filter of hashed keys. It is broadcast as one 64-bit mask a row, FILTER_SLOTS / 64 rows at most.
FILTER_SLOTS = 1 << 24


def likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in keys, and a few others; both have the columns `on`. A join on them follows: this only keeps
    most of what that join drops, texts above all, from being shuffled. What is broadcast has at most FILTER_SLOTS / 64
    rows whatever the corpus; with more keys than slots fewer rows are kept back and the join does the rest."""
    return _marked(rows, keys, on, True)


def unlikely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that likely() drops: their key is certainly not in keys."""
    return _marked(rows, keys, on, False)


def _marked(rows: DataFrame, keys: DataFrame, on: list[str], hit: bool) -> DataFrame:
    slot, word, mask = (fresh(x) for x in ("slot", "word", "mask"))
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_SLOTS))
    high = F.shiftright(slot, 6).cast("int").alias(word)
    masks = keys.select(place.alias(slot)).groupBy(high).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS INT)))").alias(mask))
    found = rows.withColumn(slot, place).withColumn(word, high).join(F.broadcast(masks), word, "inner" if hit else "left")
    return found.filter(F.coalesce(F.getbit(F.col(mask), (F.col(slot) % 64).cast("int")), F.lit(0)) == int(hit)).select(rows.columns)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is. lower() does the same for texts without other capital letters, and is faster."""
    others = r"[^\x00-\x7F&&[\p{IsUppercase}\p{IsTitlecase}]]"
    return F.when(text.rlike(others), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text: the fixed split into learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def computed(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """keep and the given columns, each computed once a row. A later lambda that names one of them would else have its
    expression put inside by the optimizer and worked out again for every array element; it doesn't look through a generator."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
