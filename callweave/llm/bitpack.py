"""Token-ID / binary output: fixed-width bit packing with block offsets.

File layout (little-endian): magic; blocks, each the ids of BLOCK consecutive tokens in the fewest bits that hold the
vocabulary; the tables of document ids, their validity, and token starts; block offsets; a fixed-size trailer with
counts, bit width and where the tables begin. Any token range is read from the blocks that hold it alone.

write_tokens() encodes documents in ascending doc_id order, one file a partition; read_tokens() gives the documents back.
Defined cases: null or empty text is the end id alone; a text of any length is encoded whole; null doc_id sorts first;
repeated ids stay, in order of a hash of their text; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, read_table, shared_path
from callweave.llm.kernels import slices
from callweave.llm.tokens import default_path, encoder

MAGIC = b"BITIDS01"
BLOCK = 1 << 16
_TRAILER = struct.Struct("<QQQQI4x8s")  # tokens, documents, blocks, where tables begin, bits, magic


def width_of(vocabulary: int) -> int:
    """Fewest bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    table = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(table.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    table = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (table.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    """Streams ids into one file; only a block and the document table are held."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.keys: list[int | None] = []
        self.starts = [0]
        self.offsets: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.at = sink.write(MAGIC)

    def add(self, keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in turn: their keys, how many ids each has, all their ids."""
        self.keys += keys
        self.starts += (self.starts[-1] + np.cumsum(counts)).tolist()
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for a in range(0, upto, BLOCK):
            data = pack(ids[a : min(a + BLOCK, upto)], self.bits)
            self.offsets.append(self.at)
            self.at += self.sink.write(data)
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.held)
        tables = self.at
        valid = np.array([k is not None for k in self.keys], np.uint8)
        for part in (np.array([k or 0 for k in self.keys], "<i8"), valid, np.array(self.starts, "<i8"), np.array(self.offsets, "<i8")):
            self.sink.write(part.tobytes())
        self.sink.write(_TRAILER.pack(self.starts[-1], len(self.keys), len(self.offsets), tables, self.bits, MAGIC))


class Reader:
    """Random access to one file of the format."""

    def __init__(self, source):
        size = source.size()
        self.source = source
        source.seek(size - _TRAILER.size)
        self.tokens, self.documents, self.blocks, self.tables, self.bits, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(self.tables)
        data, n = source.read(size - _TRAILER.size - self.tables), self.documents
        self.keys = np.frombuffer(data, "<i8", n)
        self.valid = np.frombuffer(data, np.uint8, n, 8 * n)
        self.starts = np.frombuffer(data, "<i8", n + 1, 9 * n)
        self.offsets = np.frombuffer(data, "<i8", self.blocks, 17 * n + 8)

    def range(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end, from the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first, last = begin // BLOCK, (end - 1) // BLOCK
        self.source.seek(int(self.offsets[first]))
        stop = int(self.offsets[last + 1]) if last + 1 < self.blocks else self.tables
        data = self.source.read(stop - int(self.offsets[first]))
        count = min(self.tokens, (last + 1) * BLOCK) - first * BLOCK
        if self.bits in (8, 16, 32) or first == last:
            ids = unpack(data, count, self.bits)
        else:
            cut = int(self.offsets[first + 1] - self.offsets[first])
            ids = np.concatenate([unpack(data[i * cut : (i + 1) * cut], min(BLOCK, count - i * BLOCK), self.bits) for i in range(last - first + 1)])
        return ids[begin - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode and write; returns the manifest (shard, path, documents, tokens), one row a file, shards in doc_id order.

    Work is one range shuffle of the texts; a task streams its part into a file of its own name for each attempt, so a
    repeated or speculative task never touches another's file and the manifest names the one that counted.
    """
    path = tokenizer or default_path()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        coder, writer = encoder(path), None
        for batch in batches:
            for part in slices(batch, size=1 << 20):
                if writer is None:
                    files, root = _filesystem(folder)
                    files.create_dir(root, recursive=True)
                    name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = Writer(sink, width_of(coder.vocabulary))
                ids, counts = coder.encode(part.column("text"), end_id)
                writer.add(part.column("doc_id").to_pylist(), counts, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/{name}"], "documents": pa.array([len(writer.keys)], pa.int64()), "tokens": pa.array([writer.starts[-1]], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges are cut by id and text hash, as what is sampled for them goes to the driver; a text is compared in its task alone
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, F.col("text").asc_nulls_first())
    written = ordered.transform(in_tasks, shard, "shard long, path string, documents long, tokens long")
    written.write.parquet(f"{folder}-manifest")
    return docs.sparkSession.read.schema(written.schema).parquet(f"{folder}-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids on demand."""
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"]):
                files, name = _filesystem(path)
                with files.open_input_file(name) as source:
                    reader = Reader(source)
                    step = 2048
                    for a in range(0, reader.documents, step):
                        b = min(a + step, reader.documents)
                        low = int(reader.starts[a])
                        ids = reader.range(low, int(reader.starts[b]))
                        bounds = reader.starts[a : b + 1] - low
                        own = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                        out = {"doc_id": pd.array(np.where(reader.valid[a:b] == 1, reader.keys[a:b], 0), "Int64"), "start": reader.starts[a:b] + base, "n_tokens": np.diff(bounds), "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]}
                        out["doc_id"][reader.valid[a:b] == 0] = pd.NA
                        yield pd.DataFrame(out | ({"ids": [x.tolist() for x in own]} if with_ids else {}))[columns]

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.repartition(max(1, manifest.count())).mapInPandas(read, schema)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents through files of packed ids and back."""
    folder = shared_path(spark, "token-ids")
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), folder))
