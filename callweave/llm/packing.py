"""Packing by power-of-two decomposition: a document's ids become pieces whose lengths are powers of two, largest first,
and pieces of equal length share a bucket. Every piece is a sequence of its own: none crosses documents, none is padded.

decompose() gives the pieces with their ids; pack() stores them in one folder a length and reads them back.
Defined cases: null or empty text is its end id alone, a piece of one token; a text of any length is encoded whole, by the
task that reads it; null and repeated doc_ids stay as they are; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import in_tasks, read_table, shared_path
from callweave.llm.kernels import binaries, slices
from callweave.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def binary_lengths(tokens: np.ndarray, longest: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(owners, lengths) of the pieces in turn: `longest` as often as it fits, then the binary digits of the rest."""
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    digits = (tokens[:, None] % longest >> bits) & 1
    many = np.column_stack([tokens // longest, digits])
    owner, kind = np.divmod(np.repeat(np.arange(many.size), many.ravel()), many.shape[1])
    return owner, np.concatenate([[longest], 1 << bits])[kind]


def decompose(docs: DataFrame, longest: int = 2048, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """One row a piece; ids are little-endian unsigned 32-bit. sequence_id is the input partition's number and a running
    number in it, so it needs no shuffle and a repeated task gives the same ones."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, size=1 << 20):
                ids, totals = coder.encode(part.column("text"), end_id)
                owner, lengths = binary_lengths(totals, longest)
                upto = np.cumsum(lengths)
                starts = upto - lengths - (np.cumsum(totals) - totals)[owner]
                n = len(owner)
                columns = [part.column("doc_id").take(pa.array(owner)), starts, lengths, binaries(ids.astype("<u4", copy=False), lengths), totals[owner], np.arange(number, number + n), np.zeros(n, np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                number += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_tasks, pieces, SCHEMA)


def pack(docs: DataFrame, folder: str, longest: int = 2048, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """decompose(), stored in `folder` with one sub-folder (bucket) a length, and read back."""
    made = decompose(docs, longest, tokenizer, end_id)
    made.write.partitionBy("length").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder).select(made.columns)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document packed, each piece with the checksum of its stored ids."""
    return digest(pack(read_table(spark, sf_dir, "documents"), shared_path(spark, "packed")))
