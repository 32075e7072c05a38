"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of about FRAME bytes of whole WARC records, closed by a seek
table in a skippable frame (public seekable format: a row of compressed and plain size a frame, then the frame count, a
descriptor and a magic number). Any zstd tool reads a bundle from start to end; with the seek table and the index
(record id, bundle, frame, offset in the plain frame, length) one record costs one frame.

Records with equal payloads of at least `least` bytes are stored once: the smallest page_id's is a response, the others
are revisits that name it. Payload digests are compared, so the join moves ids and digests; a digest of many pages is
counted before it is shuffled, and the join with the stored table of repeated digests is one whose large partitions Spark
can split.

Defined cases: null html is an empty payload, null url an empty target; a null page_id is a record without id, never the
one that others revisit unless all its copies have none (then each is a response); a repeated page_id with the same
payload is a response each time; an empty table gives no bundle; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.bitpack import _filesystem
from callweave.llm.common import in_tasks, materialise, read_table, shared_path

FRAME = 1 << 20
BUNDLE = 1 << 28  # plain bytes after which a task begins another bundle
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its size and digest."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, where the next record begins) of the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 4 + size + 4


class BundleWriter:
    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.coder = sink, zstandard.ZstdCompressor(level=level)
        self.waiting = bytearray()
        self.table: list[tuple[int, int]] = []
        self.plain = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the plain frame)."""
        if self.waiting and len(self.waiting) + len(data) > FRAME:
            self._flush()
        at = len(self.table), len(self.waiting)
        self.waiting += data
        self.plain += len(data)
        return at

    def _flush(self) -> None:
        packed = self.coder.compress(bytes(self.waiting))
        self.sink.write(packed)
        self.table.append((len(packed), len(self.waiting)))
        self.waiting = bytearray()

    def close(self) -> None:
        if self.waiting:
            self._flush()
        rows = b"".join(struct.pack("<II", *x) for x in self.table)
        foot = rows + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(foot)) + foot)


class BundleReader:
    def __init__(self, source):
        import zstandard

        self.source, self.coder = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        flat = struct.unpack(f"<{2 * count}I", source.read(8 * count))
        self.sizes = list(zip(flat[::2], flat[1::2]))
        self.offsets = [0]
        for packed, _ in self.sizes:
            self.offsets.append(self.offsets[-1] + packed)

    def frame(self, i: int) -> bytes:
        self.source.seek(self.offsets[i])
        return self.coder.decompress(self.source.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with payload_digest and refers_to (null: a response). pages: page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    repeated = materialise(large.select("payload_digest", "first"), "repeated-payloads")
    return rows.join(repeated, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_bundles(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes the bundles and gives the stored index, one row a record (INDEX)."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, writer = TaskContext.get(), 0, None
        files, root = _filesystem(folder)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if writer is None:
                    files.create_dir(root, recursive=True)
                    name = f"bundle-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink)
                    number += 1
                data = record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], "response" if r["refers_to"] is None else "revisit", r["refers_to"])
                frame, offset = writer.add(data)
                out.append((f"urn:page:{'' if r['page_id'] is None else r['page_id']}", r["page_id"], f"{folder}/{name}", frame, offset, len(data)))
                if writer.plain >= BUNDLE:
                    writer.close()
                    sink.close()
                    writer = None
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()
            sink.close()

    return materialise(revisits(pages, least).transform(in_tasks, bundles, INDEX), "warc-index")


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles in the index: page_id, payload_bytes, payload_digest (checked against the payload of
    a response), record_type, refers_to, and a response's payload on demand."""
    places = index.groupBy("bundle").agg(F.max("frame").alias("frames"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["bundle"]:
                files, name = _filesystem(path)
                with files.open_input_file(name) as source:
                    reader = BundleReader(source)
                    for i in range(len(reader.sizes)):
                        data, at, out = reader.frame(i), 0, []
                        while at < len(data):
                            head, payload, at = parse(data, at)
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{head['WARC-Record-ID']} in {path}: payload and digest differ")
                            own, other = (head.get(k, "").strip("<>").removeprefix("urn:page:") for k in ("WARC-Record-ID", "WARC-Refers-To"))
                            out.append((int(own) if own else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(other) if other else None) + ((payload if head["WARC-Type"] == "response" else None,) if with_payload else ()))
                        table = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload])
                        yield table.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    stored = materialise(places, "bundles")
    return stored.repartition(max(1, stored.count())).mapInPandas(read, schema)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page through bundles and back."""
    return read_bundles(write_bundles(read_table(spark, sf_dir, "pages"), shared_path(spark, "warc")))
