"""Operator 10, token-id output: fixed-width bit packing with block offsets.

A segment is one byte string (all integers little-endian):

    magic "FWB1" | u8 bits | u24 ids in a block | u32 documents | u64 ids
    documents x i64 doc_id | (documents + 1) x u64 first id of a document
    (blocks + 1) x u64 byte offset of a block from the payload's start | payload

A block holds the same number of ids (the last may hold fewer), id i of a block in bits
[i * bits, (i + 1) * bits) of its little-endian bit stream; blocks begin at whole bytes, so any block,
document or id can be read alone.  Segments travel as rows of a Parquet table, because Spark's committer
makes that atomic and a task that is lost is simply written again; `export` writes them as files.

Documents with a null text have only the end id.  Rows that share a doc_id are all kept, in an order
given by their text; rows without a doc_id are left out.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored
from .tokens import encoder, sized_batches

MAGIC = b"FWB1"
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20
SEGMENT = "part int, segment int, documents long, ids long, bytes binary"
READ = "part int, segment int, doc_id long, start long, n_tokens long, ids binary"


def width(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of this size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as one little-endian bit stream."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of a bit stream, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=bits * count).reshape(count, bits)
    out = np.zeros((count, 32), np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


def build_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<u8")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64))).astype("<u8")
    head = MAGIC + bytes([bits]) + block.to_bytes(3, "little") + len(doc_ids).to_bytes(4, "little") + len(ids).to_bytes(8, "little")
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Random access to the bytes of one segment."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment")
        self.data, self.bits = memoryview(data), data[4]
        self.block, n = int.from_bytes(data[5:8], "little"), int.from_bytes(data[8:12], "little")
        self.size = int.from_bytes(data[12:20], "little")
        self.doc_ids = np.frombuffer(data, "<i8", n, 20)
        self.starts = np.frombuffer(data, "<u8", n + 1, 20 + 8 * n).astype(np.int64)
        blocks = -(-self.size // self.block)
        at = 28 + 16 * n
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64) + at + 8 * (blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), of which only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        held = [unpack(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.size - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(held)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_segments(docs: DataFrame, vocabulary: str, vocabulary_size: int, end_id: int, bytes_each: int = 16 << 20) -> DataFrame:
    """The table of segments of docs(doc_id, text), written to the shared folder.

    Documents are dealt out by ranges of doc_id, so partition numbers and the order within partitions
    give the order of the whole; the text crosses the network once and ids don't at all.
    """
    bits = width(vocabulary_size)
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal number, size
            ids = np.frombuffer(b"".join(held), "<u4")
            out = build_segment(doc_ids, [len(x) // 4 for x in held], ids, bits)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, number, len(doc_ids), len(ids), out), schema.types, strict=True)], schema=schema)
            number, size = number + 1, 0
            doc_ids.clear()
            held.clear()
            return row

        for b in sized_batches(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    parts = partitions_for(docs, bytes_each)  # of the table as it is stored: an estimate by columns knows no long texts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(run, SEGMENT), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """One row for each document: part, segment, doc_id, start within the segment, n_tokens, ids (u32 bytes)."""

    def run(batches):
        for b in batches:
            for part, number, data in zip(*(b.column(n).to_pylist() for n in ("part", "segment", "bytes")), strict=True):
                s = Segment(data)
                ids, lengths = s.read(0, s.size), np.diff(s.starts)
                for a in range(0, len(lengths), 2000):
                    z = min(a + 2000, len(lengths))
                    flat = ids[s.starts[a] : s.starts[z]]
                    offsets = pa.array(((s.starts[a : z + 1] - s.starts[a]) * 4).astype(np.int32))
                    column = pa.Array.from_buffers(pa.binary(), z - a, [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(z - a, part, np.int32)), pa.array(np.full(z - a, number, np.int32)), pa.array(s.doc_ids[a:z]), pa.array(s.starts[a:z]), pa.array(lengths[a:z]), column],
                        names=["part", "segment", "doc_id", "start", "n_tokens", "ids"],
                    )

    return segments.select("part", "segment", "bytes").mapInArrow(run, READ)


def with_global_start(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """`start` counted over all segments: two running sums, over a part's segments and over the parts.

    Only one row for each part (a few thousand at any size, for a part holds about 16 MB of files)
    meets in one task.
    """
    sizes = segments.select("part", "segment", F.col("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("part", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("segment_start")).join(parts, "part")
    at = at.select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("before"))
    return documents.join(at, ["part", "segment"]).withColumn("start", F.col("start") + F.col("before")).drop("before")


def export(segments: DataFrame, folder: str) -> int:
    """Write each segment as a file of its own to a folder of this machine; how many there were."""
    n = 0
    for row in segments.select("part", "segment", "bytes").toLocalIterator():
        with open(f"{folder}/{row.part:06d}-{row.segment:06d}.fwb", "wb") as f:
            f.write(row.bytes)
        n += 1
    return n


def digest(ids: bytes) -> int:
    return zlib.crc32(ids)
