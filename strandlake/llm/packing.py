"""Operator 5, packing: lexical retrieval into windows of fixed length.

1. Every document becomes its token ids and an end id; a signature of its pairs of neighbouring ids (from
   the pair of the least hash) goes with it.  The table is written once.
2. Documents are dealt out by ranges of (signature, doc_id): texts that share passages come to lie in one
   shard, and a large group of copies is split over as many shards as it needs.
3. Each shard keeps a BM25 inverted index of its pieces' ids.  Whole windows of long documents are cut off
   first; then each piece that is left seeds a window, asks the index for unused neighbours and takes them
   from the best score downwards.  The neighbour that doesn't fit is cut, and what is left of it goes back.
   Where no neighbour shares a term, the next unused piece in order is taken.

So every window but a shard's last is full.  A shard holds at most SHARD_IDS ids (a document that is longer
is one shard): memory is bounded, and no shard depends on another.

A null text is empty and has only the end id.  Rows that repeat a doc_id are packed one by one, rows without
one are left out.  Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, stored
from .tokens import encoder, sized_batches

SHARD_IDS = 1 << 20
K1, B = 1.2, 0.75
#: The shard and the sequence within it share a sequence_id's 63 bits.
SHARDS_A_PART, SEQUENCES_A_SHARD = 1 << 16, 1 << 24
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def signature(ids: np.ndarray) -> int:
    """A hash of the pair of neighbouring ids that has the least hash.

    The least hash itself falls with a text's length, and ranges of it would put all long texts into one.
    """
    if len(ids) < 2:
        return -1
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]
    pairs *= np.uint64(0x9E3779B97F4A7C15)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    least = int(pairs.min())
    mixed = (least ^ least >> 30) * 0x94D049BB133111EB & (1 << 64) - 1
    return (mixed ^ mixed >> 31) >> 1


class Index:
    """BM25 over the ids of a shard's pieces, as postings sorted by id."""

    def __init__(self, pieces: list[np.ndarray]):
        n = len(pieces)
        counted = [np.unique(p, return_counts=True) for p in pieces]
        self.terms = [t for t, _ in counted]
        term = np.concatenate(self.terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float32) if n else np.zeros(0, np.float32)
        owner = np.repeat(np.arange(n), [len(t) for t in self.terms])
        lengths = np.array([len(p) for p in pieces], np.float32)
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        self.vocabulary, first, df = np.unique(term[order], return_index=True, return_counts=True)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, float(lengths.mean()) if n else 1.0))
        tf = tf[order]
        self.weight = np.repeat(np.maximum(idf, 0), df) * tf * (K1 + 1) / (tf + norm[self.owner])
        # Terms that half of all pieces hold have no weight: their postings are left out.
        self.first, self.df = first, np.where(idf > 0, df, 0)
        self.n = n

    def scores(self, query: int) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, self.terms[query])
        first, df = self.first[at], self.df[at]
        total = int(df.sum())
        if not total:
            return np.zeros(self.n)
        begin = np.concatenate(([0], np.cumsum(df)[:-1]))
        places = np.repeat(first - begin, df) + np.arange(total)
        return np.bincount(self.owner[places], self.weight[places], self.n)


def pack_shard(documents: list[tuple[int, np.ndarray]], window: int):
    """(doc_id, start, doc_tokens, ids) of each piece of each sequence of a shard, sequence by sequence."""
    rest: list[tuple[int, int]] = []  # document, start of what is left
    for d, (doc_id, ids) in enumerate(documents):
        whole = len(ids) // window * window
        for at in range(0, whole, window):
            yield [(doc_id, at, len(ids), ids[at : at + window])]
        if whole < len(ids):
            rest.append((d, whole))
    index = Index([documents[d][1][at:] for d, at in rest])
    begin = np.array([at for _, at in rest], np.int64)
    left = np.array([len(documents[d][1]) - at for d, at in rest], np.int64)
    next_free = 0

    def take(k: int, room: int):
        n = min(int(left[k]), room)
        doc_id, ids = documents[rest[k][0]]
        piece = (doc_id, int(begin[k]), len(ids), ids[begin[k] : begin[k] + n])
        begin[k] += n
        left[k] -= n
        return piece, n

    for seed in range(len(rest)):
        while left[seed]:
            sequence, room = [], window
            piece, n = take(seed, room)
            sequence.append(piece)
            room -= n
            if room:
                score = np.where(left > 0, index.scores(seed), 0.0)
                # As many of the best as could be needed, then the others that score at all.
                best = np.argpartition(-score, min(64, len(score) - 1))[:64]
                for group in (best, None):
                    if group is None:
                        group = np.flatnonzero(score > 0) if room else best[:0]
                    for k in group[np.lexsort((group, -score[group]))]:
                        if not room or score[k] <= 0:
                            break
                        if left[k]:
                            piece, n = take(int(k), room)
                            sequence.append(piece)
                            room -= n
                while room:
                    while next_free < len(rest) and not left[next_free]:
                        next_free += 1
                    if next_free == len(rest):
                        break
                    piece, n = take(next_free, room)
                    sequence.append(piece)
                    room -= n
            yield sequence


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, signature and ids (unsigned, 16 bits where the vocabulary allows) of each document."""
    width = 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def run(batches):
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in sized_batches(batches):
            marks, found = [], []
            for data in encode([t or "" for t in b.column(1).to_pylist()]):
                ids = np.frombuffer(data + end, "<u4")
                marks.append(signature(ids))
                found.append(ids.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64()), pa.array([width] * len(marks), pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "signature", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return stored(rows.mapInArrow(run, "doc_id long, signature long, width int, ids binary"), "tokens")


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, bytes_each: int = 8 << 20) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (u32 bytes)."""
    tokens = tokenize(docs, vocabulary, end_id)
    parts = partitions_for(docs, bytes_each)  # of the table as it is stored: an estimate by columns knows no long texts

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0

        def flush(documents):
            nonlocal shard
            rows: list[tuple] = []
            base = (part * SHARDS_A_PART + shard) * SEQUENCES_A_SHARD
            shard += 1
            for number, sequence in enumerate(pack_shard(documents, window)):
                offset = 0
                for doc_id, start, size, ids in sequence:
                    rows.append((doc_id, start, len(ids), size, base + number, offset, ids.astype("<u4").tobytes()))
                    offset += len(ids)
            for i in range(0, len(rows), 4096):
                columns = list(zip(*rows[i : i + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], names=[x.split()[0] for x in PIECES.split(", ")])

        held, size = [], 0
        for b in batches:
            for doc_id, width, data in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.frombuffer(data, f"<u{width}")
                if held and size + len(ids) > SHARD_IDS:
                    yield from flush(held)
                    held, size = [], 0
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield from flush(held)

    ranged = tokens.repartitionByRange(parts, "signature", "doc_id").sortWithinPartitions("signature", "doc_id", "ids")
    return ranged.select("doc_id", "width", "ids").mapInArrow(run, PIECES)
