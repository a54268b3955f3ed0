"""Operator 7, LM scoring: stupid backoff with count tables partitioned by hash.

The words of a text are scored by the longest n-gram that ends at them and that the corpus holds at least
`least_count` times (n-grams of one word always count): its count over the count of its context, times
`discount` for each word of context given up, or over the number of all words where no context is left.

The join of exploded n-grams with the count tables runs in compact form:

1. Documents are dealt into chunks of bounded size.  A chunk's words and pairs of words are counted in the
   chunk (the combine before the shuffle), and each distinct one is asked for once: a row for each chunk and
   hash partition holds the sorted 64-bit keys and their counts.
2. A hash partition adds up the counts of its keys over all chunks (its count table) and answers each row
   with the totals in the row's order.  A word that every text uses is one key a chunk here, not one a text.
3. Longer n-grams follow order by order in the same way.  One that occurs `least_count` times has a prefix
   and a suffix that do so too, so only those are asked for; all others are too rare to count anyway.
4. Chunks meet their answers in a cogroup and sum the scores of each document.

Counts cover all documents, and what is counted grows with them.  Keys are hashes: two n-grams of a corpus
of a trillion words share one with a probability of about 1e-7 each.

Null and empty texts have no words and a score of 0.  Rows that repeat a doc_id are counted and scored one
by one.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, stored, text_bytes
from .shingles import PLAIN, windows

ORDER, LEAST_COUNT, DISCOUNT = 3, 2, 0.4
ASKED = "part int, chunk int, round int, keys binary, counts binary"
ANSWERED = "chunk int, round int, part int, totals binary"
SCORED = "doc_id long, n_words long, n_unigram long, partial double"


def _planes(values: np.ndarray) -> bytes:
    """An array in little room: the k-th bytes of all values together, then Zstandard."""
    flat = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def _values(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, whose upper bytes are mostly zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


def _keys(texts: list[np.ndarray], order: int) -> np.ndarray:
    """The keys of all n-grams of `order` words, text by text."""
    found = [windows(h, order) for h in texts]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (by sorting, which is far faster here than hashing)."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.concatenate((at, [len(keys)])))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys in order."""
    order = np.argsort(keys)
    keys = keys[order]
    rank = np.cumsum(np.concatenate((np.zeros(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    out = np.empty(len(keys), np.int64)
    out[order] = rank
    return out


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each hash partition begin in sorted keys."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _rows(chunk: int, round_: int, every: np.ndarray, parts: int):
    """What a chunk asks in a round: (part, chunk, round, keys, counts) for each hash partition."""
    keys, counts = _distinct(every)
    at = _bounds(keys, parts)
    for p in range(parts):
        if at[p] < at[p + 1]:
            own = slice(at[p], at[p + 1])
            yield p, chunk, round_, _packed_keys(keys[own]), _planes(counts[own].astype(np.uint32))


_ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("round", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask(order: int, parts: int):
    """The first round: n-grams of up to `order` words of each chunk."""

    def rows(chunk, texts):
        for row in _rows(chunk, 1, np.concatenate([_keys(texts, k) for k in range(1, order + 1)]), parts):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ASKED.types, strict=True)], schema=_ASKED)

    def run(batches):
        chunk, held = None, []
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), text_bytes(b.column(2)), strict=True):
                if c != chunk and held:
                    yield from rows(chunk, held)
                    held = []
                chunk = c
                held.append(PLAIN.hashes(text))
        if held:
            yield from rows(chunk, held)

    return run


def _answer(batches):
    """Totals over all chunks for the keys of each row: one count table for each part."""
    part, held = None, []

    def rows():
        keys = [_unpacked_keys(k) for _, _, k, _ in held]
        table, _ = _distinct(np.concatenate(keys))
        total = np.zeros(len(table), np.uint64)
        at = [np.searchsorted(table, k) for k in keys]  # a row's keys are sorted and distinct
        for places, (*_, counts) in zip(at, held, strict=True):
            total[places] += _values(counts, np.uint32)
        for places, (chunk, round_, _, _) in zip(at, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (chunk, round_, part)] + [pa.array([_planes(total[places])])], names=["chunk", "round", "part", "totals"])

    for b in batches:
        for p, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if p != part and held:
                yield from rows()
                held.clear()
            part = p
            held.append(row)
    if held:
        yield from rows()


class _Chunk:
    """A chunk's words, and what has been answered so far."""

    def __init__(self, docs: pa.Table, answers: pa.Table, order: int, least_count: int):
        self.texts = [PLAIN.hashes(t) for t in text_bytes(docs.column("text").combine_chunks())] if docs.num_rows else []
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.n = int(self.lengths.sum())
        start = np.concatenate(([0], np.cumsum(self.lengths)))[: len(self.lengths)]
        self.place = np.arange(self.n) - np.repeat(start, self.lengths)  # of a word in its text
        self.least = least_count
        self.counts: list[np.ndarray] = []  # by order: of the n-gram that ends at each word, 0 where it's too rare
        held: dict[int, list] = {}
        for r, p, t in zip(*(answers.column(c).to_pylist() for c in ("round", "part", "totals")), strict=True):
            held.setdefault(r, []).append((p, t))
        if self.n:
            self._first(min(order, 2), self._totals(held, 1))
            for k in range(3, max(held) + 2):
                at, keys = self.asks(k)
                c = np.zeros(self.n, np.uint64)
                if len(at):
                    c[at] = self._totals(held, k - 1)[_ranks(keys)]
                self.counts.append(c)

    @staticmethod
    def _totals(held: dict[int, list], round_: int) -> np.ndarray:
        return np.concatenate([_values(t, np.uint64) for _, t in sorted(held[round_])]) if round_ in held else np.zeros(0, np.uint64)

    def _first(self, order: int, total: np.ndarray) -> None:
        every = [_keys(self.texts, k) for k in range(1, order + 1)]
        at = _ranks(np.concatenate(every))
        begin = 0
        for k, keys in enumerate(every, 1):
            c = np.zeros(self.n, np.uint64)
            c[self.place >= k - 1] = total[at[begin : begin + len(keys)]]
            begin += len(keys)
            self.counts.append(c)

    def asks(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends and keys of the n-grams of k words whose prefix and suffix are frequent enough."""
        last = self.counts[k - 2] >= self.least
        mask = (self.place >= k - 1) & last
        mask[1:] &= last[:-1]
        return np.flatnonzero(mask), _keys(self.texts, k)[mask[self.place >= k - 1]]


def _ask_more(k: int, order: int, least_count: int, parts: int):
    """The round for n-grams of k words, from the answers so far."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and answers.num_rows:
            chunk = _Chunk(docs, answers, order, least_count)
            rows = list(_rows(docs.column("chunk")[0].as_py(), k - 1, chunk.asks(k)[1], parts))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED.types, strict=True)], schema=_ASKED)

    return run


def _score(order: int, least_count: int, discount: float):
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, answers, order, least_count)
        owner = np.repeat(np.arange(len(chunk.texts)), chunk.lengths)
        partial, alone = np.zeros(len(chunk.texts)), np.zeros(len(chunk.texts), np.int64)
        if chunk.n:
            counts, place = chunk.counts, chunk.place
            value = np.log(counts[0].astype(np.float64)) + np.minimum(place, order - 1) * np.log(discount)
            unigram = np.ones(chunk.n, bool)
            for k in range(2, len(counts) + 1):
                at = np.flatnonzero((place >= k - 1) & (counts[k - 1] >= least_count))
                context = counts[k - 2][at - 1].astype(np.float64)
                value[at] = np.log(counts[k - 1][at].astype(np.float64) / context) + (np.minimum(place[at], order - 1) - k + 1) * np.log(discount)
                unigram[at] = False
            partial, alone = np.bincount(owner, value, len(chunk.texts)), np.bincount(owner, unigram, len(chunk.texts)).astype(np.int64)
        ids = docs.column("doc_id").cast(pa.int64()).combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        return pa.Table.from_arrays([ids, pa.array(chunk.lengths), pa.array(alone), pa.array(partial)], names=names)

    return run


def scores(docs: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT, discount: float = DISCOUNT, bytes_each: int = 3 << 20) -> DataFrame:
    """doc_id, n_words and score (the sum of natural logarithms) of each document of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = partitions_for(docs.select("doc_id", "text"), bytes_each)
    chunk = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int").alias("chunk")
    # All uses take the same columns in the same order in one query, so that one exchange of the texts serves them all.
    dealt = rows.select(chunk, "doc_id", "text").repartition(chunks, "chunk")
    first = dealt.sortWithinPartitions("chunk").select("chunk", "doc_id", "text").mapInArrow(_ask(min(order, 2), chunks), ASKED)

    def answered(asked: DataFrame) -> DataFrame:
        # By its number: a hash of it would put several parts into one task and none into others.
        return asked.repartitionById(chunks, "part").sortWithinPartitions("part").mapInArrow(_answer, ANSWERED)

    def beside(answers: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)

    answers = answered(first)
    for k in range(3, order + 1):
        answers = answers.unionByName(answered(beside(answers, _ask_more(k, order, least_count, chunks), ASKED)))
    partial = beside(answers, _score(order, least_count, discount), SCORED)
    partial = stored(partial, "scores")
    words = partial.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return partial.select("doc_id", "n_words", (F.col("partial") - F.col("n_unigram") * F.log(F.lit(float(max(words, 1))))).alias("score"))
