"""Operator 2, benchmark decontamination: greedy string tiling.

Words are what stands between white space and ASCII punctuation; A-Z count as a-z.  A document and a benchmark
item meet where they share a run of `least` words, a seed, known by its fingerprint.  Tiles are then marked
greedily: again and again the longest common runs of words that no tile covers yet in either text become
tiles (of equal ones that which begins first in the item, then in the document), until none of `least` words
is left.  Since tiles may stand in any order, a passage whose sentences were moved about is covered as well
as a plain copy.  An item that tiles cover to `share` or more has leaked.

Steps:

1. The items' seeds are a table (seed, item, places), and a bitmap of at most MOST_BITS says which seeds there
   may be at all; it alone is always broadcast.
2. One pass over the documents emits the seeds that the bitmap lets through, with their places.
3. Both join on the seed - by broadcast while the items' seeds are few, else by a shuffle - and what meets in
   one document and item is tiled by one task.  A text that repeats itself has a row for each seed, not for
   each pair of places, and tiling takes memory for its places, not for their pairs.
4. Tiles of what has leaked are compared word by word in the texts themselves, so a fingerprint that two runs
   share by chance is no match.

Null and empty texts have no seeds, neither of documents nor of items.  Items of fewer than `least` words are
seeds as a whole; items without words leak nowhere.  Rows that repeat a doc_id or an item_id give rows of their
own, also where they are equal; a null id stays null.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes
from .shingles import Words, windows

LEAST_WORDS = 5
SHARE = 0.5
#: Bits of the bitmap at most (32 MB), and those for each seed below that.
MOST_BITS, BITS_A_SEED = 1 << 28, 1024
#: Up to so many rows of seeds (some 100 MB), and of leaks, are broadcast.
MOST_BROADCAST = 1_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CHUNK = 1 << 17

_words = Words(b" \t\n\x0b\x0c\r" + PUNCTUATION)
word_codes = _words.hashes
_split = re.compile(rb"[^ \t-\r" + re.escape(PUNCTUATION) + rb"]+").findall


def tiles(item: np.ndarray, doc: np.ndarray, places: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles, in words.

    `item` holds the seed at each place of the item (0: none), `doc` the seeds at the document's `places`, in
    ascending order, and a seed is `least` words long.  Each round runs along the item once, from its end, with
    the length of the match that begins at each of the document's places.
    """
    item, doc = item.astype(np.int64), doc.astype(np.int64)
    follows = np.concatenate((places[1:] == places[:-1] + 1, [False]))
    found = []
    while True:
        best, at = 0, []
        run = np.zeros(len(doc) + 1, np.int64)
        for i in range(len(item) - 1, -1, -1):
            if not item[i]:
                run[:] = 0
                continue
            now = np.zeros_like(run)
            now[:-1] = np.where(doc == item[i], 1 + np.where(follows, run[1:], 0), 0)
            run = now
            top = int(run.max())
            if top > best:
                best, at = top, []
            if top and top == best:
                at += [(i, int(k)) for k in np.flatnonzero(run == best)]
        if not best:
            return found
        n = best + least - 1
        for i, k in sorted(at):
            own = slice(int(np.searchsorted(places, places[k])), int(np.searchsorted(places, places[k] + best)))
            if item[i : i + best].all() and doc[own].all():
                j = int(places[k])
                found.append((i, j, n))
                item[max(0, i - least + 1) : i + n] = 0
                doc[int(np.searchsorted(places, j - least + 1)) : int(np.searchsorted(places, j + n))] = 0


def _grouped(codes: np.ndarray, places: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct codes and the places of each."""
    order = np.argsort(codes, kind="stable")
    codes, places = codes[order], places[order]
    cut = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    return codes[np.concatenate(([0], cut))].view(np.int64).tolist(), np.split(places, cut)


def _bits(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(20)) & np.uint64(bits - 1)


_SEEDS = "seed long, id long, mark long, words int, size int, places array<int>"
_SEED_KINDS = pa.schema([("seed", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("words", pa.int32()), ("size", pa.int32()), ("places", pa.list_(pa.int32()))])


def _texts(df: DataFrame, key: str) -> DataFrame:
    """id, mark (a hash that tells texts of one id apart) and text."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.select("id", F.xxhash64("text").alias("mark"), "text")


def seeds(rows: DataFrame, sizes: list[int] | None, least: int, bitmap=None) -> DataFrame:
    """seed, id, mark, words, size and places of the seeds of rows(id, mark, text).

    Of items (sizes None) a seed has `least` words, or all of a shorter item; of documents those of all `sizes`
    are made that the bitmap, a broadcast of (bits, its size), lets through.
    """

    def run(batches):
        for b in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for id_, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                words = word_codes(text)
                for size in sizes or ([min(least, len(words))] if len(words) else []):
                    codes = windows(words, size)
                    at = np.arange(len(codes))
                    if bitmap is not None:
                        held, bits = bitmap.value
                        spot = _bits(codes, bits)
                        at = np.flatnonzero((held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(at):
                        found, places = _grouped(codes[at], at.astype(np.int32))
                        for c, x in zip(columns, (found, [id_] * len(found), [mark] * len(found), [len(words)] * len(found), [size] * len(found), places), strict=True):
                            c += x
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEED_KINDS.types, strict=True)], schema=_SEED_KINDS)

    return rows.mapInArrow(run, _SEEDS)


def bitmap_of(items: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Which seeds there may be: bits that hashes of them set, or-ed together piece by piece."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(13, math.ceil(math.log2(max(1, count) * BITS_A_SEED))))

    def run(batches):
        held = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            spot = _bits(b.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(held, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        at = [i for i in range(0, len(held), _CHUNK) if held[i : i + _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([held[i : i + _CHUNK].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint8)
                total[at] = total[at] | part if at in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "bits"])

    pieces = items.select("seed").mapInArrow(run, "at long, bits binary").repartition(max(1, (bits >> 3) // _CHUNK // 8), "at").mapInArrow(merge, "at long, bits binary")
    held = np.zeros(bits >> 3, np.uint8)
    for r in pieces.collect():
        held[r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return held, bits


LEAKS = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, tiles array<struct<item_start: int, doc_start: int, length: int>>"
_TILE = pa.struct([(n, pa.int32()) for n in ("item_start", "doc_start", "length")])
_TILED = pa.schema([("doc_id", pa.int64()), ("doc_mark", pa.int64()), ("item_id", pa.int64()), ("item_mark", pa.int64()), ("item_words", pa.int32()), ("tiles", pa.list_(_TILE))])
_KEYS = ["doc_id", "doc_mark", "item_id", "item_mark"]


def _tile(share: float):
    """Tiles of each document and item from rows sorted by them, once for each pair of equal rows."""

    def one(key: tuple, rows: list[tuple]) -> list[dict]:
        _, words, size, _, _ = rows[0]
        own: dict[int, tuple] = {}
        times: dict[int, int] = {}
        for seed, _, _, at_item, at_doc in rows:
            own[seed] = (at_item, at_doc)
            times[seed] = times.get(seed, 0) + 1
        item = np.zeros(words - size + 1, np.int64)
        places, codes = [], []
        for k, (at_item, at_doc) in enumerate(own.values(), 1):
            item[at_item] = k
            places += at_doc
            codes += [k] * len(at_doc)
        hit = np.flatnonzero(item)
        if np.unique((hit[:, None] + np.arange(size)).reshape(-1)).size < share * words:
            return []
        order = np.argsort(places)
        found = tiles(item, np.array(codes)[order], np.array(places)[order], size)
        if sum(x[2] for x in found) < share * words:
            return []
        marks = [dict(zip(("item_start", "doc_start", "length"), x, strict=True)) for x in found]
        return [dict(zip(_TILED.names, (*key, words, marks), strict=True))] * min(times.values())

    def run(batches):
        last, held = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                key = row[:4]
                if key != last and held:
                    out += one(last, held)
                    held = []
                last = key
                held.append(row[4:])
            yield pa.RecordBatch.from_pylist(out, schema=_TILED)
        if held:
            yield pa.RecordBatch.from_pylist(one(last, held), schema=_TILED)

    return run


def _verified(share: float):
    """The tiles whose words are the same in both texts, and whether they still cover the share."""
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("covered_words", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.list_(_TILE))])

    def run(batches):
        for b in batches:
            out = []
            for doc_id, item_id, words, marks, text, item in zip(*(b.column(i).to_pylist() for i in range(4)), text_bytes(b.column(4)), text_bytes(b.column(5)), strict=True):
                x, y = _split(item.lower()), _split(text.lower())
                same = [t for t in marks if x[t["item_start"] :][: t["length"]] == y[t["doc_start"] :][: t["length"]]]
                covered = sum(t["length"] for t in same)
                if covered >= share * words:
                    out.append({"doc_id": doc_id, "item_id": item_id, "n_tiles": len(same), "covered_words": covered, "item_words": words, "tiles": same})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, share: float = SHARE) -> DataFrame:
    """A row for each document and item that leaked into it, with its tiles (in words)."""
    spark = docs.sparkSession
    items, texts = _texts(benchmark, "item_id"), _texts(docs, "doc_id")
    known = stored(seeds(items, None, least), "seeds")
    count, sizes = known.agg(F.count("*"), F.collect_set("size")).first()
    held = spark.sparkContext.broadcast(bitmap_of(known, count))
    met = seeds(texts, sorted(sizes) or [least], least, held).select("seed", "size", F.col("id").alias("doc_id"), F.col("mark").alias("doc_mark"), F.col("places").alias("at_doc"))
    known = known.select("seed", "size", F.col("id").alias("item_id"), F.col("mark").alias("item_mark"), "words", F.col("places").alias("at_item"))
    pairs = met.join(F.broadcast(known) if count <= MOST_BROADCAST else known, ["seed", "size"])
    rows = pairs.select(*_KEYS, "seed", "words", "size", "at_item", "at_doc").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    schema = "doc_id long, doc_mark long, item_id long, item_mark long, item_words int, tiles array<struct<item_start: int, doc_start: int, length: int>>"
    found = stored(rows.mapInArrow(_tile(share), schema), "tiled")

    def text_of(side: DataFrame, name: str) -> DataFrame:
        keys = found.select(F.col(f"{name}_id").alias("id"), F.col(f"{name}_mark").alias("mark")).distinct()
        keys = F.broadcast(keys) if found.count() <= MOST_BROADCAST else keys
        wanted = side.alias("s").join(keys.alias("k"), F.col("s.mark").eqNullSafe(F.col("k.mark")) & F.col("s.id").eqNullSafe(F.col("k.id")), "left_semi")
        return wanted.dropDuplicates(["id", "mark"]).select(F.col("id").alias(f"{name}_own"), F.col("mark").alias(f"{name}_same"), F.col("text").alias(f"{name}_text"))

    for name, side in (("doc", texts), ("item", items)):
        found = found.join(text_of(side, name), F.col(f"{name}_mark").eqNullSafe(F.col(f"{name}_same")) & F.col(f"{name}_id").eqNullSafe(F.col(f"{name}_own")))
    return found.select("doc_id", "item_id", "item_words", "tiles", "doc_text", "item_text").mapInArrow(_verified(share), LEAKS)
