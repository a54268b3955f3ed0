"""Operator 8, line dedup: a log-template tree of fixed depth.

What is parsed are units: every line, and every sentence of `least_sentence` tokens or more in lines of
several sentences (a sentence ends behind . ! or ? before white space), since a passage may stand anywhere
in a line; with `least_sentence` None lines alone.  Tokens with a digit are variable fields, <*>; a unit of which more than half are variable keeps
its tokens as they are, and one without any constant token has no leaf.  The path of a unit is

    number of tokens  ->  LEADING leading tokens  ->  the rest, as a template

and its leaves are the template of all its constants and, for lines of `least_field` tokens or more, the
four templates in which one quarter of the rest is a variable field as well.  So a line meets others of its
number of tokens and leading tokens that differ from it within a quarter, and in numbers anywhere.

A leaf that units of several documents reach is a recurring template: its units stay in the document with
the smallest doc_id and are dropped from all others, sentences with the white space behind them.  A line
of which all sentences go is dropped.  Leaves are counted by an aggregate with map-side combine; the count
of a leaf never needs its lines together.

Empty lines have no leaf and stay.  A null text has no lines and stays null.  Rows that repeat a doc_id
count as one document; rows without one keep their text.  Extra columns pass through; columns named
n_lines, n_dropped or n_cut are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stored, text_bytes, unused
from .shingles import Words, powers
from .tokens import sized_batches

LEADING, QUARTERS = 2, 4
LEAST_SENTENCE, LEAST_FIELD = 8, 8
_WORDS = Words(b" \t\n\x0b\x0c\r", fold=False)
_FIELD = _WORDS.hashes(b"<*>")[0]
_DIGITS, _ENDS = np.zeros(256, np.uint8), np.zeros(256, bool)
_DIGITS[48:58] = 1
_ENDS[list(b".!?")] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mixed(sums: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """Leaves as signed numbers, from a sum over tokens, the number of tokens and which template it is."""
    x = sums ^ (n.astype(np.uint64) * np.uint64(QUARTERS + 1) + np.uint64(kind)) * _M3
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Parsed:
    """The lines, sentences and leaves of a text, all at once.

    The leaf of a stretch of tokens is a polynomial over their hashes, so sums up to each token give those of
    all lines and sentences, and a variable quarter is taken out by one difference.
    """

    def __init__(self, text: bytes, least_field: int = LEAST_FIELD, least_sentence: int | None = LEAST_SENTENCE):
        raw = np.frombuffer(text, np.uint8)
        inside = np.concatenate(([False], _WORDS.inside[raw], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = turns[::2], turns[1::2]
        self.breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(self.breaks, self.starts)
        hashes = _WORDS.hashes(text)
        digit = np.add.reduceat(_DIGITS[raw], self.starts, dtype=np.int64) > 0 if len(hashes) else np.zeros(0, bool)
        general = np.where(digit, _FIELD, hashes)
        power, inverse = powers(len(hashes) + 1)
        upto = lambda x: np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))
        sums = [upto(x * power[: len(x)]) for x in (general, hashes)]
        constant = upto((general != _FIELD).astype(np.int64))
        new_line = np.concatenate((np.ones(min(1, len(line)), bool), line[1:] != line[:-1]))
        new_sentence = new_line.copy()
        new_sentence[1:] |= _ENDS[raw[ends[:-1] - 1]] if len(ends) else False

        def leaves(at: np.ndarray, until: np.ndarray, quarters: bool) -> list[np.ndarray]:
            """For each template the leaves of stretches of tokens; 0 where there is none."""
            n, fixed = until - at, constant[until] - constant[at]
            by = 2 * fixed >= n
            between = lambda a, b: np.where(by, sums[0][b] - sums[0][a], sums[1][b] - sums[1][a])
            whole = between(at, until)
            found = [np.where(fixed > 0, _mixed(whole * inverse[at], n, 0), 0)]
            for k in range(QUARTERS if quarters else 0):
                low, high = (at + np.minimum(n, LEADING) + np.maximum(n - LEADING, 0) * x // QUARTERS for x in (k, k + 1))
                leaf = _mixed((whole - between(low, high)) * inverse[at], n, k + 1)
                found.append(np.where((fixed > 0) & (n >= least_field), leaf, 0))
            return found

        def edges(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(new)
            return at, np.concatenate((at[1:], [len(new)])) if len(at) else at

        at, until = edges(new_line)
        self.lines, self.line_leaves = line[at], leaves(at, until, True)
        at, until = edges(new_sentence)
        self.first, self.sentence_line = at, line[at]
        several = np.bincount(self.sentence_line, minlength=len(self.breaks) + 1)[self.sentence_line] > 1 if len(at) else np.zeros(0, bool)
        wanted = several & (until - at >= least_sentence) if least_sentence is not None else np.zeros(len(at), bool)
        self.sentence_leaves = np.where(wanted, leaves(at, until, False)[0], 0)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines and leaves of all units."""
        lines = np.concatenate([self.lines] * len(self.line_leaves) + [self.sentence_line])
        found = np.concatenate([*self.line_leaves, self.sentence_leaves])
        keep = found != 0
        return lines[keep], found[keep]


def leaves(line: bytes, least_field: int = LEAST_FIELD, least_sentence: int | None = LEAST_SENTENCE) -> list[int]:
    """The leaves of a line and of its sentences."""
    return Parsed(line, least_field, least_sentence).leaves()[1].tolist()


def _owned(found: np.ndarray, owner: np.ndarray | int) -> np.ndarray:
    """A leaf and the text it is held for in one number."""
    return found.view(np.uint64) ^ (np.asarray(owner).astype(np.uint64) + np.uint64(1)) * _M3


def without(texts: list[bytes], held: list[np.ndarray], least_field: int = LEAST_FIELD, least_sentence: int | None = LEAST_SENTENCE) -> list[tuple[bytes, int, int]]:
    """Each text without units of its held leaves, how many lines went, and how many sentences of others."""
    if not texts:
        return []
    whole = b"\n".join(texts)
    parsed = Parsed(whole, least_field, least_sentence)
    first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
    total = int(first[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    known = np.unique(np.concatenate([_owned(h, i) for i, h in enumerate(held)]))
    has = lambda found, lines: (found != 0) & np.isin(_owned(found, owner[lines]), known)
    lost = np.zeros(total, bool)
    for x in parsed.line_leaves:
        lost[parsed.lines[has(x, parsed.lines)]] = True
    cut = has(parsed.sentence_leaves, parsed.sentence_line) & ~lost[parsed.sentence_line]
    gone, have = (np.bincount(parsed.sentence_line[x], minlength=total) for x in (cut, slice(None)))
    lost |= (gone > 0) & (gone == have)
    cut &= ~lost[parsed.sentence_line]
    begin, end = np.concatenate(([0], parsed.breaks + 1)).tolist(), np.concatenate((parsed.breaks, [len(whole)])).tolist()
    trimmed: dict[int, set[int]] = {}
    for s in np.flatnonzero(cut).tolist():
        trimmed.setdefault(int(parsed.sentence_line[s]), set()).add(s)

    def line(i: int) -> bytes:
        if i not in trimmed:
            return whole[begin[i] : end[i]]
        low, high = np.searchsorted(parsed.sentence_line, [i, i + 1])
        at = [begin[i], *parsed.starts[parsed.first[low + 1 : high]].tolist(), end[i]]
        return b"".join(whole[a:b] for k, (a, b) in enumerate(zip(at, at[1:], strict=False), int(low)) if k not in trimmed[i])

    dropped = np.bincount(owner[lost], minlength=len(texts)).tolist()
    parts = np.bincount(owner[parsed.sentence_line[cut]], minlength=len(texts)).tolist()
    out = []
    for i, text in enumerate(texts):
        if dropped[i] or parts[i]:
            a, b = int(first[i]), int(first[i + 1])
            text = b"\n".join(map(line, (np.flatnonzero(~lost[a:b]) + a).tolist()))
        out.append((text, dropped[i], parts[i]))
    return out


def recurring(docs: DataFrame, least_documents: int = 2, least_field: int = LEAST_FIELD, least_sentence: int | None = LEAST_SENTENCE) -> DataFrame:
    """doc_id and leaf: the templates that a document has to drop."""

    def run(batches):
        for b in sized_batches(batches):
            texts = [t or b"" for t in text_bytes(b.column(1))]
            first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
            lines, found = Parsed(b"\n".join(texts), least_field, least_sentence).leaves()
            owner = np.searchsorted(first, lines, "right") - 1
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            new = np.concatenate((np.ones(min(1, len(found)), bool), (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(found[new]), b.column(0).take(pa.array(owner[new]))], names=["leaf", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = stored(rows.mapInArrow(run, "leaf long, doc_id long"), "leaves")
    if least_documents > 2:
        counted = rows.distinct().groupBy("leaf").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least_documents).drop("n")
    else:
        counted = rows.groupBy("leaf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    return rows.join(counted, "leaf").where("doc_id <> first").select("doc_id", "leaf")


def drop_recurring(docs: DataFrame, least_documents: int = 2, least_field: int = LEAST_FIELD, least_sentence: int | None = LEAST_SENTENCE) -> DataFrame:
    """docs with what recurs removed from text; n_lines (before), n_dropped (lines) and n_cut (sentences of other lines)."""
    docs = docs.drop("n_lines", "n_dropped", "n_cut")
    owner, found = unused(docs, "_doc"), unused(docs, "_leaves")
    lost = recurring(docs, least_documents, least_field, least_sentence).groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set("leaf").alias(found))
    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col(owner), "left").drop(owner)
    counts = {n: F.lit(0).cast("long") for n in ("n_lines", "n_dropped", "n_cut")}
    out = docs.withColumn("text", F.col("text").cast("string")).withColumns(counts).schema
    names = [f.name for f in out]
    kinds = arrow_schema(out)

    def run(batches):
        for b in sized_batches(batches, names_in.index("text")):
            texts = text_bytes(b.column(names_in.index("text")))
            held = b.column(names_in.index(found)).to_pylist()
            before = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            dropped, cut = [0] * len(texts), [0] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None and held[i]]
            for i, (text, lines, parts) in zip(at, without([texts[i] for i in at], [np.array(held[i], np.int64) for i in at], least_field, least_sentence), strict=True):
                texts[i], dropped[i], cut[i] = text, lines, parts
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "n_cut": pa.array(cut, pa.int64())}
            columns = [made[n] if n in made else b.column(names_in.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(kinds.field(i).type) if c.type != kinds.field(i).type else c for i, c in enumerate(columns)], names=names)

    joined = joined.withColumn("text", F.col("text").cast("string"))
    names_in = joined.columns
    return joined.mapInArrow(run, out)
