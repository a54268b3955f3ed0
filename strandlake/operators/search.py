"""grep and locate."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X

#: Up to so many patterns are part of the expression; exact ids beyond it are joined, whatever their number.
MOST_INLINE = 200
FIELDS = ("id", "name", "seq", "qual")


def checked_patterns(patterns) -> list[str]:
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    if not patterns:
        raise ValueError("no pattern was given")
    if any(not p for p in patterns):
        raise ValueError("a pattern is empty")
    return patterns


def _target(by: str, mate: str = "") -> Column:
    if by not in FIELDS:
        raise ValueError(f"by is one of {', '.join(FIELDS)}")
    if by == "name":
        return X.full_name(F.col(f"id{mate}"), F.col(f"desc{mate}"))
    return F.col(f"{by}{mate}")


def matches(patterns, by: str = "id", regex: bool = False, ignore_case: bool = False, mate: str = "") -> Column:
    """True where any pattern matches: whole ids, else substrings, or regular expressions anywhere.

    A record without qualities matches no quality pattern.
    """
    patterns = checked_patterns(patterns)
    target = _target(by, mate)
    if regex:
        if len(patterns) > MOST_INLINE:
            return F.coalesce(F.exists(F.array(*(F.lit(X.jvm_pattern(p, ignore_case)) for p in patterns)), lambda p: F.rlike(target, p)), F.lit(False))
        found = [target.rlike(X.jvm_pattern(p, ignore_case)) for p in patterns]
    else:
        if ignore_case:
            target, patterns = X.ascii_lower(target), [p.translate(str.maketrans(X.UPPER, X.LOWER)) for p in patterns]
        if by != "id" and len(patterns) > MOST_INLINE:  # one small expression, however many there are
            return F.coalesce(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(target, p)), F.lit(False))
        found = [target.isin(*patterns)] if by == "id" else [F.contains(target, F.lit(p)) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def grep(df: DataFrame, patterns, by: str = "id", regex: bool = False, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Records that any pattern matches; with invert, the others.

    `patterns` is a string, a list, or for exact ids also a DataFrame with a column `pattern`: a semi or
    anti join, which Spark broadcasts where the list is small.
    """
    if isinstance(patterns, DataFrame) or (by == "id" and not regex and not isinstance(patterns, str) and len(patterns) > MOST_INLINE):
        if by != "id" or regex:
            raise ValueError("a table of patterns holds exact ids")
        if not isinstance(patterns, DataFrame):
            patterns = df.sparkSession.createDataFrame([(p,) for p in checked_patterns(patterns)], "pattern string")
        low = X.ascii_lower if ignore_case else (lambda c: c)
        keys = patterns.select(low(F.col("pattern")).alias("_key")).distinct()
        return df.join(keys, low(F.col("id")) == F.col("_key"), "left_anti" if invert else "left_semi")
    found = matches(patterns, by, regex, ignore_case)
    return df.where(~found if invert else found)


def grep_pairs(pairs: DataFrame, patterns, by: str = "id", regex: bool = False, ignore_case: bool = False, invert: bool = False, pair_mode: str = "any") -> DataFrame:
    """Pairs of which any mate, or both, match; invert is applied to the pair's result."""
    if pair_mode not in ("any", "both"):
        raise ValueError("pair_mode is any or both")
    if by == "id" and not regex and not isinstance(patterns, str) and len(patterns) > MOST_INLINE:
        low = X.ascii_lower if ignore_case else (lambda c: c)
        keys = pairs.sparkSession.createDataFrame([(p,) for p in checked_patterns(patterns)], "pattern string").select(low(F.col("pattern")).alias("_key")).distinct()
        named = pairs
        for m in "12":
            side = keys.select(F.col("_key").alias(f"_key{m}"))
            named = named.join(side, low(F.col(f"id{m}")) == F.col(f"_key{m}"), "left")
        one, two = (F.col(f"_key{m}").isNotNull() for m in "12")
        found = one | two if pair_mode == "any" else one & two
        return named.where(~found if invert else found).select(*pairs.columns)
    one, two = (matches(patterns, by, regex, ignore_case, m) for m in "12")
    found = one | two if pair_mode == "any" else one & two
    return pairs.where(~found if invert else found)


MATCHES = "ord long, id string, pattern_index int, start long, end long, match string"


def locate(df: DataFrame, patterns, regex: bool = False, ignore_case: bool = False, all: bool = False, bed: bool = False) -> DataFrame:
    """ord, id, pattern_index, start, end and match of the patterns' places in the sequences.

    Literal patterns are found at every place, overlapping or not; regular expressions from left to right
    without overlap, an empty match not right behind another match.  Without `all`, only the first match of
    each pattern counts.  Places count from 1 with inclusive ends; with bed from 0 with exclusive ends.
    The matched text is that of the record.  Long sequences are searched in place, never exploded.
    """
    patterns = checked_patterns(patterns)
    lower = str.maketrans(X.UPPER, X.LOWER)
    if regex:
        wanted = [X.python_pattern(p, ignore_case) for p in patterns]
    else:
        wanted = [p.translate(lower) if ignore_case else p for p in patterns]
    shift = 0 if bed else 1

    def places(pattern, seq: str, low: str):
        if regex:
            last = -1
            for m in pattern.finditer(seq):
                if m.start() == m.end() == last:
                    continue
                last = m.end()
                yield m.span()
        else:
            at = low.find(pattern)
            while at >= 0:
                yield at, at + len(pattern)
                at = low.find(pattern, at + 1)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["ord", "id", "pattern_index", "start", "end", "match"]
        for b in batches:
            rows: list[tuple] = []
            for ord_, id_, seq in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seq = seq or ""
                low = seq.translate(lower) if ignore_case and not regex else seq
                for k, p in enumerate(wanted):
                    for s, e in places(p, seq, low):
                        rows.append((ord_, id_, k, s + shift, e, seq[s:e]))
                        if not all:
                            break
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select(F.col("ord").cast("long").alias("ord"), "id", "seq").mapInArrow(run, MATCHES)
