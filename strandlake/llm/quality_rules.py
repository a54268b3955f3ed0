"""Operator 4, quality rules: a threshold table compiled into one projection.

`features` and `verdict` are ordinary Column expressions, so the whole operator is one narrow
projection over the scan: no shuffle, no Python, any partitioning.  Results are defined for every
input: a null or empty text has no words and fails; rows that repeat a doc_id are judged one by one; extra columns pass through `annotate` untouched,
since all names the operator adds are given by the caller or fixed and replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au auf aus bei das dem den der des die ein eine für ist mit nicht sich und von zu "
    "ce dans de du elle en est et il la le les ne pas pour que qui se sur un une "
    "al como con del el es los las lo no para por su y"
).split()

WORD_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Keep while low * per <= value <= high * per (a missing bound always holds)."""

    name: str
    value: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)
#: The base conditions: fewer words fail, as does a larger share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT))


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur at least twice.

    Windows are compared by a 64-bit hash within one document.  Sorting (hash, start) puts equal
    windows side by side; the starts, in order, are then summed as a union of intervals.
    """

    def covered(windows: Column) -> Column:
        def runs(pairs: Column) -> Column:
            again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
                lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")),
                lambda acc: acc["total"],
            )

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, runs))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def features(text: Column, stop_words=STOP_WORDS) -> Column:
    """Struct of counts of one text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    long = lambda x: x.cast("long")

    def counts(words: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words)))).alias("n_stop_words"),
            long(repeat_words(words)).alias("n_repeat_words"),
        )

    def line_counts(lines: Column) -> Column:
        return F.struct(long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    def joined(c: Column) -> Column:
        w, x = c["w"], c["l"]
        names = ("n_words", "word_chars", "n_stop_words", "n_repeat_words")
        return F.struct(*(w[n].alias(n) for n in names), *(x[n].alias(n) for n in ("n_lines", "n_dup_lines")), long(c["s"]).alias("n_symbols"))

    return let(F.struct(let(word_array(text), counts).alias("w"), let(lines, line_counts).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).alias("s")), joined)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def verdict(f: Column, rules=RULES) -> Column:
    """True where every rule of the table holds."""
    holds = F.lit(True)
    for r in rules:
        per = f[r.per].cast("double") if r.per else F.lit(1.0)
        if r.low is not None:
            holds = holds & (f[r.value] >= r.low * per)
        if r.high is not None:
            holds = holds & (f[r.value] <= r.high * per)
    return holds


def annotate(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """docs with a struct column `into`: the counts, base_failed and kept."""
    full = let(
        features(F.col(text), stop_words),
        lambda f: F.struct(
            *(f[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")),
            base_failed(f).alias("base_failed"),
            (~base_failed(f) & verdict(f, rules)).alias("kept"),
        ),
    )
    return docs.withColumn(into, full)
