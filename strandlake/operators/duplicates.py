"""rmdup: one record, or pair, for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import is_paired

KEYS = {"id": ("id",), "seq": ("seq",), "full": ("id", "seq", "qual")}


def rmdup(df: DataFrame, by: str = "full", keep: str = "first", count_dup: bool = False, mark_dup: bool = False) -> DataFrame:
    """The first (or last) row by ordinal of each key, its ordinal kept.

    The key is id, seq or id, seq and qual - of both mates in pairs, ids as they are - and nulls are equal.
    count_dup appends ;count=N to the id (of the first mate), mark_dup then ;dup=N-1 where N > 1.

    Keys are counted as 120 bits of a digest, by a hash aggregate that combines within each task, so
    a key that most rows share costs one small row a task; then the rows that are kept are fetched by ordinal.
    Ordinals are taken to be unique.
    """
    if by not in KEYS:
        raise ValueError(f"by is one of {', '.join(KEYS)}")
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    mates = ("1", "2") if is_paired(df) else ("",)
    counted = _counted(df, by, F.min if keep == "first" else F.max)
    out = df.withColumns(_digest(df, by)).join(counted.withColumnRenamed("n", "_n"), ["ord", "_a", "_b"]).drop("_a", "_b")
    name = f"id{mates[0]}"
    if count_dup:
        out = out.withColumn(name, F.concat(F.col(name), F.lit(";count="), F.col("_n")))
    if mark_dup:
        out = out.withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(";dup="), F.col("_n") - 1)).otherwise(F.col(name)))
    return out.select(*df.columns)


def _digest(df: DataFrame, by: str) -> dict[str, Column]:
    """120 bits of the key's digest, in two numbers.  Lengths tell apart what a plain concatenation would not."""
    mates = ("1", "2") if is_paired(df) else ("",)
    key = [F.col(f"{f}{m}") for m in mates for f in KEYS[by]]
    shape = F.concat_ws(",", *(F.coalesce(F.length(c).cast("string"), F.lit("-")) for c in key))
    digest = F.md5(F.concat_ws("|", shape, *(F.coalesce(c, F.lit("")) for c in key)).cast("binary"))
    return {n: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at, n in ((1, "_a"), (16, "_b"))}


def _counted(df: DataFrame, by: str, pick=F.min) -> DataFrame:
    """_a, _b, the ordinal to keep and the count of each key."""
    return df.select("ord", *(c.alias(n) for n, c in _digest(df, by).items())).groupBy("_a", "_b").agg(pick("ord").alias("ord"), F.count("*").alias("n"))


def duplicate_counts(df: DataFrame, by: str = "full") -> DataFrame:
    """The first ordinal and the count of each key that several rows share."""
    return _counted(df, by).where("n > 1").select("ord", "n")
