"""Mates: joined by their ordinals, checked by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pair_key
from ..model import FIELDS, PAIR_COLUMNS, with_position


class UnpairedError(ValueError):
    """Mates that are missing or whose ids differ."""


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """The mates side by side with a `status`: valid, mismatch, left or right.

    Ordinals count from 0 in both, and the join is a full outer join on them.
    """
    for mate in (first, second):
        if "qual" not in mate.columns:
            raise ValueError("mates have to be FASTQ records")
    one = first.select("ord", *(F.col(f).alias(f"{f}1") for f in FIELDS), F.lit(True).alias("_one"))
    two = second.select("ord", *(F.col(f).alias(f"{f}2") for f in FIELDS), F.lit(True).alias("_two"))
    both = one.join(two, "ord", "full_outer")
    status = (
        F.when(F.col("_two").isNull(), "left")
        .when(F.col("_one").isNull(), "right")
        .when(pair_key(F.col("id1")) == pair_key(F.col("id2")), "valid")
        .otherwise("mismatch")
    )
    return both.withColumn("status", status).select(*PAIR_COLUMNS, "status")


def pair_report(zipped: DataFrame) -> DataFrame:
    """How many pairs there are of each status."""
    return zipped.groupBy("status").agg(F.count("*").alias("n"))


def validate_pairs(zipped: DataFrame, allow_unpaired: bool = False) -> DataFrame:
    """The valid pairs, numbered from 0.

    Other pairs are an error that shows the first ten of them, raised before anything is written; with
    allow_unpaired they are left out.
    """
    bad = zipped.where("status <> 'valid'")
    if not allow_unpaired:
        shown = bad.orderBy("ord").select("ord", "id1", "id2", "status").limit(10).collect()
        if shown:
            listed = "; ".join(f"pair {r.ord}: {r.id1} / {r.id2} ({r.status})" for r in shown)
            raise UnpairedError(f"{bad.count()} invalid pairs, such as {listed}")
        return zipped.select(*PAIR_COLUMNS)
    return with_position(zipped.where("status = 'valid'"), "ord").select(*PAIR_COLUMNS)


def pair_up(first: DataFrame, second: DataFrame, allow_unpaired: bool = False) -> DataFrame:
    return validate_pairs(zip_mates(first, second), allow_unpaired)


def mate(pairs: DataFrame, which: int) -> DataFrame:
    """One mate of each pair as records."""
    return pairs.select(F.lit(f"mate{which}").alias("file"), "ord", *(F.col(f"{f}{which}").alias(f) for f in FIELDS))
