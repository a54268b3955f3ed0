"""sample, shuffle and spike: random by seed and ordinal, so any partitioning gives the same result.

Records and pairs with the same ordinals and seed are treated alike, so single and paired runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_key, hash_uniform
from ..model import MOST_TOP_K, with_position


def sample(df: DataFrame, num: int | None = None, rate: float | None = None, seed: int = 42) -> DataFrame:
    """Rows with a uniform of at most `rate`, else the `num` rows with the least hash; in order of ordinals.

    Where both are given the rate counts.  Only ordinals and hashes are ranked, never whole records.
    """
    if num is None and rate is None:
        raise ValueError("give num or rate")
    if rate is not None and not 0 <= rate <= 1:
        raise ValueError("rate is between 0 and 1")
    if rate is not None:
        return df.where(hash_uniform(seed, F.col("ord")) <= rate)
    if num < 0:
        raise ValueError("num is negative")
    key = hash_key(seed, F.col("ord")).alias("_key")
    if num <= MOST_TOP_K:
        chosen = df.select("ord", key).orderBy("_key", "ord").limit(num)
    else:
        chosen = with_position(df.select("ord", key), "_key", "ord", into="_place").where(F.col("_place") < num)
    return df.join(chosen.select("ord"), "ord", "left_semi")


def shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows with `ord` set to their place in a random permutation."""
    keyed = df.withColumn("_key", hash_key(seed, F.col("ord")))
    return with_position(keyed, "_key", "ord").drop("_key")


def spike(target: DataFrame, add: DataFrame, seed: int = 42) -> DataFrame:
    """All rows of both, the added ones at random slots between the target's rows.

    With n target rows each added row draws a slot from 0 to n; slot s stands behind s target rows, whatever
    gaps their ordinals have (slot 0 behind none: its null sorts first).  The target keeps its order; rows of
    one slot follow by their ordinals.
    """
    n = target.count()
    slot = F.least(F.floor(hash_uniform(seed, F.col("ord")) * F.lit(n + 1)), F.lit(n))
    places = with_position(target.select(F.col("ord").alias("_after")), "_after", into="_place")
    drawn = add.withColumn("_slot", slot).join(places, F.col("_slot") == F.col("_place") + 1, "left").drop("_slot", "_place")
    rows = target.withColumns({"_after": F.col("ord"), "_added": F.lit(0)}).unionByName(drawn.withColumn("_added", F.lit(1)))
    return with_position(rows.withColumn("_first", F.col("ord")), "_after", "_added", "_first").drop("_after", "_added", "_first")
