"""sort, head and tail, over records and pairs alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..model import MOST_TOP_K, renumber, with_position

SORT_KEYS = ("id", "name", "len", "seq")


def sort_keys(by: str = "id", numeric: bool = False, reverse: bool = False) -> list[Column]:
    """Bytewise keys, or numbers before all other ids where numeric; ties by ordinal.

    For `with_position`, all in one direction: `reverse` turns the ordinal's sign instead.
    """
    if by not in SORT_KEYS:
        raise ValueError(f"by is one of {', '.join(SORT_KEYS)}")
    value = {"id": F.col("id"), "name": X.full_name(F.col("id"), F.col("desc")), "len": F.length("seq"), "seq": F.col("seq")}[by]
    keys = [value]
    if numeric and by in ("id", "name"):
        number = X.numeric_key(value)
        keys = [number.isNull(), number, value]
    return [*keys, -F.col("ord") if reverse else F.col("ord")]


def sort(df: DataFrame, by: str = "id", numeric: bool = False, reverse: bool = False) -> DataFrame:
    """Records with `ord` set to their place in the order.

    Ranges of the keys are sorted side by side; the ordinal is part of the key, so equal keys can be split.
    Numbers are unsigned and below 2**128.  Numeric order has no effect on len and seq.
    """
    return with_position(df, *sort_keys(by, numeric, reverse), descending=reverse)


def checked_limit(num: int | None, proportion: float | None) -> None:
    if (num is None) == (proportion is None):
        raise ValueError("give either num or proportion")
    if num is not None and num < 0:
        raise ValueError("num is negative")
    if proportion is not None and not 0 <= proportion <= 1:
        raise ValueError("proportion is between 0 and 1")


def _keep(df: DataFrame, num: int | None, proportion: float | None) -> tuple[int, int | None]:
    """How many rows to keep, and of how many where that was counted."""
    checked_limit(num, proportion)
    if proportion is None:
        return num, None
    total = df.count()
    return math.ceil(total * proportion), total


def head(df: DataFrame, num: int | None = None, proportion: float | None = None) -> DataFrame:
    """The first num rows by ordinal, or the first ceil(total * proportion)."""
    keep, _ = _keep(df, num, proportion)
    if keep <= MOST_TOP_K:
        return df.orderBy("ord").limit(keep)
    place = with_position(df, "ord", into="_place")
    return place.where(F.col("_place") < keep).drop("_place")


def tail(df: DataFrame, num: int | None = None, proportion: float | None = None) -> DataFrame:
    """The last num rows by ordinal, or the last ceil(total * proportion)."""
    keep, total = _keep(df, num, proportion)
    if keep <= MOST_TOP_K:
        return df.orderBy(F.desc("ord")).limit(keep)
    total = df.count() if total is None else total
    place = with_position(df, "ord", into="_place")
    return place.where(F.col("_place") >= total - keep).drop("_place")


def head_zipped(zipped: DataFrame, num: int | None = None, proportion: float | None = None, allow_unpaired: bool = False) -> DataFrame:
    """The first valid pairs of zipped mates.

    An invalid pair is an error only if it stands before the last pair that is kept; num = 0 reads nothing.
    A proportion counts all pairs first, so there any invalid pair is an error.
    """
    from .pairs import UnpairedError, validate_pairs

    checked_limit(num, proportion)
    if proportion is not None:
        return head(validate_pairs(zipped, allow_unpaired), proportion=proportion)
    if num == 0:
        return validate_pairs(zipped.where("false"), True)
    if allow_unpaired:
        return head(validate_pairs(zipped, True), num)
    first = zipped.where("status <> 'valid'").agg(F.min("ord")).first()[0]
    if first is not None and first < num:
        raise UnpairedError(f"pair {first} is invalid")
    valid = zipped.where(F.col("ord") < num)
    return validate_pairs(valid)


__all__ = ["sort", "sort_keys", "head", "tail", "head_zipped", "renumber"]
