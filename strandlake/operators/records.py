"""seq and fq2fa: filters and transformations of single records.  All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X


def needs_quality(df: DataFrame, what: str) -> None:
    if "qual" not in df.columns:
        raise ValueError(f"{what} needs FASTQ records")


def with_quality(qual: Column, what: str) -> Column:
    """qual, or an error at the first record without one."""
    return F.when(qual.isNull(), F.raise_error(F.lit(f"{what} needs FASTQ records")).cast("string")).otherwise(qual)


def seq(
    df: DataFrame,
    min_len: int | None = None,
    max_len: int | None = None,
    min_qual: float | None = None,
    max_qual: float | None = None,
    qual_base: int = 33,
    rev: bool = False,
    comp: bool = False,
    revcomp: bool = False,
    upper: bool = False,
    lower: bool = False,
    gaps: bool = False,
    gap_letters: str = X.GAPS,
    validate: bool = False,
) -> DataFrame:
    """Filter by length and mean quality, then transform, in this order.

    Length is that of the sequence as it was read.  A negative quality bound is none.  Removing gaps leaves
    the qualities alone.  Validation looks at transformed sequences and is part of a filter, so it can't be
    pruned away; the first letter outside IUPAC's set ends the job.
    """
    n = F.length("seq")
    if min_len is not None:
        df = df.where(n >= min_len)
    if max_len is not None:
        df = df.where(n <= max_len)
    low = min_qual if min_qual is not None and min_qual >= 0 else None
    high = max_qual if max_qual is not None and max_qual >= 0 else None
    if low is not None or high is not None:
        needs_quality(df, "a quality filter")
        mean = X.mean_quality(F.col("qual"), qual_base)
        fits = [mean >= low] * (low is not None) + [mean <= high] * (high is not None)
        df = df.where(fits[0] if len(fits) == 1 else fits[0] & fits[1])
    s = F.col("seq")
    turned = rev or revcomp
    if revcomp or comp:
        s = X.complement(s)
    if turned:
        s = F.reverse(s)
        if "qual" in df.columns:
            df = df.withColumn("qual", F.reverse("qual"))
    if upper:
        s = X.ascii_upper(s)
    if lower:
        s = X.ascii_lower(s)
    if gaps:
        s = X.remove_gaps(s, gap_letters)
    df = df.withColumn("seq", s)
    if validate:
        bad = F.concat(F.lit("invalid letter in record "), F.col("id"), F.lit(": "), F.regexp_extract("seq", f"[^{X.IUPAC}{X.IUPAC.lower()}]", 0))
        df = df.where(F.when(X.invalid_letters(F.col("seq")), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))
    return df


def invalid_records(df: DataFrame) -> DataFrame:
    """ord, id and the first letter outside IUPAC's set of each record that has one."""
    bad = f"[^{X.IUPAC}{X.IUPAC.lower()}]"
    return df.where(X.invalid_letters(F.col("seq"))).select("ord", "id", F.regexp_extract("seq", bad, 0).alias("letter"))


def names(df: DataFrame, full: bool = False) -> DataFrame:
    """ord and name: the id, or the id and the description."""
    return df.select("ord", name(full).alias("name"))


def name(full: bool = False) -> Column:
    return X.full_name(F.col("id"), F.col("desc")) if full else F.col("id")


def fq2fa(df: DataFrame) -> DataFrame:
    """Records without qualities; a record that has none to begin with is an error."""
    needs_quality(df, "fq2fa")
    return df.where(with_quality(F.col("qual"), "fq2fa").isNotNull()).withColumn("qual", F.lit(None).cast("string"))
