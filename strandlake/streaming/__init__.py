"""Streams of sequence files: a folder whose new files are read once each, in the order of their names.

The operators that look at single records (seq, fq2fa, grep, locate, rename by table or pattern, sampling by
rate) take streaming frames as they are.  Sorting, head, tail, shuffle and spike need whole inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.duplicates import KEYS
from ..sources import register


def read_stream(spark: SparkSession, folder: str, format: str = "auto", compression: str = "auto") -> DataFrame:
    """Records of the files that arrive in a folder, under names that sort after those there before."""
    register(spark)
    return spark.readStream.format("fastx").options(path=folder, format=format, compression=compression).load()


def distinct_stream(df: DataFrame, by: str = "full") -> DataFrame:
    """One record for each key (see rmdup), the first to arrive; Spark keeps the keys as state."""
    return df.dropDuplicates(list(KEYS[by]))
