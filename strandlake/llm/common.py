"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import spread
from ..sources import scratch

#: The ASCII white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"

#: Catalyst estimates plans of unknown size at more than this.
UNKNOWN_BYTES = 1 << 60


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, with Arrow batches that suit texts."""
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table, table.columns[0])


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: hand them to Python a thousand at a time, where the session keeps Spark's ten thousand.

    That bounds the buffers on both sides of the pipe, for each task that runs Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a plain scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many partitions of about `bytes_each` input bytes; grows with the input.

    Plans without an estimate (local rows, not files) get the session's number of shuffle partitions.
    """
    size = input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return max(least, math.ceil(size / bytes_each))


#: A fresh path under spark.checkpoint.dir; an error on a cluster that sets none.
shared_path = scratch


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(df: DataFrame, key: str, most: int, where: Column | None = None) -> DataFrame:
    """Of the rows for which `where` holds the `most` with the least hashes of `key`.

    Shares of the rows, by hash, are looked at until one holds enough, so `where` is seldom asked of all rows,
    and what tasks send on is bounded by `most` and not by their number.  The share changes no result.
    """
    order, span = F.pmod(F.xxhash64(key), F.lit(1 << 30)), 1 << 30
    rows = df.count()
    share = min(1.0, 32 * most / max(rows, 1))
    while True:
        part = df if share >= 1 else df.where(order < int(span * share))
        part = part if where is None else part.where(where)
        if share >= 1 or part.count() >= most:
            return part.orderBy(order, key).limit(most)
        share = min(1.0, 8 * share)
