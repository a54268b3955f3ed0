"""The record model.

A record is one row (file, ord, id, desc, seq, qual).  `ord` is the record's place in its file, from 0;
frames have no order of their own, so every operator that speaks of order uses this column.  `seq` and
`qual` hold one character for each byte (Latin-1), `qual` is null for FASTA.  A pair is one row with both
mates, (ord, id1, desc1, seq1, qual1, id2, desc2, seq2, qual2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("desc", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
    ]
)
FIELDS = ("id", "desc", "seq", "qual")
PAIR_COLUMNS = ("ord", *(f"{f}1" for f in FIELDS), *(f"{f}2" for f in FIELDS))

#: Ranges of a frame that is put into order: bytes and rows that each aims at, how many there are at most, keys
#: sampled for each, and bytes of keys that the driver holds as bounds at most.
RANGE_BYTES, RANGE_ROWS, MOST_RANGES, SAMPLED, BOUND_BYTES = 256 << 20, 1000, 4096, 20, 16 << 20
#: Bytes of a scan that are worth a task of their own.
SPREAD_BYTES = 1 << 20
#: Up to so many rows are taken by a top-k; more by positions.
MOST_TOP_K = 100_000


def is_paired(df: DataFrame) -> bool:
    return "id1" in df.columns and "id2" in df.columns


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of few large splits (a file of one row group is one task's work) dealt over the cores by a key.

    Scans that have half as many splits as there are cores, or less than SPREAD_BYTES for each core that would
    get a share, stay as they are; so does all of any size that was written in more than a few files.
    """
    size = plan_bytes(df)
    if size is None or size < 4 * SPREAD_BYTES:
        return df
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES)
    if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)


def _bounds(df: DataFrame, key: Column, kind: T.StructType, wanted: int | None) -> list[T.Row]:
    """Keys that cut df into ranges of like size, in ascending order.

    They are quantiles of a sample that a hash of the key chooses, so they depend on the rows alone.
    """
    keys = df.select(key.alias("key"))
    texts = [F.coalesce(F.octet_length(F.col("key")[f.name]), F.lit(0)) for f in kind if isinstance(f.dataType, T.StringType)]
    rows, width = keys.agg(F.count("*"), F.avg(sum(texts, F.lit(16)))).first()
    if not rows:
        return []
    if wanted is None:
        size = plan_bytes(df)
        wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-(size or 0) // RANGE_BYTES))
        wanted = min(wanted, rows // RANGE_ROWS)
    wanted = min(wanted, rows, MOST_RANGES, int(BOUND_BYTES / width))
    if wanted < 2:
        return []
    share = min(1.0, wanted * SAMPLED / rows)
    few = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    ranked = few.select("key", F.ntile(wanted).over(Window.orderBy("key")).alias("tile"))
    return [r.key for r in ranked.groupBy("tile").agg(F.min("key").alias("key")).orderBy("tile").collect()][1:]


def _range_of(key: Column, bounds: list[T.Row], kind: T.StructType) -> Column:
    """How many bounds are not above the key, by bisection."""
    if not bounds:
        return F.lit(0)
    cell = lambda row: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind, row, strict=True)))
    literal = F.array(*map(cell, bounds))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        further = at["key"] >= F.get(literal, at["n"] + width - 1)
        return F.struct(F.when(further, at["n"] + width).otherwise(at["n"]).alias("n"), at["key"].alias("key"))

    return F.aggregate(F.array(*map(F.lit, steps)), F.struct(F.lit(0).alias("n"), key.alias("key")), step, lambda at: at["n"])


def with_position(df: DataFrame, *keys: Column | str, into: str = "ord", partitions: int | None = None, descending: bool = False) -> DataFrame:
    """df with `into` set to each row's place in the order of the keys, from 0.

    The range of a row is a function of its keys and of bounds fixed beforehand, so that the rows and the
    counts of their ranges agree however often and wherever either is computed.  Each row moves once, to its
    range, and is numbered there; the counts, one row for a range, are summed up and broadcast.  Keys should
    be unique, else the place among equal ones is open.
    """
    key = F.struct(*((F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)))
    kind = df.select(key.alias("key")).schema["key"].dataType
    bounds = _bounds(df, key, kind, partitions)
    part = _range_of(key, bounds, kind)
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    along = F.desc("_part") if descending else F.asc("_part")
    before = Window.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    dealt = df.withColumn("_part", part).repartitionById(len(bounds) + 1, "_part")
    order = [F.desc(k) if descending else F.asc(k) for k in (key[f"k{i}"] for i in range(len(keys)))]
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    names = df.columns if into in df.columns else [*df.columns, into]
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumn(into, (F.col("_before") + F.col("_place")).cast("long")).select(*names)


def renumber(df: DataFrame) -> DataFrame:
    """df with its ordinals made dense again."""
    return with_position(df, "ord")


# Adapters: the driver's tables as records.

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGTACGTNACGTACGTACGTA"
_QUALS = "!$(+/258:;<=>?@ABCDEFGHIJK"


def letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as FASTQ records: letters stand for bases and qualities."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    own = letters(F.col("text"))
    return docs.select(
        F.lit("documents").alias("file"),
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.concat_ws(" ", "lang", "source").alias("desc"),
        F.translate(own, _LOWER, _BASES).alias("seq"),
        F.translate(own, _LOWER, _QUALS).alias("qual"),
    )


def half_mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two mates of each read: its first half, and the reverse complement of the rest."""
    from .functions import reverse_complement

    r = reads(spark, sf_dir)
    half = F.floor(F.length("seq") / 2).cast("int")
    rest = F.length("seq") - half
    one = r.select("file", "ord", F.concat("id", F.lit("/1")).alias("id"), "desc", F.substr("seq", F.lit(1), half).alias("seq"), F.substr("qual", F.lit(1), half).alias("qual"))
    two = r.select("file", "ord", F.concat("id", F.lit("/2")).alias("id"), "desc", reverse_complement(F.substr("seq", half + 1, rest)).alias("seq"), F.reverse(F.substr("qual", half + 1, rest)).alias("qual"))
    return one, two


def turn_mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User and assistant turns of conversations, numbered by (conv_id, turn): mates that mostly don't match."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = []
    for mate, role, back in (("/1", "user", 0), ("/2", "assistant", 1)):
        own = turns.where(F.col("role") == role)
        own = letters(F.col("text")).alias("_l"), F.concat_ws(".", "conv_id", (F.col("turn") - back)).alias("_k"), "conv_id", "turn"
        rows = turns.where(F.col("role") == role).select(*own)
        rows = with_position(rows, "conv_id", "turn")
        found.append(
            rows.select(
                F.lit(role).alias("file"), "ord", F.concat("_k", F.lit(mate)).alias("id"), F.lit(None).cast("string").alias("desc"),
                F.translate("_l", _LOWER, _BASES).alias("seq"), F.translate("_l", _LOWER, _QUALS).alias("qual"),
            )
        )
    return found[0], found[1]
