"""stats: one row of figures for each file, and the TOTAL row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X

COLUMNS = (
    "file", "format", "seq_type", "records", "total_bases", "min_len", "max_len", "mean_len", "gc_pct", "n50", "l50",
    "q1_len", "median_len", "q3_len", "n_pct", "q10_pct", "q20_pct", "q30_pct",
)
QUALITIES = (10, 20, 30)
#: Fixed value: letters that aren't nucleotides make a protein if they are more than this share of all letters.
PROTEIN_SHARE = 0.05


_COUNTS = {"_gc": "GCgc", "_n": "Nn", "_alpha": X.LOWER + X.UPPER, "_nuc": "ACGTUNacgtun", "_u": "Uu", "_t": "Tt"}


def _tallies(quality: bool):
    """len and, by name, how many letters of each kind a record has: numpy over the buffers of whole batches."""

    def table(letters) -> np.ndarray:
        found = np.zeros(256, np.uint8)
        found[list(letters)] = 1
        return found

    kinds = {name: table(letters.encode()) for name, letters in _COUNTS.items()}
    above = {f"_q{q}": table(range(33 + q, 256)) for q in QUALITIES} if quality else {}

    def of(column: pa.Array, tables: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        data, offsets = X.latin_bytes(column)
        upto = np.zeros(len(data) + 1, np.int64)
        found = []
        for t in tables.values():
            np.cumsum(t[data], dtype=np.int64, out=upto[1:])
            found.append(np.diff(upto[offsets]))
        return np.diff(offsets), found

    def run(batches):
        for b in batches:
            lengths, letters = of(b.column(1), kinds)
            quals, levels = of(b.column(2), above)
            missing = np.asarray(b.column(1).is_null())
            arrays = [pa.array(lengths, mask=missing), b.column(2).is_valid(), *map(pa.array, letters), pa.array(quals), *map(pa.array, levels)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["file", "len", "_fastq", *kinds, "_quals", *above])

    schema = ", ".join(["file string", "len long", "_fastq boolean", *(f"{n} long" for n in (*kinds, "_quals", *above))])
    return run, schema, [*kinds, "_quals", *above]


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def stats(df: DataFrame, quality: bool = True, format: Column | str | None = None, raw_quality: bool = False) -> DataFrame:
    """Figures by file over records(file, seq, qual).

    One pass over the records counts letters in Arrow batches (a nanosecond a byte and kind, where translate and
    regular expressions take ten); an aggregate by file and length, combined before the shuffle, leaves a
    row for each length that occurs.  Windows over these rows find N50, L50 and the quartiles, and a second
    aggregate adds up the rest, so records are neither sorted nor read twice.

    Quartiles are nearest ranks, round(p (n - 1)) from 0, without interpolation.  GC and N are percentages of
    all characters.  Quality percentages are null without qualities.  `format` defaults to fastq where there
    are qualities and fasta elsewhere.
    """
    run, schema, sums = _tallies(quality)
    tallies = df.select("file", F.col("seq").cast("string").alias("seq"), F.col("qual").cast("string").alias("qual")).mapInArrow(run, schema)
    hist = tallies.groupBy("file", "len").agg(F.count("*").alias("cnt"), F.max("_fastq").alias("_fastq"), *(F.sum(n).alias(n) for n in sums))

    own = Window.partitionBy("file")
    up = own.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = own.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = F.col("len") * F.col("cnt")
    run = hist.withColumns({
        "cb": F.sum(bases).over(down), "cr": F.sum("cnt").over(down), "tb": F.sum(bases).over(own),
        "seen": F.sum("cnt").over(up), "n": F.sum("cnt").over(own),
    })
    half = F.col("tb") * 0.5
    reached = (F.col("tb") > 0) & (F.col("cb") >= half)
    needed = F.least(F.greatest(F.ceil((half - (F.col("cb") - bases)) / F.greatest("len", F.lit(1))), F.lit(1)), F.col("cnt"))

    def rank(p: float) -> Column:
        return F.min(F.when(F.col("seen") > F.round(F.lit(p) * (F.col("n") - 1)), F.col("len")))

    both = run.groupBy("file").agg(
        F.sum("cnt").alias("records"), F.sum(bases).alias("total_bases"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.max("_fastq").alias("_fastq"), *(F.sum(n).alias(n) for n in sums),
        F.max(F.when(reached, F.col("len"))).alias("n50"),
        F.max_by(F.col("cr") - F.col("cnt") + needed, F.when(reached, F.col("len"))).alias("l50"),
        rank(0.25).alias("q1_len"), rank(0.5).alias("median_len"), rank(0.75).alias("q3_len"),
    )
    total, other = F.col("total_bases"), F.col("_alpha") - F.col("_nuc")
    kind = (
        F.when(F.coalesce("_alpha", F.lit(0)) == 0, "NA")
        .when(other / F.col("_alpha") > PROTEIN_SHARE, "protein")
        .when((F.col("_u") > 0) & (F.col("_t") == 0), "RNA")
        .otherwise("DNA")
    )
    fmt = F.when(F.col("_fastq"), "fastq").otherwise("fasta") if format is None else (F.lit(format) if isinstance(format, str) else format)
    shares = [(F.when(F.col("_fastq"), X.percent(_long(F.col(f"_q{q}")), _long(F.col("_quals")))) if quality else F.lit(None).cast("double")).alias(f"q{q}_pct") for q in QUALITIES]
    return both.select(
        "file", fmt.alias("format"), kind.alias("seq_type"), _long(F.col("records")).alias("records"), _long(total).alias("total_bases"),
        _long(F.col("min_len")).alias("min_len"), _long(F.col("max_len")).alias("max_len"),
        F.when(F.col("records") == 0, 0.0).otherwise(_long(total) / F.col("records")).alias("mean_len"),
        X.percent(_long(F.col("_gc")), _long(total)).alias("gc_pct"),
        *(_long(F.col(c)).alias(c) for c in ("n50", "l50", "q1_len", "median_len", "q3_len")),
        X.percent(_long(F.col("_n")), _long(total)).alias("n_pct"), *shares,
    )


def with_empty_files(rows: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """rows with a row of zeros for each (file, format) that has none."""
    spark = rows.sparkSession
    have = spark.createDataFrame(files, "file string, format string").join(rows.select("file"), "file", "left_anti")
    zeros = {"seq_type": F.lit("NA"), **{c: F.lit(0).cast("long") for c in ("records", "total_bases", "min_len", "max_len", "n50", "l50", "q1_len", "median_len", "q3_len")}}
    zeros |= {c: F.lit(0.0) for c in ("mean_len", "gc_pct", "n_pct")} | {c: F.lit(None).cast("double") for c in ("q10_pct", "q20_pct", "q30_pct")}
    return rows.unionByName(have.withColumns(zeros).select(*COLUMNS))


def stats_total(rows: DataFrame) -> DataFrame:
    """The TOTAL row of stats rows: sums and extremes; percentages weighted by bases; N50, L50 and quartiles are
    the largest of any file, not computed anew."""
    bases = F.sum("total_bases")

    def weighted(c: str) -> Column:
        return F.when(F.coalesce(bases, F.lit(0)) == 0, 0.0).otherwise(F.sum(F.col(c) * F.col("total_bases")) / bases)

    def where_known(c: str) -> Column:
        known = F.sum(F.when(F.col(c).isNotNull(), F.col("total_bases")))
        return F.when(F.count(c) == 0, F.lit(None)).when(known == 0, 0.0).otherwise(F.sum(F.col(c) * F.col("total_bases")) / known)

    records = F.sum("records")
    return rows.agg(
        F.lit("TOTAL").alias("file"), F.lit("mixed").alias("format"), F.lit("mixed").alias("seq_type"),
        _long(records).alias("records"), _long(bases).alias("total_bases"), _long(F.min("min_len")).alias("min_len"), _long(F.max("max_len")).alias("max_len"),
        F.when(F.coalesce(records, F.lit(0)) == 0, 0.0).otherwise(bases / records).alias("mean_len"), weighted("gc_pct").alias("gc_pct"),
        *(_long(F.max(c)).alias(c) for c in ("n50", "l50", "q1_len", "median_len", "q3_len")),
        weighted("n_pct").alias("n_pct"), *(where_known(f"q{q}_pct").alias(f"q{q}_pct") for q in QUALITIES),
    )
