"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame
with the columns of docs (the last: pieces of packed sequences).  Null and empty texts fail the quality
rules, so they go with the first stage; the later stages still accept them.  Columns beyond doc_id and text
pass through, whatever their names; n_chars, where there is one, follows the text.

Rows that share a doc_id but not their text all stay, unless a stage rejects them; where line dedup, near
duplicates or decontamination decide by doc_id, they share the verdict.  Of rows equal in doc_id and text one
stays (any, where further columns differ).  Rows without a doc_id can't be grouped with others: they pass
line dedup, near duplicates and decontamination with all their text, but for exact copies among themselves.
Packing names pieces by doc_id and leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import line_templates, ngram_join, packing, quality_rules, string_tiling
from strandlake.llm.common import read_table, small_batches, stored, unused
from strandlake.llm.queries import vocabulary

#: Up to so many leaked documents (8 MB of ids) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    name = unused(docs, "rules")
    return quality_rules.annotate(docs, into=name).where(F.col(name)["kept"]).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; documents of which nothing is left go too.

    Whole lines alone: a benchmark passage within a line has to reach decontamination as it is, since one that
    is cut at its sentences leaves their ends behind in documents that would then pass.
    """
    small_batches(spark)
    names = docs.columns
    kept = {n: unused(docs, n + "_kept") for n in ("n_lines", "n_dropped", "n_cut") if n in names}
    out = line_templates.drop_recurring(docs.withColumnsRenamed(kept), least_sentence=None)
    out = out.where("n_lines = 0 or n_dropped < n_lines").drop("n_lines", "n_dropped", "n_cut").withColumnsRenamed({b: a for a, b in kept.items()})
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    It stays with each of its texts, once.  Rows without a doc_id are in no group and stay, each text once.
    """
    small_batches(spark)
    groups = ngram_join.near_duplicates(docs)
    name = unused(docs, "first")
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    here = docs.join(first, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    here = here.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
    text = unused(docs, "fingerprint")
    return here.withColumn(text, F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", text]).drop(text)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    found = string_tiling.leaks(docs, read_table(spark, sf_dir, "benchmark"))
    name = unused(docs, "leaked")
    leaked = stored(found.select(F.col("doc_id").alias(name)).distinct(), "leaked")
    leaked = F.broadcast(leaked) if leaked.count() <= MOST_BROADCAST else leaked
    return docs.join(leaked, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    small_batches(spark)
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Line dedup, tiling and packing have no form in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
