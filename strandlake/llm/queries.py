"""The queries of this subpackage for the driver, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, line_templates, lm_scoring, ngram_join, packing, pii, quality_rules, string_tiling, toxicity, warc
from .common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.sample(docs, labels), prior=toxicity.prior(labels))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_tiles, covered_words and item_words of each leak."""
    found = string_tiling.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tiles", "covered_words", "item_words")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document."""
    docs = quality_rules.annotate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return docs.select("doc_id", *(F.col("quality")[n].alias(n) for n in names))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read from the archive."""
    archive = warc.write_archive(read_table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words and mean_log_score (natural, to six decimals) of each document."""
    found = lm_scoring.scores(read_table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6))
    return found.select("doc_id", "n_words", mean.alias("mean_log_score"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_cut and the text that is left of each document."""
    return line_templates.drop_recurring(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "n_cut", "text")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and a digest of the base spans, and all spans of each document."""
    docs = read_table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda span: F.startswith(span, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op10_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the segments written."""
    docs = read_table(spark, sf_dir, "documents")
    segments = bitpack.write_segments(docs, vocabulary("word_bpe_49k.json"), 49_408, end_id=2)
    read = bitpack.read_segments(segments).select("part", "segment", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return bitpack.with_global_start(read, segments).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_string_tiling, op3_ngram_jaccard_join, op4_quality_rules, op5_retrieval_packing, op6_warc, op7_stupid_backoff, op8_line_templates, op9_pii, op10_bit_packing)}
