"""Reading and writing of sequence files.

`read_fastx` is a Python data source with a partition for each file (FASTQ, whose records may wrap, can't be
cut anywhere else).  `read_fasta_text` and `read_sam` go through Spark's own text reader, which splits plain
files, reads every file system that Spark does, and keeps the work inside the JVM.
"""

from __future__ import annotations

import glob
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import full_name
from ..model import RECORD, plan_bytes
from . import parsing
from .parsing import SequenceError, codec_of, detect, format_by_name

_ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("id", pa.string()), ("desc", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
_BATCH_BYTES = 4 << 20
#: Up to so many rows, one a file or split, are broadcast (some 100 MB).
MOST_BLOCKS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder; where none is set, on one machine, in a folder made for it.

    On a cluster a folder of the driver's would be no other machine's, so there a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """A mounted path without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def expand(paths: str | list[str]) -> list[str]:
    found: list[str] = []
    for p in map(local, [paths] if isinstance(paths, str) else paths):
        more = sorted(glob.glob(f"{p}/*") if os.path.isdir(p) else glob.glob(p))
        found += [x for x in more if os.path.isfile(x) and not os.path.basename(x).startswith(("_", "."))] or [p]
    return found


class _File(InputPartition):
    """A file, or the records that begin in a range of its bytes."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


def _ranges(path: str, options: dict) -> list[_File]:
    size = int(options.get("splitbytes", "0"))
    if not size or codec_of(path, options.get("compression", "auto")) != "none" or not os.path.isfile(path):
        return [_File(path)]
    if detect(path, options.get("format", "auto"), "none") not in ("fasta", "fastq"):
        return [_File(path)]
    total = os.path.getsize(path)
    return [_File(path, at, min(total, at + size)) for at in range(0, max(total, 1), size)]


def _batches(part: _File, options: dict) -> Iterator[pa.RecordBatch]:
    wanted = set(options.get("columns", "id,desc,seq,qual").split(","))
    most = int(options.get("maxrecords", "0"))
    flag = lambda name: options.get(name, "false").lower() == "true"
    path, kind = part.path, options.get("format", "auto")
    if part.stop is None:
        records = enumerate(parsing.parse(path, kind, options.get("compression", "auto"), flag("rawheader"), flag("strict"), not flag("alignments")))
    else:
        records = parsing.parse_range(path, detect(path, kind, "none"), part.start, part.stop, flag("rawheader"))
    keep = [n in wanted for n in ("id", "desc", "seq", "qual")]
    columns: list[list] = [[], [], [], []]
    places: list[int] = []
    size = n = 0

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([path] * len(places), pa.string()), pa.array(places, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], schema=_ARROW)
        for c in (places, *columns):
            c.clear()
        return out

    for place, record in records:
        if most and n >= most:
            break
        places.append(place)
        for c, value, use in zip(columns, record, keep, strict=True):
            c.append(value if use else None)
        size += len(record[2])
        n += 1
        if size >= _BATCH_BYTES or len(places) >= 10_000:
            yield flush()
            size = 0
    if places:
        yield flush()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [part for p in expand(self.options["path"].split("\n")) for part in _ranges(p, self.options)]

    def read(self, partition):
        yield from _batches(partition, self.options)


class _StreamReader(DataSourceStreamReader):
    """New files of a folder, in the order of their names; each file is one partition of one batch."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        found = expand(self.options["path"])
        return {"after": max((f for f in found if os.path.isfile(f)), default="")}

    def partitions(self, start, end):
        return [_File(f) for f in expand(self.options["path"]) if os.path.isfile(f) and start["after"] < f <= end["after"]]

    def read(self, partition):
        yield from _batches(partition, self.options)


class _Part(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """One file for each partition; files get their names when the whole job is done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.format, self.codec = local(options["path"]), options.get("format", "fasta"), options.get("compression", "none")
        self.run, self.overwrite = uuid.uuid4().hex[:8], overwrite

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        end = {"fasta": "fa", "fastq": "fq", "bam": "bam"}[self.format] + {"none": "", "gz": ".gz", "xz": ".xz"}[self.codec]
        name = f"{self.path}/.part-{context.partitionId():05d}-{self.run}-{context.attemptNumber()}.{end}"
        with open_writer(name, self.codec) as f:
            if self.format == "bam":
                parsing.write_bam(f, ((r.id, r.seq, r.qual) for r in rows))
                return _Part(name)
            for r in rows:
                f.write(render(self.format, r.id, r.desc, r.seq, r.qual).encode("utf-8") if (r.seq or "").isascii() else render_bytes(self.format, r.id, r.desc, r.seq, r.qual))
        return _Part(name)

    def commit(self, messages):
        done = {m.path for m in messages if m}
        if self.overwrite:
            for f in glob.glob(f"{self.path}/part-*"):
                os.remove(f)
        for f in sorted(done):
            os.replace(f, f"{self.path}/{os.path.basename(f)[1:]}")

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FastxSource(DataSource):
    """format("fastx"): options path (several, one a line), format, compression, rawHeader, strict, columns, maxRecords, alignments, splitBytes."""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def read_fastx(spark: SparkSession, paths, format: str = "auto", compression: str = "auto", raw_header: bool = False, strict: bool = False, columns=("id", "desc", "seq", "qual"), max_records: int = 0, alignments: bool = False, split_bytes: int = 0) -> DataFrame:
    """Records of FASTA and FASTQ files (and SAM, BAM with `alignments`); columns that aren't wanted are null.

    Every file's format and codec are settled one by one, so they may be mixed.  A file is one partition, and
    ordinals count its records.  With `split_bytes`, plain FASTA files and plain FASTQ files of four lines a
    record are cut into partitions of so many bytes; ordinals are then the records' places in bytes, in order
    but with gaps (model.renumber closes them).
    """
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"path": "\n".join(paths), "format": format, "compression": compression, "rawHeader": str(raw_header).lower(), "strict": str(strict).lower(), "columns": ",".join(columns), "maxRecords": str(max_records), "alignments": str(alignments).lower(), "splitBytes": str(split_bytes)}
    return spark.read.format("fastx").options(**options).load()


def _small(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """blocks - at most a row for each file of rows' scan and each split of its bytes - to be broadcast where that bounds them."""
    most = len(rows.inputFiles()) + (plan_bytes(rows) or 0) // (64 << 20)
    return F.broadcast(blocks) if most <= MOST_BLOCKS else blocks


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(file, block, at, ...) with ord by file, block and place, and the helpers dropped.

    Only one row for each block of a file (some 128 MB) is summed up and broadcast.  `at` counts the lines of
    a task, and both uses of it read the same splits: how a scan is cut follows from its files and settings.
    """
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(_small(starts, rows), ["file", "block"]).withColumn("ord", F.col("before") + F.col("at") - F.col("first"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def read_fasta_text(spark: SparkSession, paths) -> DataFrame:
    """FASTA records by Spark's text reader: plain files are split, gzip files are read whole.

    What stands before a file's first > is a piece of its own, and is nothing if it is blank.  Unlike
    read_fastx, this reader can't see a record of a single > that ends a file without a line end.
    """
    rows = _numbered(_lines(spark.read.option("lineSep", "\n>").text(paths)).withColumn("at", F.monotonically_increasing_id()))
    blank = (F.col("ord") == 0) & F.col("value").rlike("\\A[\\r\\n]*\\z")
    starts = rows.where(blank).select("file", F.lit(1).alias("lead")).distinct()
    rows = rows.where(~blank).join(_small(starts, rows), "file", "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
    whole = F.when(F.col("ord") == 0, F.regexp_replace("value", "\\A[\\r\\n]*", "")).otherwise(F.concat(F.lit(">"), F.col("value")))
    rows = rows.withColumn("value", whole).withColumn("ord", F.col("ord") - F.col("lead"))
    bad = F.concat(F.lit("a record begins with "), F.substring("value", 1, 20))
    rows = rows.where(F.when(F.col("value").startswith(">"), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))
    head = F.regexp_replace(F.regexp_extract("value", "\\A>([^\\n]*)", 1), "\\r+\\z", "")
    body = F.translate(F.regexp_replace("value", "\\A[^\\n]*", ""), "\r\n", "")
    return rows.select("file", "ord", header_id(head).alias("id"), header_desc(head).alias("desc"), body.alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_fastq_text(spark: SparkSession, paths) -> DataFrame:
    """FASTQ records of four lines each by Spark's text reader: plain files are split, any file system works.

    Lines are numbered by file and the four of a record are brought together by one shuffle.  Blank lines may
    only end a file.
    """
    rows = _numbered(_lines(spark.read.option("lineSep", "\n").text(paths)).withColumn("at", F.monotonically_increasing_id()))
    line = F.struct(F.pmod("ord", F.lit(4)).alias("k"), F.regexp_replace("value", "\\r+\\z", "").alias("v"))
    whole = rows.groupBy("file", F.floor(F.col("ord") / 4).alias("place")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["v"]).alias("f"))
    whole = whole.where(F.exists("f", lambda v: v != ""))
    head, seq, plus, qual = (F.get("f", F.lit(i)) for i in range(4))
    fine = F.coalesce(head.startswith("@") & plus.startswith("+") & (F.length(seq) == F.length(qual)), F.lit(False))
    bad = F.concat(F.lit("not a FASTQ record of four lines: "), F.substring(head, 1, 40))
    whole = whole.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))
    name = F.substring(head, 2, 1 << 30)
    return whole.select("file", F.col("place").alias("ord"), header_id(name).alias("id"), header_desc(name).alias("desc"), seq.alias("seq"), qual.alias("qual"))


def header_id(header: Column) -> Column:
    return F.regexp_extract(header, "\\A[^ \\t]*", 0)


def header_desc(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, "\\A[^ \\t]*[ \\t]+(?s)(.*)\\z", 1), F.lit(""))


def read_sam(spark: SparkSession, paths) -> DataFrame:
    """Alignments of SAM files by Spark's text reader: id, seq and qual; * stands for nothing."""
    rows = _lines(spark.read.text(paths)).withColumn("value", F.regexp_replace("value", "\\r\\z", "")).where("value <> '' and not startswith(value, '@')")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t"))
    seq = F.when(F.get("f", F.lit(9)) == "*", "").otherwise(F.get("f", F.lit(9)))
    qual = F.when(F.get("f", F.lit(10)) != "*", F.get("f", F.lit(10)))
    short = F.concat(F.lit("an alignment of fewer than 11 fields: "), F.substring("value", 1, 40))
    uneven = F.concat(F.lit("sequence and quality differ in length: "), F.substring("value", 1, 40))
    fine = F.when(F.size("f") < 11, F.raise_error(short).cast("boolean")).when(qual.isNotNull() & (F.length(qual) != F.length(seq)), F.raise_error(uneven).cast("boolean")).otherwise(F.lit(True))
    return _numbered(rows.where(fine)).select("file", "ord", F.get("f", F.lit(0)).alias("id"), F.lit(None).cast("string").alias("desc"), seq.alias("seq"), qual.alias("qual"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A pattern a line, trimmed, blank ones left out."""
    return spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n\x0b\x0c")).alias("pattern")).where("pattern <> ''")


def load_patterns(pattern: str | None = None, path: str | None = None) -> list[str]:
    """One pattern as given, else those of a file; none at all is an error."""
    if pattern is not None:
        if not pattern.strip():
            raise ValueError("the pattern is empty")
        return [pattern.strip()]
    if path is None:
        raise ValueError("give a pattern or a pattern file")
    with open(path, encoding="utf-8") as f:
        found = [x.strip() for x in f if x.strip()]
    if not found:
        raise ValueError(f"{path} holds no patterns")
    return found


def load_mapping(path: str) -> dict[str, str]:
    """old and new ids, tab between them; of an id's several lines the last counts."""
    found: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            line = line.rstrip()
            if not line:
                continue
            cells = line.split("\t")
            if len(cells) != 2 or not all(cells):
                raise ValueError(f"{path}, line {number}: two ids with a tab between them are needed")
            found[cells[0]] = cells[1]
    return found


def render(format: str, id_: str, desc: str | None, seq: str, qual: str | None) -> str:
    name = id_ if desc is None else f"{id_} {desc}"
    if format == "fasta":
        return f">{name}\n{seq}\n"
    if qual is None:
        raise SequenceError(f"record {id_} has no qualities for FASTQ")
    return f"@{name}\n{seq}\n+\n{qual}\n"


def render_bytes(format: str, id_: str, desc: str | None, seq: str, qual: str | None) -> bytes:
    """Ids in UTF-8, sequences and qualities a byte for each character."""
    name = (id_ if desc is None else f"{id_} {desc}").encode("utf-8")
    body = seq.encode("latin-1")
    if format == "fasta":
        return b">" + name + b"\n" + body + b"\n"
    if qual is None:
        raise SequenceError(f"record {id_} has no qualities for FASTQ")
    return b"@" + name + b"\n" + body + b"\n+\n" + qual.encode("latin-1") + b"\n"


def open_writer(path: str, codec: str):
    import gzip
    import lzma

    if codec == "gz":
        return gzip.open(path, "wb", compresslevel=3)
    return lzma.open(path, "wb", preset=6) if codec == "xz" else open(path, "wb")


def write_fastx(df: DataFrame, path: str, format: str = "fasta", compression: str = "none", ordered: bool = True, mode: str = "overwrite") -> None:
    """A folder of part files, in the order of their names where `ordered`: ranges of ordinals, each sorted."""
    if format not in ("fasta", "fastq"):
        raise ValueError("format is fasta or fastq")
    out = df.select("ord", "id", "desc", "seq", "qual")
    if ordered:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        out = out.repartitionByRange(n, "ord").sortWithinPartitions("ord")
    if compression in ("none", "gz"):
        name = full_name(F.col("id"), F.col("desc"))
        missing = F.raise_error(F.concat(F.lit("no qualities for FASTQ in record "), F.col("id"))).cast("string")
        line = F.concat(F.lit(">"), name, F.lit("\n"), F.col("seq")) if format == "fasta" else F.concat(F.lit("@"), name, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.coalesce("qual", missing))
        out.select(line.alias("value")).write.mode(mode).option("compression", "gzip" if compression == "gz" else "none").text(path)
        return
    register(df.sparkSession)
    out.write.format("fastx").option("format", format).option("compression", compression).mode(mode).save(path)


def write_bam(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unmapped alignments as BAM part files: letters outside its sixteen become N, null qualities are missing."""
    register(df.sparkSession)
    df.select("ord", "id", "desc", "seq", "qual").write.format("fastx").option("format", "bam").mode(mode).save(path)


def write_single(df: DataFrame, path: str, format: str, compression: str = "auto") -> None:
    """One file, record by record in order, through the driver; "-" is standard output."""
    import sys

    rows = df.select("ord", "id", "desc", "seq", "qual").orderBy("ord").toLocalIterator(prefetchPartitions=True)
    codec = codec_of(path, compression)
    out = sys.stdout.buffer if path == "-" else open_writer(path, codec)
    if path == "-" and codec != "none":
        import gzip
        import lzma

        out = gzip.GzipFile(fileobj=sys.stdout.buffer, mode="wb", compresslevel=3) if codec == "gz" else lzma.LZMAFile(sys.stdout.buffer, "wb", preset=6)
    try:
        for r in rows:
            out.write(render_bytes(format, r.id, r.desc, r.seq, r.qual))
        out.flush()
    finally:
        if out is not sys.stdout.buffer:
            out.close()


__all__ = ["FastxSource", "SequenceError", "detect", "format_by_name", "load_mapping", "load_patterns", "read_fasta_text", "read_fastq_text", "read_fastx", "read_patterns", "read_sam", "write_bam", "write_fastx", "write_single"]
