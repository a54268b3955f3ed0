"""The thirteen commands: python -m strandlake.cli <command> ...

Each builds one DataFrame plan from its arguments and writes one ordered file; the operators do all work.
Standard input is spooled to a file first, since Spark reads files.
"""

from __future__ import annotations

import argparse
import atexit
import os
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .operators import duplicates, order, pairs, records, rename, sampling, search, stats
from .plans import report
from .sources import parsing


class Usage(ValueError):
    """Arguments that don't go together."""


def session(threads: int | None, progress: bool = False) -> SparkSession:
    n = threads if threads else min(os.cpu_count() or 1, 10)
    active = SparkSession.getActiveSession()
    if active:
        return active
    spark = SparkSession.builder.master(f"local[{n}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(progress).lower()).config("spark.sql.shuffle.partitions", str(n)).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spooled(path: str | None) -> str:
    """The path, or a file with what stands on standard input."""
    if path not in (None, "-"):
        return path
    with tempfile.NamedTemporaryFile(prefix="stdin-", delete=False) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    atexit.register(os.remove, f.name)
    return f.name


class Job:
    """What commands share: arguments, session, reading and writing."""

    def __init__(self, args: argparse.Namespace):
        self.args, self.spark = args, session(args.threads, getattr(args, "progress", False) and not args.quiet)
        self.format = ""

    def read(self, path: str | None, **options) -> DataFrame:
        path = spooled(path)
        self.format = parsing.detect(path, self.args.format)
        return sources.read_fastx(self.spark, path, self.format, **options)

    def mates(self) -> tuple[str, str] | None:
        one, two = getattr(self.args, "in1", None), getattr(self.args, "in2", None)
        if one is None and two is None:
            return None
        if one is None or two is None:
            raise Usage("give both mates or neither")
        if self.args.input is not None:
            raise Usage("give mates or a single input, not both")
        return one, two

    def zipped(self, mates: tuple[str, str]) -> DataFrame:
        one, two = (sources.read_fastx(self.spark, p, "fastq") for p in mates)
        self.format = "fastq"
        return pairs.zip_mates(one, two)

    def source(self) -> tuple[DataFrame, bool]:
        """Records, or the valid pairs where mates are given."""
        mates = self.mates()
        if mates:
            return pairs.validate_pairs(self.zipped(mates), self.args.allow_unpaired), True
        return self.read(self.args.input), False

    def write(self, df: DataFrame, paired: bool = False) -> None:
        a = self.args
        if not paired:
            sources.write_single(df, a.output, self.format, a.compression)
            return
        if a.output2 is None:
            raise Usage("paired output needs --output2")
        df = df.persist()
        for which, path in ((1, a.output), (2, a.output2)):
            sources.write_single(pairs.mate(df, which), path, "fastq", a.compression)
        df.unpersist()


def lines(df: DataFrame, column: str, path: str) -> None:
    out = sys.stdout if path == "-" else open(path, "w", encoding="utf-8")
    for r in df.orderBy("ord").select(column).toLocalIterator():
        out.write(f"{r[0]}\n")
    if path == "-":
        out.flush()
    else:
        out.close()


def run_stats(job: Job) -> None:
    a = job.args
    paths = a.inputs or ["-"]
    kinds, frames = [], []
    for name in paths:
        path = spooled(name)
        kind = parsing.detect(path, a.format, records_only=False)
        kinds.append((name, kind))
        frames.append(sources.read_fastx(job.spark, path, kind, columns=("id", "seq", "qual"), alignments=True, strict=True).withColumn("file", F.lit(name)))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    formats = F.create_map(*(F.lit(x) for pair in kinds for x in pair))
    quality = a.all or a.json
    rows = stats.stats(df, quality=quality, format=formats[F.col("file")])
    rows = stats.with_empty_files(rows, kinds).orderBy("file").persist()
    found = [r.asDict() for r in rows.collect()]
    if a.json:
        sys.stdout.write(report.as_json(found))
    elif a.tsv:
        sys.stdout.write(report.tsv(found, a.all))
    else:
        total = stats.stats_total(rows).first().asDict() if len(found) > 1 and not a.per_file else None
        sys.stdout.write(report.table(found, total, a.all))


def run_seq(job: Job) -> None:
    a = job.args
    changes = (a.min_len, a.max_len, a.min_qual, a.max_qual, a.rev, a.comp, a.revcomp, a.upper, a.lower, a.remove_gaps, a.validate_seq)
    plain = not any(x not in (None, False) for x in changes) and not (a.name or a.only_id or a.seq)
    df = job.read(a.input, raw_header=plain)
    if (a.min_qual is not None or a.max_qual is not None) and job.format == "fasta":
        raise Usage("a quality filter needs FASTQ records")
    df = records.seq(df, a.min_len, a.max_len, a.min_qual, a.max_qual, a.qual_ascii_base, a.rev, a.comp, a.revcomp, a.upper, a.lower, a.remove_gaps, a.gap_letters, a.validate_seq)
    if a.color:
        df = df.withColumn("seq", X.coloured(F.col("seq")))
    if a.seq:
        lines(df, "seq", a.output)
    elif a.only_id or (a.name and not a.full_name):
        lines(df, "id", a.output)
    elif a.name:
        lines(records.names(df, full=True), "name", a.output)
    else:
        job.write(df)


def run_fq2fa(job: Job) -> None:
    df = job.read(job.args.input)
    if job.format != "fastq":
        raise Usage("fq2fa needs FASTQ input")
    job.format = "fasta"
    job.write(records.fq2fa(df))


def run_grep(job: Job) -> None:
    a = job.args
    patterns = sources.load_patterns(a.pattern, a.pattern_file)
    df, paired = job.source()
    if paired:
        df = search.grep_pairs(df, patterns, a.by, a.regex, a.ignore_case, a.invert, a.pair_mode)
    else:
        df = search.grep(df, patterns, a.by, a.regex, a.ignore_case, a.invert)
    if a.count:
        print(df.count())
    elif a.only_names:
        lines(df, "id1" if paired else "id", "-")
    else:
        job.write(df, paired)


def run_locate(job: Job) -> None:
    a = job.args
    found = search.locate(job.read(a.input), sources.load_patterns(a.pattern, a.pattern_file), a.regex, a.ignore_case, a.all, a.bed)
    out = found.orderBy("ord", "pattern_index", "start").select("ord", F.concat_ws("\t", "id", "start", "end", "match").alias("line"))
    sink = sys.stdout if a.output == "-" else open(a.output, "w", encoding="utf-8")
    for r in out.toLocalIterator():
        sink.write(r.line + "\n")
    if a.output == "-":
        sink.flush()
    else:
        sink.close()


def run_sample(job: Job) -> None:
    a = job.args
    if job.mates() and a.rate is None and a.num == 0:  # nothing is drawn, so nothing is checked
        a.allow_unpaired = True
    df, paired = job.source()
    job.write(sampling.sample(df, a.num, a.rate, a.seed), paired)


def run_rmdup(job: Job) -> None:
    a = job.args
    if a.keep_first and a.keep_last:
        raise Usage("keep the first or the last, not both")
    df, paired = job.source()
    job.write(duplicates.rmdup(df, a.by, "last" if a.keep_last else "first", a.count_dup, a.mark_dup), paired)


def run_rename(job: Job) -> None:
    a = job.args
    mapping = sources.load_mapping(a.map_file) if a.map_file else None
    df, paired = job.source()
    job.write(rename.rename(df, a.mode, a.prefix, a.start, a.width, a.template, mapping, a.match_regex, a.replace, a.keep_pair_suffix), paired)


def run_sort(job: Job) -> None:
    a = job.args
    job.write(order.sort(job.read(a.input), a.by, a.numeric, a.reverse))


def run_shuffle(job: Job) -> None:
    df, paired = job.source()
    job.write(sampling.shuffle(df, job.args.seed), paired)


def run_spike(job: Job) -> None:
    a = job.args
    if bool(job.mates()) != (a.add2 is not None):
        raise Usage("paired input needs both --add and --add2, single input only --add")
    df, paired = job.source()
    if paired:
        add = pairs.validate_pairs(job.zipped((a.add, a.add2)), a.allow_unpaired)
    else:
        add = sources.read_fastx(job.spark, a.add, job.format)
    job.write(sampling.spike(df, add, a.seed), paired)


def run_head(job: Job) -> None:
    a = job.args
    order.checked_limit(a.num, a.proportion)
    mates = job.mates()
    if mates:
        job.write(order.head_zipped(job.zipped(mates), a.num, a.proportion, a.allow_unpaired), True)
    elif a.num is not None:
        job.write(order.head(job.read(a.input, max_records=a.num) if a.num else job.read(a.input), a.num))
    else:
        job.write(order.head(job.read(a.input), proportion=a.proportion))


def run_tail(job: Job) -> None:
    a = job.args
    df, paired = job.source()
    job.write(order.tail(df, a.num, a.proportion), paired)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, paired: bool = False, short_mates: bool = True, single: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if single:
            p.add_argument("input", nargs="?")
            p.add_argument("-o", "--output", default="-")
            p.add_argument("--compression", choices=parsing.CODECS, default="auto")
        p.add_argument("--format", choices=parsing.FORMATS, default="auto")
        p.add_argument("-t", "--threads", type=int)
        p.add_argument("--quiet", action="store_true")
        if paired:
            mates = (("-i", "-1"), ("-I", "-2")) if short_mates else (("-1",), ("-2",))
            p.add_argument(*mates[0], "--in1", "--input", dest="in1")
            p.add_argument(*mates[1], "--in2", "--input2", dest="in2")
            p.add_argument("-O", "--output2")
            p.add_argument("--allow-unpaired", action="store_true")
        return p

    def flags(p: argparse.ArgumentParser, *names: tuple[str, ...]) -> None:
        for n in names:
            p.add_argument(*n, action="store_true")

    p = command("stats", run_stats, single=False)
    p.add_argument("inputs", nargs="*")
    flags(p, ("-T", "--tsv", "--tabular"), ("-j", "--json"), ("-a", "--all"), ("-p", "--per-file"))

    p = command("seq", run_seq)
    for short, name, kind in (("-m", "--min-len", int), ("-M", "--max-len", int), ("-Q", "--max-qual", float), ("-q", "--min-qual", float)):
        p.add_argument(short, name, type=kind)
    p.add_argument("-b", "--qual-ascii-base", type=int, default=33)
    p.add_argument("-G", "--gap-letters", default=X.GAPS)
    flags(p, ("-r", "--rev"), ("-c", "--comp"), ("-R", "--revcomp"), ("-u", "--upper"), ("-l", "--lower"), ("-k", "--color"), ("-g", "--remove-gaps"), ("-n", "--name"), ("--full-name",), ("-i", "--only-id"), ("-s", "--seq"), ("-v", "--validate-seq"))

    command("fq2fa", run_fq2fa)

    p = command("grep", run_grep, True, short_mates=False)
    p.add_argument("-p", "--pattern")
    p.add_argument("-f", "--pattern-file")
    p.add_argument("-b", "--by", choices=search.FIELDS, default="id")
    p.add_argument("-P", "--pair-mode", choices=("any", "both"), default="any")
    flags(p, ("-x", "--regex"), ("-i", "--ignore-case"), ("-v", "--invert"), ("-c", "--count"), ("-n", "--only-names"), ("--progress",))

    p = command("locate", run_locate)
    p.add_argument("-p", "--pattern")
    p.add_argument("-f", "--pattern-file")
    flags(p, ("-x", "--regex"), ("-i", "--ignore-case"), ("-a", "--all"), ("-B", "--bed"))

    p = command("sample", run_sample, True)
    p.add_argument("-n", "--num", type=int)
    p.add_argument("-r", "--rate", type=float)
    p.add_argument("-s", "--seed", type=int, default=42)
    flags(p, ("--progress",))

    p = command("rmdup", run_rmdup, True)
    p.add_argument("-b", "--by", choices=tuple(duplicates.KEYS), default="full")
    flags(p, ("-f", "--keep-first"), ("-l", "--keep-last"), ("-c", "--count-dup"), ("-m", "--mark-dup"))

    p = command("rename", run_rename, True)
    p.add_argument("-p", "--prefix", default="seq")
    p.add_argument("-s", "--start", type=int, default=1)
    p.add_argument("-w", "--width", type=int, default=6)
    p.add_argument("-e", "--template")
    p.add_argument("-m", "--map-file")
    p.add_argument("-x", "--match-regex")
    p.add_argument("-r", "--replace")
    p.add_argument("-M", "--mode", choices=rename.MODES, default="auto")
    flags(p, ("-k", "--keep-pair-suffix"))

    p = command("sort", run_sort)
    p.add_argument("-b", "--by", choices=order.SORT_KEYS, default="id")
    flags(p, ("-n", "--numeric"), ("-r", "--reverse"))
    p.add_argument("-T", "--tmp-dir")  # Spark spills where it is told to; accepted for old scripts
    p.add_argument("-m", "--mem", type=parsing.memory_size, default="128M")

    p = command("shuffle", run_shuffle, True)
    p.add_argument("-s", "--seed", type=int, default=42)
    p.add_argument("-T", "--tmp-dir")
    p.add_argument("-m", "--mem", type=parsing.memory_size, default="128M")

    p = command("spike", run_spike, True)
    p.add_argument("-a", "--add", required=True)
    p.add_argument("-A", "--add2")
    p.add_argument("-s", "--seed", type=int, default=42)

    for name, run in (("head", run_head), ("tail", run_tail)):
        p = command(name, run, True)
        p.add_argument("-n", "--num", type=int)
        p.add_argument("-p", "--proportion", type=float)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(Job(args))
        sys.stdout.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # what Spark's tasks raise comes wrapped
        found = [x for x in str(e).splitlines() if "SequenceError" in x or "USER_RAISED" in x]
        print(f"error: {(found or str(e).splitlines() or [type(e).__name__])[-1]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
