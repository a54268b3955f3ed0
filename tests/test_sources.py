"""Parsers, readers, writers and the command line, on inline inputs and generated files."""

import gzip
import lzma
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from strandlake import cli, sources
from strandlake.functions import jvm_replacement
from strandlake.model import RECORD, renumber
from strandlake.sources import parsing

A_FA = ">r1\nACGT\n>r2\nGGNN\n>r3\nTTAA\n"
A_FQ = "@r1\nACGT\n+\nIIII\n@r2\nGGNN\n+\nHHHH\n@r3\nTTAA\n+\nJJJJ\n"
B_FQ = "@r1/2\nTGCA\n+\nIIII\n@r2/2\nCCNN\n+\nHHHH\n@r3/2\nAATT\n+\nJJJJ\n"


def fasta(text, **o):
    return list(parsing.parse_fasta(text.encode("latin-1").splitlines(keepends=True), **o))


def fastq(text, **o):
    return list(parsing.parse_fastq(text.encode("latin-1").splitlines(keepends=True), **o))


def test_fasta_parser():
    assert fasta(A_FA) == [("r1", None, "ACGT", None), ("r2", None, "GGNN", None), ("r3", None, "TTAA", None)]
    assert fasta("\r\n>r1\r\nAC\r\n\r\nGT\r\n>r2\r\nTGCA\r\n") == [("r1", None, "ACGT", None), ("r2", None, "TGCA", None)]
    assert fasta(">r1   desc\tmore \nA C\n") == [("r1", "desc\tmore ", "A C", None)]
    assert fasta(">r1   desc\tmore\nACGT\n", raw=True) == [("r1   desc\tmore", None, "ACGT", None)]
    assert fasta(">a\n>b\nAC\n>") == [("a", None, "", None), ("b", None, "AC", None), ("", None, "", None)]
    assert fasta(">a\nAC\n@b\nGT\n") == [("a", None, "AC@bGT", None)]
    assert fasta(">a \nA\n") == [("a", None, "A", None)]
    assert len(fasta(">long\n" + "A" * 16384 + "\n>two\nC")[0][2]) == 16384
    assert fasta("") == [] and fasta("\n\n") == []
    for bad in (" \n", "ACGT\n", "@r1\nA\n+\nI\n"):
        with pytest.raises(parsing.SequenceError):
            fasta(bad)


def test_fastq_parser():
    assert fastq(A_FQ)[1] == ("r2", None, "GGNN", "HHHH")
    assert fastq("@r1 desc\nAC\nGT\n+\nII\nII\n") == [("r1", "desc", "ACGT", "IIII")]
    assert fastq("@a\nAC\n+a\n@+\n@b\nG\n+\n+\n") == [("a", None, "AC", "@+"), ("b", None, "G", "+")]
    assert fastq("\n@a\r\nA\r\n+\r\nI\r\n\r\n@b\nC\n+\nI") == [("a", None, "A", "I"), ("b", None, "C", "I")]
    assert fastq("@a\n+\n@b\nC\n+\nI\n") == [("a", None, "", ""), ("b", None, "C", "I")]
    with pytest.raises(parsing.SequenceError, match="4 and quality of 3"):
        fastq("@r1\nACGT\n+\n!!!\n")
    for bad in ("@r1\nACGT\n", "@r1\nAC\n+\nIII\n", ">r1\nA\n", "@r1\nAC\n>x\n+\nII\n"):
        with pytest.raises(parsing.SequenceError):
            fastq(bad)
    with pytest.raises(parsing.SequenceError):
        fastq("@a\nA\n+\nI\n\n@b\nC\n+\nI\n", strict=True)
    assert len(fastq(A_FQ, strict=True)) == 3


def test_formats_and_codecs(tmp_path):
    assert [parsing.format_by_name(p) for p in ("a.fa", "a.fasta.gz", "a.fna.xz", "a.fq", "a.fastq.gz", "a.sam.gz", "a.bam", "a.cram", "a.FA", "a.txt")] == ["fasta", "fasta", "fasta", "fastq", "fastq", "sam", "bam", "cram", None, None]
    assert [parsing.codec_of(p) for p in ("a.gz", "a.xz", "a")] == ["gz", "xz", "none"] and parsing.codec_of("a.gz", "none") == "none"
    (tmp_path / "x").write_text("\n \t>r1\nA\n")
    assert parsing.detect(str(tmp_path / "x")) == "fasta"
    (tmp_path / "y").write_text("")
    with pytest.raises(parsing.SequenceError):
        parsing.detect(str(tmp_path / "y"))
    for name in ("a.sam", "a.bam", "a.cram"):
        with pytest.raises(parsing.SequenceError, match="stats"):
            parsing.detect(name)
    assert [parsing.memory_size(x) for x in ("1G", "2m", "3k", "7", "xG", "xm", "x")] == [1 << 30, 2 << 20, 3 << 10, 7, 1 << 30, 128 << 20, 128 << 20]


def bam(records):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\x00" + struct.pack("<i", 100)
    out = [head]
    for name, seq, qual in records:
        name = name.encode() + b"\x00"
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 0, 0, 0, 4, len(seq), -1, -1, 0) + name + packed + (bytes(qual) if qual else b"\xff" * len(seq))
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    return gzip.compress(data[:30]) + gzip.compress(data[30:]) + gzip.compress(b"")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.fa").write_text(A_FA)
    (d / "a.fq").write_text(A_FQ)
    (d / "b.fq").write_text(B_FQ)
    (d / "a.fq.gz").write_bytes(gzip.compress(A_FQ[:20].encode()) + gzip.compress(A_FQ[20:].encode()))
    (d / "a.fa.xz").write_bytes(lzma.compress(b">x\nACGT\n") + lzma.compress(b">y\nTTTT\n"))
    (d / "a.bam").write_bytes(bam([("q", "ACGTN", [30] * 5), ("none", "GG", None)]))
    sam = "@HD\tVN:1.6\n" + "\t".join(["a", *["0"] * 8, "ACGTNN", "IIIIII"]) + "\n\n" + "\t".join(["b", *["0"] * 8, "GGCC", "*"]) + "\n"
    (d / "a.sam.gz").write_bytes(gzip.compress(sam.encode()))
    (d / "a.sam").write_text(sam)
    (d / "empty.fa").write_text("")
    return d


def rows(df):
    return [(r.ord, r.id, r.desc, r.seq, r.qual) for r in df.orderBy("file", "ord").collect()]


def test_readers(spark, files):
    want = [(i, *r) for i, r in enumerate(fastq(A_FQ))]
    assert rows(sources.read_fastx(spark, str(files / "a.fq"))) == rows(sources.read_fastx(spark, str(files / "a.fq.gz"))) == want
    assert [r[3] for r in rows(sources.read_fastx(spark, str(files / "a.fa.xz")))] == ["ACGT", "TTTT"]
    assert sources.read_fastx(spark, str(files / "a.f[aq]")).groupBy("file").count().count() == 2
    assert rows(sources.read_fastx(spark, str(files / "a.fq"), columns=("id",), max_records=2)) == [(0, "r1", None, None, None), (1, "r2", None, None, None)]
    assert sources.read_fastx(spark, str(files / "empty.fa")).count() == 0
    with pytest.raises(Exception, match="stats only"):
        sources.read_fastx(spark, str(files / "a.sam")).count()
    got = rows(sources.read_fastx(spark, str(files / "a.bam"), alignments=True))
    assert got == [(0, "q", None, "ACGTN", "?????"), (1, "none", None, "GG", None)]
    same = [(0, "a", None, "ACGTNN", "IIIIII"), (1, "b", None, "GGCC", None)]
    assert rows(sources.read_fastx(spark, str(files / "a.sam.gz"), alignments=True)) == rows(sources.read_sam(spark, str(files / "a.sam.gz"))) == rows(sources.read_sam(spark, str(files / "a.sam"))) == same


def test_bad_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("a\tb\n")
    (tmp_path / "y.sam").write_text("\t".join(["a", *["0"] * 8, "ACGT", "II"]) + "\n")
    for name, text in (("x.sam", "fewer than 11"), ("y.sam", "differ in length")):
        with pytest.raises(Exception, match=text):
            sources.read_sam(spark, str(tmp_path / name)).count()
        with pytest.raises(Exception, match="SequenceError"):
            sources.read_fastx(spark, str(tmp_path / name), alignments=True).count()


def test_fasta_by_the_text_reader(spark, files, tmp_path):
    cases = [A_FA, "\r\n>r1\r\nAC\r\n\r\nGT\r\n>r2\r\nTGCA\r\n", ">r1   desc\tmore \nA C\n>\n", ">a\n>b\nAC\n>\n", ">only"]
    for i, text in enumerate(cases):
        (tmp_path / f"{i}.fa").write_bytes(text.encode())
        assert rows(sources.read_fasta_text(spark, str(tmp_path / f"{i}.fa"))) == [(k, *r) for k, r in enumerate(fasta(text))], text
    (tmp_path / "end.fa").write_text(">a\n>b\nAC\n>")
    assert [r[1] for r in rows(sources.read_fasta_text(spark, str(tmp_path / "end.fa")))] == ["a", "b"]  # as documented
    many = "".join(f">s{i} d{i}\n{'ACGT' * (i % 40)}\n{'N' * (i % 7)}\n" for i in range(5000))
    (tmp_path / "many.fa").write_text(many)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        df = sources.read_fasta_text(spark, str(tmp_path / "many.fa"))
        assert df.rdd.getNumPartitions() > 5
        assert rows(df) == [(k, *r) for k, r in enumerate(fasta(many))]
    finally:
        spark.conf.set(key, old)
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="begins with"):
        sources.read_fasta_text(spark, str(tmp_path / "bad.fa")).count()


def test_files_read_in_ranges(spark, tmp_path):
    """Any cut gives the same records, also where quality lines begin with @ or +."""
    records = [(f"r{i}", f"d{i}" if i % 3 else None, "ACGT" * (i % 5) + "N" * (i % 2), ("@+I!"[i % 4] + "@+" * 10)[: 4 * (i % 5) + i % 2]) for i in range(60)]
    fq = "".join(f"@{i}{' ' + d if d else ''}\n{s}\n+{i if len(s) % 2 else ''}\n{q}\n" for i, d, s, q in records)
    fa = "".join(f">{i}{' ' + d if d else ''}\n{s[:3]}\n\n{s[3:]}\n" for i, d, s, q in records)
    for name, text, want in (("x.fq", fq, records), ("y.fq", fq.replace("\n", "\r\n"), records), ("x.fa", "\n" + fa, [(*r[:3], None) for r in records])):
        path = tmp_path / name
        path.write_bytes(text.encode())
        size = len(text.encode())
        for step in (1, 7, 50, 333, size, 10 * size) if name == "x.fq" else (50,):
            got = [x for at in range(0, size, step) for x in parsing.parse_range(str(path), "fastq" if "fq" in name else "fasta", at, min(size, at + step))]
            assert [r for _, r in got] == want, (name, step)
            assert [a for a, _ in got] == sorted({a for a, _ in got})
        df = sources.read_fastx(spark, str(path), split_bytes=100)
        assert df.rdd.getNumPartitions() > 5
        assert [r[1:] for r in rows(df)] == want
        assert [r[0] for r in rows(renumber(df))] == list(range(60))
    (tmp_path / "w.fq").write_text("@a\nAC\nGT\n+\nII\nII\n")
    with pytest.raises(Exception, match="four lines"):
        sources.read_fastx(spark, str(tmp_path / "w.fq"), split_bytes=1000).count()


@pytest.mark.parametrize("codec", ["none", "gz", "xz"])
@pytest.mark.parametrize("format", ["fasta", "fastq"])
def test_written_folders_read_back(spark, tmp_path, codec, format):
    data = [("f", i, f"r{i}", f"d {i}" if i % 2 else None, "ACGT" * (i % 9), "IIII" * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(data, RECORD).repartition(7)
    out = str(tmp_path / "out")
    for _ in range(2):
        sources.write_fastx(df, out, format, codec)
    back = sources.read_fastx(spark, out, format).orderBy("file", "ord").collect()
    assert [(r.id, r.desc, r.seq, r.qual) for r in back] == [(*x[2:5], x[5] if format == "fastq" else None) for x in data]


def test_missing_qualities_cant_be_fastq(spark, tmp_path):
    df = spark.createDataFrame([("f", 0, "r", None, "A", None)], RECORD)
    with pytest.raises(Exception, match="no qualities"):
        sources.write_fastx(df, str(tmp_path / "o"), "fastq")


def test_latin_1_bytes_survive(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">r1\nA\xe9\xffT\n")
    df = sources.read_fastx(spark, str(tmp_path / "a.fa"))
    assert df.select(F.length("seq")).first()[0] == 4
    sources.write_single(df, str(tmp_path / "b.fa"), "fasta")
    assert (tmp_path / "b.fa").read_bytes() == (tmp_path / "a.fa").read_bytes()


def test_stream_of_files(spark, files, tmp_path):
    from strandlake import streaming

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.fq").write_text(A_FQ)
    s = streaming.read_stream(spark, str(inbox), "fastq")
    q = streaming.distinct_stream(s, "seq").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (inbox / "2.fq").write_text(B_FQ + "@again\nACGT\n+\nIIII\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("seen").collect()) == ["r1", "r1/2", "r2", "r2/2", "r3", "r3/2"]


def test_pattern_and_mapping_files(tmp_path):
    (tmp_path / "p").write_text("  r2  \n\n r3\n")
    assert sources.load_patterns(path=str(tmp_path / "p")) == ["r2", "r3"] and sources.load_patterns(" x ", str(tmp_path / "p")) == ["x"]
    (tmp_path / "e").write_text("\n")
    for bad in ((None, None), ("  ", None), (None, str(tmp_path / "e"))):
        with pytest.raises(ValueError):
            sources.load_patterns(*bad)
    (tmp_path / "m").write_text("a\tb\n\nc\td  \na\tz\n")
    assert sources.load_mapping(str(tmp_path / "m")) == {"a": "z", "c": "d"}
    for bad in ("a\n", "a\tb\tc\n", "\tb\n"):
        (tmp_path / "x").write_text(bad)
        with pytest.raises(ValueError, match="line 1"):
            sources.load_mapping(str(tmp_path / "x"))


def test_replacements():
    cases = {"$1x": "", "${1}x": "$1x", "$1": "$1", "$$1": "\\$1", "a$2b": "a", "$9": "", "${no}": "${no}", "\\": "\\\\", "$1-$2": "$1-$2", "${1}2": "$1\\2"}
    for template, want in cases.items():
        assert jvm_replacement(template, r"(?<no>a)(b)") == want, template


# The command line


@pytest.fixture
def run(spark, files, capfd):
    def go(*args, ok=True):
        code = cli.main([str(files / a) if isinstance(a, str) and (files / a).exists() and a != "" else str(a) for a in args])
        out, err = capfd.readouterr()
        assert (code == 0) == ok, err
        return out if ok else err

    return go


def test_cli_records(run, files, tmp_path):
    assert run("fq2fa", "a.fq") == A_FA
    assert run("seq", "a.fq") == A_FQ
    assert run("seq", "a.fq", "-q", "40", "-i") == "r1\nr3\n"
    (tmp_path / "h.fa").write_text(">r1   desc\tmore\nACGT\n")
    assert run("seq", tmp_path / "h.fa") == ">r1   desc\tmore\nACGT\n"
    (tmp_path / "n.fa").write_text(">r1 alpha desc\nACGT\n>r2\nTGCA\n")
    assert run("seq", tmp_path / "n.fa", "--name") == "r1\nr2\n" and run("seq", tmp_path / "n.fa", "--name", "--full-name") == "r1 alpha desc\nr2\n"
    assert run("seq", "a.fa", "-R", "-s") == "ACGT\nNNCC\nTTAA\n"
    assert "\x1b[32mA\x1b[0m" in run("seq", "a.fa", "--color")
    for name in ("o.fq.gz", "o.fq.xz"):
        run("seq", "a.fq", "-o", tmp_path / name)
        assert run("seq", tmp_path / name) == A_FQ
    assert "FASTQ" in run("fq2fa", "a.fa", ok=False) and "FASTQ" in run("seq", "a.fa", "-q", "1", ok=False)
    assert "error" in run("seq", "a.sam", ok=False)


def test_cli_search_and_order(run, files, tmp_path):
    assert run("grep", "a.fa", "-p", "GG", "-b", "seq") == ">r2\nGGNN\n"
    assert run("grep", "a.fa", "-p", "N", "-b", "seq", "-c") == "1\n" and run("grep", "a.fa", "-p", "r", "-x", "-n") == "r1\nr2\nr3\n"
    assert run("locate", "a.fa", "-p", "A", "-a") == "r1\t1\t1\tA\nr3\t3\t3\tA\nr3\t4\t4\tA\n"
    assert run("locate", "a.fa", "-p", "A", "--bed") == "r1\t0\t1\tA\nr3\t2\t3\tA\n"
    (tmp_path / "u.fa").write_text(">r3\nA\n>r1\nC\n>r2\nG\n")
    assert run("sort", tmp_path / "u.fa", "--mem", "1") == ">r1\nC\n>r2\nG\n>r3\nA\n"
    assert run("head", "a.fa", "-n", "1") == ">r1\nACGT\n" and run("tail", "a.fa", "-p", "0.34") == ">r2\nGGNN\n>r3\nTTAA\n"
    (tmp_path / "d.fa").write_text(">r1\nACGT\n>r2\nGGNN\n>r1\nTTAA\n")
    assert run("rmdup", tmp_path / "d.fa", "-b", "id", "--keep-first") == ">r1\nACGT\n>r2\nGGNN\n"
    assert run("rename", "a.fa", "--match-regex", r"^r(\d+)$", "--replace", "seq_$1") == A_FA.replace("r", "seq_")
    assert len(run("sample", "a.fa", "-n", "2").splitlines()) == 4
    assert len(run("spike", "a.fa", "-a", "a.fa").splitlines()) == 12
    assert sorted(run("shuffle", "a.fa").splitlines()) == sorted(A_FA.splitlines())
    assert "proportion" in run("head", "a.fa", ok=False) and "not both" in run("rmdup", "a.fa", "-f", "-l", ok=False)


def test_cli_pairs(run, files, tmp_path):
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    both = ("-1", "a.fq", "-2", "b.fq", "-o", one, "-O", two)
    run("grep", "-p", "r2", *both)
    assert (one.read_text(), two.read_text()) == ("@r2\nGGNN\n+\nHHHH\n", "@r2/2\nCCNN\n+\nHHHH\n")
    run("head", "-n", "2", *both)
    assert one.read_text().count("@r") == two.read_text().count("@r") == 2
    run("rename", "-p", "pair_", "-k", *both)
    assert one.read_text().startswith("@pair_000001/1\n") and two.read_text().startswith("@pair_000001/2\n")
    for command in (("sample", "-n", "2"), ("shuffle",), ("rmdup",), ("tail", "-n", "1"), ("spike", "-a", "a.fq", "-A", "b.fq")):
        run(*command, *both)
        assert [x.split("/")[0] for x in two.read_text().splitlines()[::4]] == one.read_text().splitlines()[::4]
    bad = tmp_path / "bad.fq"
    bad.write_text(B_FQ.replace("r1/2", "x1/2"))
    assert "x1/2" in run("shuffle", "-1", "a.fq", "-2", bad, "-o", one, "-O", two, ok=False)
    run("shuffle", "-1", "a.fq", "-2", bad, "-o", one, "-O", two, "--allow-unpaired")
    assert len(one.read_text().splitlines()) == 8
    assert "both mates" in run("sample", "-n", "1", "-1", "a.fq", ok=False) and "not both" in run("sample", "a.fq", "-n", "1", "-1", "a.fq", "-2", "b.fq", ok=False)


def test_cli_stats(run, files):
    head, row = run("stats", "a.fq", "-T").splitlines()
    assert head.split("\t") == ["file", "format", "type", "records", "total_bases", "min_len", "max_len", "mean_len", "gc_pct", "n50"]
    assert row.split("\t")[1:] == ["fastq", "DNA", "3", "12", "4", "4", "4.000", "33.333", "4"]
    assert run("stats", "a.sam.gz", "-T").splitlines()[1].split("\t")[1:9] == ["sam", "DNA", "2", "10", "4", "6", "5.000", "60.000"]
    assert run("stats", "a.bam", "-T").splitlines()[1].split("\t")[1] == "bam"
    only = run("stats", "a.fq", "-T", "-a").splitlines()
    assert "n50" not in only[0].split("\t") and "100.00%" in only[1]
    mixed = run("stats", "a.fq", "a.fa", "-T", "-a").splitlines()
    assert {"n50", "q20_pct"} <= set(mixed[0].split("\t")) and "NA" in mixed[1] and "NA" in mixed[2]
    table = run("stats", "a.fq", "a.fa")
    assert table.splitlines()[-1].startswith("TOTAL") and "33.33%" in table and "TOTAL" not in run("stats", "a.fq", "a.fa", "-p")
    assert '"q30_pct": 100.0' in run("stats", "a.fq", "-j") and '"seq_type": "NA"' in run("stats", "empty.fa", "-j")
    assert "4 and quality of 3" in run("stats", _bad(files), ok=False)


def _bad(files):
    (files / "bad.fq").write_text("@r1\nACGT\n+\n!!!\n")
    return "bad.fq"


def test_cli_reads_standard_input(files):
    got = subprocess.run([sys.executable, "-m", "strandlake.cli", "seq", "-t", "2"], input=b"@r1 desc\nAC\nGT\n+\nII\nII\n", capture_output=True, timeout=120, cwd=cli.__file__.rsplit("/", 2)[0])
    assert got.stdout == b"@r1 desc\nACGT\n+\nIIII\n", got.stderr[-500:]


def test_fastq_by_the_text_reader(spark, tmp_path):
    """Records of four lines, over several splits and files, with CR, empty sequences and qualities that begin with @."""
    want = []
    for name in ("a.fq", "b.fq.gz"):
        body = ""
        for i in range(400):
            seq, qual = "ACGT" * (i % 5), "@+II" * (i % 5)
            end = "\r\n" if i % 7 == 0 else "\n"
            body += f"@r{i} some{i}{end}{seq}{end}+{end}{qual}{end}"
            want.append((name, i, f"r{i}", f"some{i}", seq, qual))
        data = (body + "\n").encode()
        (tmp_path / name).write_bytes(__import__("gzip").compress(data) if name.endswith("gz") else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sources.read_fastq_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file.rsplit("/")[-1], r.ord, r.id, r.desc, r.seq, r.qual) for r in got) == sorted(want)
    (tmp_path / "a.fq").write_text("@x\nACG\n+\nII\n")
    with pytest.raises(Exception, match="four lines"):
        sources.read_fastq_text(spark, str(tmp_path / "a.fq")).collect()


def test_bam_round_trip(spark, tmp_path):
    rows = [("d", i, f"q{i}", None, "ACGTN"[: i % 6] * 50_000, None if i % 4 == 0 else "I" * (min(i % 6, 5) * 50_000)) for i in range(12)]
    sources.write_bam(spark.createDataFrame(rows, RECORD).coalesce(1), str(tmp_path / "out"))
    got = {r.id: (r.seq, r.qual) for r in sources.read_fastx(spark, str(tmp_path / "out"), alignments=True).collect()}
    assert got == {r[2]: (r[4], r[5] if r[4] else None) for r in rows}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="shared folder"):
        sources.scratch(Session(), "x")
