"""Operators on the small fixtures: every case that the model's rules name."""

import pytest
from pyspark.sql import functions as F

from strandlake import functions as X
from strandlake.model import FIELDS, RECORD, renumber, with_position
from strandlake.operators import duplicates, order, pairs, records, rename, sampling, search, stats


def frame(spark, rows, file="f"):
    """rows of (id, desc, seq, qual)."""
    return spark.createDataFrame([(file, i, *r) for i, r in enumerate(rows)], RECORD).repartition(3)


FA = [("r1", None, "ACGT", None), ("r2", None, "GGNN", None), ("r3", None, "TTAA", None)]
FQ = [("r1", None, "ACGT", "IIII"), ("r2", None, "GGNN", "HHHH"), ("r3", None, "TTAA", "JJJJ")]
MATES = [("r1/2", None, "TGCA", "IIII"), ("r2/2", None, "CCNN", "HHHH"), ("r3/2", None, "AATT", "JJJJ")]


@pytest.fixture(scope="module")
def fa(spark):
    return frame(spark, FA)


@pytest.fixture(scope="module")
def fq(spark):
    return frame(spark, FQ)


@pytest.fixture(scope="module")
def mates(spark):
    return frame(spark, MATES)


@pytest.fixture(scope="module")
def paired(fq, mates):
    return pairs.pair_up(fq, mates)


def ids(df, name="id"):
    return [r[name] for r in df.orderBy("ord").collect()]


def values(df, name):
    return [r[name] for r in df.orderBy("ord").collect()]


# stats


def test_stats_of_fasta(fa):
    r = stats.stats(fa).first()
    assert (r.file, r.format, r.seq_type, r.records, r.total_bases, r.min_len, r.max_len) == ("f", "fasta", "DNA", 3, 12, 4, 4)
    assert (r.mean_len, round(r.gc_pct, 3), round(r.n_pct, 3)) == (4.0, 33.333, 16.667)
    assert (r.n50, r.l50, r.q1_len, r.median_len, r.q3_len) == (4, 2, 4, 4, 4)
    assert (r.q10_pct, r.q20_pct, r.q30_pct) == (None, None, None)


def test_stats_of_qualities(spark, fq):
    r = stats.stats(fq).first()
    assert (r.format, r.q10_pct, r.q20_pct, r.q30_pct) == ("fastq", 100.0, 100.0, 100.0)
    low = stats.stats(frame(spark, [("a", None, "ACGTA", "!*+5?")])).first()
    assert (low.q10_pct, low.q20_pct, low.q30_pct) == (60.0, 40.0, 20.0)
    assert stats.stats(fq, quality=False).first().q20_pct is None


@pytest.mark.parametrize("seq, kind", [("ACGTNN", "DNA"), ("ACGUNN", "RNA"), ("MKWVTFISLLLLFSSAYS", "protein"), ("--..", "NA"), ("", "NA"), ("ACGU" * 5 + "T", "DNA"), ("A" * 95 + "RYKMS", "DNA"), ("A" * 94 + "RYKMSW", "protein")])
def test_sequence_types(spark, seq, kind):
    assert stats.stats(frame(spark, [("x", None, seq, None)])).first().seq_type == kind


def brute_n50(lengths):
    total, run = sum(lengths), 0
    for i, n in enumerate(sorted(lengths, reverse=True), 1):
        run += n
        if n and run >= total / 2:
            return n, i
    return 0, 0


@pytest.mark.parametrize("lengths", [[5], [0], [0, 0, 3], [1, 2, 3, 4, 5, 6], [10, 10, 10, 1], [7, 7, 7, 7], [100, 1, 1, 1, 1], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]])
def test_n50_and_quartiles(spark, lengths):
    r = stats.stats(frame(spark, [(f"r{i}", None, "A" * n, None) for i, n in enumerate(lengths)])).first()
    assert (r.n50, r.l50) == brute_n50(lengths)
    s = sorted(lengths)
    want = [s[int(p * (len(s) - 1) + 0.5)] for p in (0.25, 0.5, 0.75)]
    assert [r.q1_len, r.median_len, r.q3_len] == want


def test_total_row_takes_maxima(spark):
    a = frame(spark, [("a", None, "ACGTACGT", "I" * 8), ("b", None, "AC", "!!")], "one")
    b = frame(spark, [("c", None, "GGGG", None)], "two")
    rows = stats.stats(a.unionByName(b))
    t = stats.stats_total(rows).first()
    assert (t.file, t.format, t.seq_type, t.records, t.total_bases, t.min_len, t.max_len) == ("TOTAL", "mixed", "mixed", 3, 14, 2, 8)
    assert (t.n50, t.l50, t.q1_len) == (8, 1, 4) and t.mean_len == 14 / 3 and round(t.gc_pct, 6) == round(100 * 9 / 14, 6)
    assert t.q30_pct == 80.0  # of the file that has qualities
    full = stats.with_empty_files(rows, [("one", "fastq"), ("none", "fasta")])
    zero = full.where("file = 'none'").first()
    assert (zero.seq_type, zero.records, zero.min_len, zero.mean_len, zero.q10_pct) == ("NA", 0, 0, 0.0, None)
    assert stats.stats_total(full).first().min_len == 0


# seq


def test_filters(fq, spark):
    assert ids(records.seq(fq, min_qual=40)) == ["r1", "r3"]
    assert ids(records.seq(fq, max_qual=39)) == ["r2"]
    assert ids(records.seq(fq, min_qual=-1)) == ["r1", "r2", "r3"]
    df = frame(spark, [("a", None, "A", "I"), ("b", None, "AA--", "IIII"), ("c", None, "", "")])
    assert ids(records.seq(df, min_len=1, max_len=4)) == ["a", "b"]
    assert ids(records.seq(df, max_len=2, gaps=True)) == ["a", "c"]  # the length is that before gaps go
    assert ids(records.seq(df, max_qual=0)) == ["c"]  # an empty quality has a mean of 0
    with pytest.raises(Exception, match="FASTQ"):
        records.seq(frame(spark, FA), min_qual=1).collect()


def test_transformations(spark, fa):
    assert values(records.seq(fa, revcomp=True), "seq") == ["ACGT", "NNCC", "TTAA"]
    df = frame(spark, [("a", None, "acgun-RY", "12345678")])
    r = records.seq(df, revcomp=True).first()
    assert (r.seq, r.qual) == ("YR-NACGT", "87654321")
    assert records.seq(df, rev=True, comp=True).first().seq == r.seq
    assert records.seq(df, comp=True).first().seq == "TGCAN-RY" and records.seq(df, comp=True).first().qual == "12345678"
    assert records.seq(df, upper=True).first().seq == "ACGUN-RY"
    assert records.seq(df, upper=True, lower=True).first().seq == "acgun-ry"
    gapped = frame(spark, [("r1", None, "AC-G T.\t", "IIIIIIII")])
    assert records.seq(gapped, gaps=True).first().seq == "ACGT" and len(records.seq(gapped, gaps=True).first().qual) == 8
    assert records.seq(gapped, gaps=True, gap_letters="AG").first().seq == "C- T.\t"


def test_upper_leaves_other_letters(spark):
    df = frame(spark, [("a", None, "aÿéz", None)])
    assert records.seq(df, upper=True).first().seq == "AÿéZ"


def test_validation_ends_the_job(spark, fa):
    assert records.seq(fa, validate=True).count() == 3
    bad = frame(spark, [("ok", None, "ACGT", None), ("bad", None, "AC-T", None)])
    with pytest.raises(Exception, match="record bad: -"):
        records.seq(bad, validate=True).count()  # though no column is needed
    assert records.seq(bad, gaps=True, validate=True).count() == 2
    assert [(r.id, r.letter) for r in records.invalid_records(bad).collect()] == [("bad", "-")]


def test_names_and_fq2fa(spark, fq):
    df = frame(spark, [("r1", "alpha desc", "ACGT", None), ("r2", None, "TGCA", None)])
    assert values(records.names(df), "name") == ["r1", "r2"]
    assert values(records.names(df, full=True), "name") == ["r1 alpha desc", "r2"]
    assert values(records.fq2fa(fq), "qual") == [None] * 3
    with pytest.raises(Exception, match="FASTQ"):
        records.fq2fa(df).count()


def test_colour(spark):
    got = frame(spark, [("a", None, "AcGTuN-", None), ("b", None, "", None)]).select("ord", X.coloured(F.col("seq")).alias("c"))
    codes = (32, 34, 33, 31, 31, 37, 37)
    assert values(got, "c") == ["".join(f"\x1b[{k}m{c}\x1b[0m" for k, c in zip(codes, "AcGTuN-", strict=True)), ""]


# grep, locate


def test_grep(spark, fa, fq):
    assert ids(search.grep(fa, "GG", by="seq")) == ["r2"]
    assert ids(search.grep(fa, "r", by="id")) == []
    assert ids(search.grep(fa, "r", by="name")) == ["r1", "r2", "r3"]
    assert ids(search.grep(fq, "HH", by="qual")) == ["r2"]
    assert ids(search.grep(fa, "HH", by="qual", invert=True)) == ["r1", "r2", "r3"]  # no qualities: no match
    assert ids(search.grep(fa, "^r[13]$", regex=True)) == ["r1", "r3"]
    assert ids(search.grep(fa, ["R1", "R3"], ignore_case=True)) == ["r1", "r3"]
    assert ids(search.grep(fa, ["r1", "gone"], invert=True)) == ["r2", "r3"]
    assert ids(search.grep(fa, "ta{2}", by="seq", regex=True, ignore_case=True)) == ["r3"]
    many = [f"x{i}" for i in range(500)] + ["r2"]
    assert ids(search.grep(fa, many)) == ["r2"] and ids(search.grep(fa, many, invert=True)) == ["r1", "r3"]
    table = spark.createDataFrame([("r2",), ("R3",)], "pattern string")
    assert ids(search.grep(fa, table)) == ["r2"] and ids(search.grep(fa, table, ignore_case=True)) == ["r2", "r3"]
    for bad in ([], [""], ""):
        with pytest.raises(ValueError):
            search.grep(fa, bad)


def test_grep_exact_ids(spark):
    df = frame(spark, [("SRR.1228619", None, "A", None), ("SRR.12286190", None, "C", None), ("x1", "SRR.1228619", "G", None)])
    assert ids(search.grep(df, "SRR.1228619")) == ["SRR.1228619"]


def test_patterns_of_the_dialect(spark):
    df = frame(spark, [("é١", None, "A", None), ("x1", None, "C", None)])
    assert ids(search.grep(df, r"^\w\d$", regex=True)) == ["é١", "x1"]
    for p in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(ValueError):
            search.grep(df, p, regex=True)


def test_locate(fa, spark):
    rows = lambda df: sorted((r.id, r.start, r.end, r.match) for r in df.collect())
    assert rows(search.locate(fa, "A", all=True)) == [("r1", 1, 1, "A"), ("r3", 3, 3, "A"), ("r3", 4, 4, "A")]
    assert rows(search.locate(fa, "A", all=True, bed=True)) == [("r1", 0, 1, "A"), ("r3", 2, 3, "A"), ("r3", 3, 4, "A")]
    assert rows(search.locate(fa, "A")) == [("r1", 1, 1, "A"), ("r3", 3, 3, "A")]
    df = frame(spark, [("x", None, "AAAaCa", None), ("short", None, "A", None)])
    assert rows(search.locate(df, "AA", all=True)) == [("x", 1, 2, "AA"), ("x", 2, 3, "AA")]
    assert rows(search.locate(df, "aa", all=True, ignore_case=True)) == [("x", 1, 2, "AA"), ("x", 2, 3, "AA"), ("x", 3, 4, "Aa")]
    assert rows(search.locate(df, "A+", all=True, regex=True)) == [("short", 1, 1, "A"), ("x", 1, 3, "AAA")]
    assert [r[1:3] for r in rows(search.locate(frame(spark, [("e", None, "BAAC", None)]), "A*", all=True, regex=True, bed=True))] == [(0, 0), (1, 3), (4, 4)]
    two = search.locate(df, ["AA", "C"], all=False)
    assert sorted((r.pattern_index, r.start) for r in two.collect()) == [(0, 1), (1, 5)]


# rmdup


def test_rmdup(spark):
    df = frame(spark, [("r1", "d1", "ACGT", "IIII"), ("r2", None, "GGNN", "HHHH"), ("r1", "d2", "TTAA", "JJJJ"), ("r1", "d3", "ACGT", "IIII")])
    got = lambda **k: [(r.ord, r.id) for r in duplicates.rmdup(df, **k).orderBy("ord").collect()]
    assert got(by="id") == [(0, "r1"), (1, "r2")]
    assert got(by="id", keep="last") == [(1, "r2"), (3, "r1")]
    assert got() == [(0, "r1"), (1, "r2"), (2, "r1")]  # descriptions don't count
    assert got(by="seq", count_dup=True, mark_dup=True) == [(0, "r1;count=2;dup=1"), (1, "r2;count=1"), (2, "r1;count=1")]
    assert got(by="seq", mark_dup=True) == [(0, "r1;dup=1"), (1, "r2"), (2, "r1")]
    assert duplicates.rmdup(df, by="id").orderBy("ord").first().desc == "d1"
    none = frame(spark, [("a", None, "A", None), ("a", None, "A", None)])
    assert duplicates.rmdup(none).count() == 1
    assert [(r.ord, r.n) for r in duplicates.duplicate_counts(df, "id").collect()] == [(0, 3)]
    with pytest.raises(ValueError):
        duplicates.rmdup(df, keep="both")


# rename


def test_rename(fa, spark):
    assert ids(rename.rename(fa)) == ["seq000001", "seq000002", "seq000003"]
    assert ids(rename.rename(fa, prefix="r", width=1, start=9)) == ["r9", "r10", "r11"]
    assert ids(rename.rename(fa, template="{prefix}:{n}:{n}", width=2)) == ["seq:01:01", "seq:02:02", "seq:03:03"]
    assert ids(rename.rename(search.grep(fa, "r1", invert=True))) == ["seq000001", "seq000002"]
    assert ids(rename.rename(fa, mapping={"r1": "alpha", "r3": "gamma", "r": "no"})) == ["alpha", "r2", "gamma"]
    assert ids(rename.rename(fa, match_regex=r"^r(\d+)$", replace="seq_$1")) == ["seq_1", "seq_2", "seq_3"]
    assert ids(rename.rename(fa, match_regex=r"r(?<no>\d)", replace="${no}0$$$1x|${1}0")) == ["10$|10", "20$|20", "30$|30"]
    kept = frame(spark, [("a", "its description", "A", None)])
    assert rename.rename(kept).first().desc == "its description"
    twice = spark.createDataFrame([("r1", "one", 1), ("r1", "two", 2)], "old_id string, new_id string, line_no int")
    assert ids(rename.rename(fa, mapping=twice)) == ["two", "r2", "r3"]


@pytest.mark.parametrize("bad", [{"mapping": {"a": "b"}, "match_regex": "a", "replace": "b"}, {"mode": "map"}, {"mode": "regex", "match_regex": "a"}, {"mode": "generate", "mapping": {"a": "b"}}, {"mode": "map", "mapping": {"a": "b"}, "prefix": "x"}, {"mode": "regex", "match_regex": "a", "replace": "b", "width": 3}, {"mode": "other"}])
def test_rename_arguments_that_dont_go_together(fa, bad):
    with pytest.raises(ValueError):
        rename.rename(fa, **bad)


def test_rename_pairs(paired):
    df = rename.rename(paired, prefix="pair_", keep_pair_suffix=True)
    assert ids(df, "id1") == [f"pair_{i:06d}/1" for i in (1, 2, 3)] and ids(df, "id2") == [f"pair_{i:06d}/2" for i in (1, 2, 3)]
    df = rename.rename(paired, match_regex="r", replace="x")
    assert ids(df, "id1") == ids(df, "id2") == ["x1", "x2", "x3"]


# sort, head, tail


def test_sort(spark):
    df = frame(spark, [("r3", "b", "AA", None), ("r1", None, "A", None), ("r2", "a", "C", None), ("R9", None, "AAA", None)])
    assert ids(order.sort(df)) == ["R9", "r1", "r2", "r3"]
    assert ids(order.sort(df, reverse=True)) == ["r3", "r2", "r1", "R9"]
    assert ids(order.sort(df, by="len")) == ["r1", "r2", "r3", "R9"]
    assert ids(order.sort(df, by="seq", reverse=True)) == ["r2", "R9", "r3", "r1"]
    assert values(order.sort(df), "ord") == [0, 1, 2, 3]
    n = frame(spark, [(x, None, "A", None) for x in ("10", "9", "x", "007", "+8", "5.5", " 5", str((1 << 128) - 1), str(1 << 128), "0")])
    assert ids(order.sort(n, numeric=True)) == ["0", "007", "+8", "9", "10", str((1 << 128) - 1), " 5", str(1 << 128), "5.5", "x"]


def test_head_and_tail(fa):
    assert ids(order.head(fa, 2)) == ["r1", "r2"] and ids(order.head(fa, 0)) == [] and ids(order.head(fa, 9)) == ["r1", "r2", "r3"]
    assert ids(order.tail(fa, 2)) == ["r2", "r3"]
    assert ids(order.tail(fa, proportion=0.34)) == ["r2", "r3"]
    assert ids(order.tail(fa, proportion=0.5)) == ["r2", "r3"] and ids(order.head(fa, proportion=0.0)) == []
    for bad in ({}, {"num": 1, "proportion": 0.5}, {"num": -1}, {"proportion": 1.5}):
        with pytest.raises(ValueError):
            order.head(fa, **bad)
        with pytest.raises(ValueError):
            order.tail(fa, **bad)


def test_large_limits_by_position(fa, spark, monkeypatch):
    monkeypatch.setattr(order, "MOST_TOP_K", 1)
    monkeypatch.setattr(sampling, "MOST_TOP_K", 1)
    df = frame(spark, [(f"r{i}", None, "A", None) for i in range(50)]).where("ord % 3 <> 1")
    want = [f"r{i}" for i in range(50) if i % 3 != 1]
    assert ids(order.head(df, 20)) == want[:20] and ids(order.tail(df, 20)) == want[-20:]
    assert ids(order.tail(df, proportion=0.5)) == want[-17:]
    assert ids(sampling.sample(df, 7)) == sorted(ids(sampling.sample(df, 7)), key=want.index) and sampling.sample(df, 7).count() == 7


def test_positions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "id").repartition(5)
    got = with_position(df, "k", into="place", partitions=6).orderBy("k").collect()
    assert [r.place for r in got] == list(range(1000))
    sparse = renumber(df.withColumn("ord", F.col("k")).where("k % 3 = 0"))
    assert sorted(r.ord for r in sparse.collect()) == list(range(334))
    assert with_position(df.where("false"), "k").count() == 0


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_order_holds_with_other_columns(spark, parts):
    """Places are dense and right over many ranges, with ties, nulls and columns that are no keys."""
    df = spark.range(20_000).selectExpr("id as ord", "concat('r', pmod(id * 7919, 3000)) as id", "'f' as file", "cast(null as string) as desc", "repeat('ACGT', cast(pmod(id, 9) as int)) as seq", "if(id % 3 = 0, null, repeat('I', 5)) as qual").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = sorted(df.collect(), key=lambda r: r.ord)
        by_id = [r.ord for r in sorted(rows, key=lambda r: (r.id, r.ord))]
        by_length = [r.ord for r in sorted(rows, key=lambda r: (-len(r.seq), r.ord))]
        for found, want in ((order.sort(df.withColumn("was", F.col("ord"))), by_id), (order.sort(df.withColumn("was", F.col("ord")), by="len", reverse=True), by_length)):
            got = sorted(found.collect(), key=lambda r: r.ord)
            assert [r.ord for r in got] == list(range(20_000)) and [r.was for r in got] == want
            assert all((r.id, r.seq, r.qual) == (rows[r.was].id, rows[r.was].seq, rows[r.was].qual) for r in got)
        moved = sampling.shuffle(df.withColumn("was", F.col("ord"))).collect()
        assert sorted(r.ord for r in moved) == sorted(r.was for r in moved) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_range_of_keys_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i % 7}", i % 2 == 0) for i in range(500)], "i long, k string, b boolean").repartition(4)
    rows = [(r.b, r.k is not None, r.k or "", r.i) for r in df.collect()]
    for down in (False, True):
        got = with_position(df, "b", "k", "i", into="place", partitions=13, descending=down).collect()
        assert [r.i for r in sorted(got, key=lambda r: r.place)] == [x[3] for x in sorted(rows, reverse=down)]


def test_dialect_of_patterns(spark):
    for bad in (r"\Qa.b\E", r"a\Gb", r"x\Z", "(?>a)b", "[a-z--m]", "[a~~b]", "[[:^alpha:]]", "[[:nope:]]", r"\R", r"\h"):
        with pytest.raises(ValueError):
            X.checked_pattern(bad)
    assert X.checked_pattern(r"[[:digit:]_-]\\Q") == r"[0-9_-]\\Q" and X.checked_pattern("a--b[-x]") == "a--b[-x]"
    df = frame(spark, [("a1", None, "A", None), ("é2", None, "C", None), ("_", None, "G", None)])
    assert ids(search.grep(df, "^[[:alpha:]]", regex=True)) == ["a1"] and ids(search.grep(df, r"^\w[[:digit:]]$", regex=True)) == ["a1", "é2"]


def test_many_patterns(spark):
    """Beyond MOST_INLINE patterns the plan stays small and the result the same."""
    df = frame(spark, [(f"r{i}", f"d{i}", "ACGT" * (i % 4) + "GATTACA" * (i % 2), None) for i in range(40)])
    two = spark.createDataFrame([(i, f"r{i}", None, "A", "I", f"r{i + 3}", None, "C", "I") for i in range(40)], "ord long, id1 string, desc1 string, seq1 string, qual1 string, id2 string, desc2 string, seq2 string, qual2 string")
    many = [f"x{i}" for i in range(300)]
    assert ids(search.grep(df, [*many, "TTACA"], by="seq")) == ids(search.grep(df, "TTACA", by="seq"))
    assert ids(search.grep(df, [*many, "T{2}A"], by="seq", regex=True)) == ids(search.grep(df, "TTA", by="seq"))
    assert ids(search.grep(df, [*many, "ttaca"], by="seq", ignore_case=True, invert=True)) == ids(search.grep(df, "TTACA", by="seq", invert=True))
    few = ["r1", "R4", "r7"]
    for options in ({}, {"pair_mode": "both"}, {"invert": True}, {"ignore_case": True}):
        assert ids(search.grep_pairs(two, [*many, *few], **options), "id1") == ids(search.grep_pairs(two, few, **options), "id1"), options


# sample, shuffle, spike


def test_spike_between_rows_with_gaps(spark):
    """Slots are places among the target's rows, not its ordinals."""
    target = spark.range(6).selectExpr("id * 1000 as ord", "concat('t', id) as id")
    add = spark.range(40).selectExpr("id as ord", "concat('a', id) as id")
    got = [r.id for r in sampling.spike(target, add, seed=1).orderBy("ord").collect()]
    dense = [r.id for r in sampling.spike(target.withColumn("ord", (F.col("ord") / 1000).cast("long")), add, seed=1).orderBy("ord").collect()]
    assert got == dense and sorted(got) == sorted([f"t{i}" for i in range(6)] + [f"a{i}" for i in range(40)])
    assert len({got.index(f"t{i}") - i for i in range(6)}) > 3


@pytest.fixture(scope="module")
def twelve(spark):
    one = frame(spark, [(f"r{i}/1", None, "ACGT", "IIII") for i in range(12)])
    two = frame(spark, [(f"r{i}/2", None, "TTTT", "JJJJ") for i in range(12)])
    return one, two, pairs.pair_up(one, two)


def test_sample_and_shuffle_agree_for_pairs(twelve):
    one, _, both = twelve
    assert ids(sampling.sample(one, 5, seed=17)) == ids(sampling.sample(both, 5, seed=17), "id1")
    assert ids(sampling.sample(one, rate=0.5, seed=17)) == ids(sampling.sample(both, rate=0.5, seed=17), "id1")
    shuffled = ids(sampling.shuffle(one, seed=17))
    assert shuffled == ids(sampling.shuffle(both, seed=17), "id1") and sorted(shuffled) == sorted(ids(one)) and shuffled != ids(one)
    assert shuffled != ids(sampling.shuffle(one, seed=18))
    assert ids(sampling.shuffle(one.repartition(1), seed=17)) == shuffled


def test_sample_sizes(twelve):
    one = twelve[0]
    assert [sampling.sample(one, n).count() for n in (0, 3, 12, 99)] == [0, 3, 12, 12]
    assert ids(sampling.sample(one, 99)) == ids(one)
    assert sampling.sample(one, rate=0.0).count() == 0 and sampling.sample(one, rate=1.0).count() == 12
    assert ids(sampling.sample(one, 1, rate=1.0)) == ids(one)  # the rate counts
    for bad in ({}, {"rate": 1.1}, {"num": -1}):
        with pytest.raises(ValueError):
            sampling.sample(one, **bad)


def test_sample_is_fair(spark):
    df = frame(spark, [("r", None, "A", None)] * 4000)
    n = [sampling.sample(df, rate=0.25, seed=s).count() for s in range(3)]
    assert all(880 < x < 1120 for x in n) and len(set(n)) > 1


def test_spike(twelve, fa):
    one, _, both = twelve
    got = ids(sampling.spike(one, fa, seed=3))
    assert len(got) == 15 and [x for x in got if "/" in x] == ids(one) and sorted(x for x in got if "/" not in x) == ["r1", "r2", "r3"]
    assert values(sampling.spike(one, fa, seed=3), "ord") == list(range(15))
    add = both.where("ord < 3")
    assert ids(sampling.spike(both, add, seed=3), "id1") == ids(sampling.spike(one, one.where("ord < 3"), seed=3))
    slots = {ids(sampling.spike(one, fa, seed=s)).index("r1") for s in range(25)}
    assert len(slots) > 5
    assert ids(sampling.spike(one.where("false"), fa)) == ["r1", "r2", "r3"]


# pairs


def test_zip_and_validate(spark, fq, mates):
    assert ids(pairs.pair_up(fq, mates), "id2") == ["r1/2", "r2/2", "r3/2"]
    bad = frame(spark, [("x1/2", None, "A", "I"), *MATES[1:]])
    with pytest.raises(pairs.UnpairedError, match="x1/2"):
        pairs.pair_up(fq, bad)
    kept = pairs.pair_up(fq, bad, allow_unpaired=True)
    assert ids(kept, "id1") == ["r2", "r3"] and values(kept, "ord") == [0, 1]
    short = frame(spark, MATES[:2])
    report = {r.status: r.n for r in pairs.pair_report(pairs.zip_mates(fq, short)).collect()}
    assert report == {"valid": 2, "left": 1}
    with pytest.raises(pairs.UnpairedError):
        pairs.pair_up(short, fq)
    assert ids(pairs.mate(pairs.pair_up(fq, mates), 2)) == ["r1/2", "r2/2", "r3/2"]


def test_pair_keys(spark):
    rows = [("a/1", "a"), ("a/2", "a"), ("a/1/2", "a/1"), ("a/3", "a/3"), ("a", "a"), ("/1", "")]
    got = spark.createDataFrame(rows, "i string, k string").select("k", X.pair_key(F.col("i")).alias("g")).collect()
    assert all(r.k == r.g for r in got)


def test_grep_pairs(paired):
    assert ids(search.grep_pairs(paired, "r2"), "id2") == ["r2/2"]
    assert ids(search.grep_pairs(paired, "NN", by="seq", pair_mode="both"), "id1") == ["r2"]
    assert ids(search.grep_pairs(paired, "AA", by="seq"), "id1") == ["r3"]
    assert ids(search.grep_pairs(paired, "GG", by="seq", pair_mode="both", invert=True), "id1") == ["r1", "r2", "r3"]
    assert ids(search.grep_pairs(paired, "GG", by="seq", invert=True), "id1") == ["r1", "r3"]


def test_rmdup_and_limits_of_pairs(spark, fq):
    a = frame(spark, [("p/1", None, "A", "I"), ("p/1", None, "A", "I"), ("q/1", None, "A", "I")])
    b = frame(spark, [("p/2", None, "C", "I"), ("p/2", None, "C", "I"), ("q/2", None, "G", "I")])
    both = pairs.pair_up(a, b)
    marked = duplicates.rmdup(both, count_dup=True, mark_dup=True)
    assert [(r.id1, r.id2) for r in marked.orderBy("ord").collect()] == [("p/1;count=2;dup=1", "p/2"), ("q/1;count=1", "q/2")]
    assert duplicates.rmdup(both, by="seq").count() == 2
    assert ids(order.head(both, 1), "id2") == ["p/2"] and ids(order.tail(both, 1), "id2") == ["q/2"]


def test_head_of_pairs_stops_early(spark, fq):
    bad = pairs.zip_mates(fq, frame(spark, [*MATES[:2], ("zz/2", None, "A", "I")]))
    assert ids(order.head_zipped(bad, 2), "id1") == ["r1", "r2"]
    with pytest.raises(pairs.UnpairedError):
        order.head_zipped(bad, 3)
    assert order.head_zipped(bad, 0).count() == 0
    with pytest.raises(pairs.UnpairedError):
        order.head_zipped(bad, proportion=0.1)
    assert ids(order.head_zipped(bad, 5, allow_unpaired=True), "id1") == ["r1", "r2"]
    assert set(FIELDS) == {"id", "desc", "seq", "qual"}
