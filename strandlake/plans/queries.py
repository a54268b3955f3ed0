"""The registered queries: every operator over the driver's tables, with the SQL that has the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from .. import sources
from ..model import half_mates, letters, reads, turn_mates, with_position
from ..operators import duplicates, order, pairs, records, rename, sampling, search, stats
from . import adapters_sql as A
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R, P = f"({A.reads()})", f"({A.pairs()})"
MD5 = "md5('{seed}:' || ord)"
UNIFORM = "(('0x' || substr(md5('{seed}:' || ord), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
DIGEST = "md5(seq) AS seq_md5, md5(qual) AS qual_md5"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def digest(df: DataFrame, *names: str) -> DataFrame:
    """ord, some columns, and digests of sequences and qualities."""
    return df.select("ord", *names, F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_up(*half_mates(spark, sf_dir))


# stats

_N = "length({c}) - length(translate({c}, '{x}', ''))"


def _count(x: str) -> str:
    return f"(length(seq) - length(translate(seq, '{x}', '')))"


def _quals(t: int) -> str:
    return f"length(regexp_replace(qual, '[\\x00-\\x{33 + t - 1:02x}]', '', 'g'))"


def _stats_sql(source: str, quality: bool = True, fmt: str = "fastq") -> str:
    shares = ", ".join(f"CASE WHEN quals = 0 THEN 0.0 ELSE 100.0::DOUBLE * q{t} / quals END AS q{t}_pct" for t in (10, 20, 30))
    if not quality:
        shares = ", ".join(f"NULL::DOUBLE AS q{t}_pct" for t in (10, 20, 30))
    return f"""
WITH r AS ({source}),
h AS (SELECT file, length(seq) AS len, count(*) AS cnt FROM r GROUP BY 1, 2),
w AS (SELECT *, sum(len * cnt) OVER d AS cb, sum(cnt) OVER d AS cr, sum(len * cnt) OVER (PARTITION BY file) AS tb,
             sum(cnt) OVER (PARTITION BY file ORDER BY len) AS seen, sum(cnt) OVER (PARTITION BY file) AS n
      FROM h WINDOW d AS (PARTITION BY file ORDER BY len DESC)),
s AS (SELECT file, max(len) FILTER (tb > 0 AND cb >= tb * 0.5) AS n50,
             arg_max(cr - cnt + least(greatest(ceil((tb * 0.5 - (cb - len * cnt)) / len), 1), cnt), len) FILTER (tb > 0 AND cb >= tb * 0.5) AS l50,
             min(len) FILTER (seen > round(0.25::DOUBLE * (n - 1))) AS q1, min(len) FILTER (seen > round(0.5::DOUBLE * (n - 1))) AS q2, min(len) FILTER (seen > round(0.75::DOUBLE * (n - 1))) AS q3
      FROM w GROUP BY file),
a AS (SELECT file, count(*) AS records, sum(length(seq)) AS bases, min(length(seq)) AS lo, max(length(seq)) AS hi,
             sum({_count('GCgc')}) AS gc, sum({_count('Nn')}) AS nn, sum({_count(X.LOWER + X.UPPER)}) AS alpha, sum({_count('ACGTUNacgtun')}) AS nuc,
             sum({_count('Uu')}) AS u, sum({_count('Tt')}) AS t, sum(length(qual)) AS quals, {", ".join(f"sum({_quals(q)}) AS q{q}" for q in (10, 20, 30))}
      FROM r GROUP BY file)
SELECT a.file, '{fmt}' AS format,
       CASE WHEN alpha = 0 THEN 'NA' WHEN (alpha - nuc) / alpha::DOUBLE > 0.05 THEN 'protein' WHEN u > 0 AND t = 0 THEN 'RNA' ELSE 'DNA' END AS seq_type,
       records::BIGINT AS records, bases::BIGINT AS total_bases, lo::BIGINT AS min_len, hi::BIGINT AS max_len, bases / records::DOUBLE AS mean_len,
       CASE WHEN bases = 0 THEN 0.0 ELSE 100.0::DOUBLE * gc / bases END AS gc_pct,
       coalesce(n50, 0)::BIGINT AS n50, coalesce(l50, 0)::BIGINT AS l50, q1::BIGINT AS q1_len, q2::BIGINT AS median_len, q3::BIGINT AS q3_len,
       CASE WHEN bases = 0 THEN 0.0 ELSE 100.0::DOUBLE * nn / bases END AS n_pct, {shares}
FROM a JOIN s USING (file)"""


_BY_LANG = f"SELECT *, lang AS file FROM {R}"


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("file", F.substring_index("desc", " ", 1))


@query(f"SELECT file, format, seq_type, records, total_bases, min_len, max_len, mean_len, gc_pct, n50 FROM ({_stats_sql(_BY_LANG, False)})")
def stats_basic(spark, sf_dir):
    return stats.stats(_by_lang(spark, sf_dir), quality=False).select("file", "format", "seq_type", "records", "total_bases", "min_len", "max_len", "mean_len", "gc_pct", "n50")


@query(_stats_sql(_BY_LANG))
def stats_all(spark, sf_dir):
    return stats.stats(_by_lang(spark, sf_dir))


_W = "CASE WHEN sum(total_bases) = 0 THEN 0.0 ELSE round(sum({c} * total_bases) / sum(total_bases), 9) END AS {c}"


@query(
    f"""SELECT 'TOTAL' AS file, 'mixed' AS format, 'mixed' AS seq_type, sum(records)::BIGINT AS records, sum(total_bases)::BIGINT AS total_bases, min(min_len)::BIGINT AS min_len,
max(max_len)::BIGINT AS max_len, sum(total_bases) / sum(records)::DOUBLE AS mean_len, {_W.format(c='gc_pct')}, max(n50)::BIGINT AS n50, max(l50)::BIGINT AS l50,
max(q1_len)::BIGINT AS q1_len, max(median_len)::BIGINT AS median_len, max(q3_len)::BIGINT AS q3_len, {_W.format(c='n_pct')}, {_W.format(c='q10_pct')}, {_W.format(c='q20_pct')}, {_W.format(c='q30_pct')}
FROM ({_stats_sql(_BY_LANG)})"""
)
def stats_total(spark, sf_dir):
    total = stats.stats_total(stats.stats(_by_lang(spark, sf_dir)))
    return total.withColumns({c: F.round(c, 9) for c in ("gc_pct", "n_pct", "q10_pct", "q20_pct", "q30_pct")})


@query(_stats_sql(f"SELECT 'protein' AS file, {A.LETTERS.format('text')} AS seq, NULL::VARCHAR AS qual FROM documents UNION ALL SELECT 'rna', translate(seq, 'T', 'U'), NULL FROM {R}", False, "fasta"))
def stats_types(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string").alias("qual")
    protein = docs.select(F.lit("protein").alias("file"), letters(F.col("text")).alias("seq"), none)
    rna = reads(spark, sf_dir).select(F.lit("rna").alias("file"), F.translate("seq", "T", "U").alias("seq"), none)
    return stats.stats(protein.unionByName(rna), quality=False)


# seq, fq2fa


def _seq(name: str, sql: str, where: str = "true", qual: str = "qual", **options) -> None:
    def run(spark, sf_dir):
        return digest(records.seq(reads(spark, sf_dir), **options), "id")

    run.__name__ = name
    query(f"SELECT ord, id, md5({sql}) AS seq_md5, md5({qual}) AS qual_md5 FROM {R} WHERE {where}")(run)


_MEAN = "(list_sum(list_transform(string_split(qual, ''), lambda x: ord(x)))::BIGINT - 33 * length(qual)) / length(qual)::DOUBLE"
_seq("seq_len_filter", "seq", "length(seq) BETWEEN 500 AND 2000", min_len=500, max_len=2000)
_seq("seq_qual_filter", "seq", f"CASE WHEN length(qual) = 0 THEN 0.0 ELSE {_MEAN} END BETWEEN 24.0 AND 26.5", min_qual=24.0, max_qual=26.5)
_seq("seq_revcomp", A.REVCOMP.format("seq"), qual="reverse(qual)", revcomp=True)
_seq("seq_comp", "translate(seq, 'ACGTUNacgtun', 'TGCAANTGCAAN')", comp=True)
_seq("seq_rev", "reverse(seq)", qual="reverse(qual)", rev=True)
_seq("seq_upper_lower", "lower(seq)", upper=True, lower=True)
_seq("seq_remove_gaps", "translate(seq, 'N', '')", gaps=True, gap_letters="N")


@query(rf"SELECT doc_id AS ord, 'd' || doc_id AS id, regexp_extract(text, '[^ACGTURYSWKMBDHVNacgturyswkmbdhvn]', 0) AS letter FROM documents WHERE regexp_matches(text, '[^ACGTURYSWKMBDHVNacgturyswkmbdhvn]')")
def seq_validate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return records.invalid_records(docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("seq")))


@query(f"""SELECT ord, id, id || ' ' || "desc" AS name FROM {R}""")
def seq_names(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", "id", records.name(full=True).alias("name"))


@query(f"SELECT ord, id, md5(seq) AS seq_md5, NULL::VARCHAR AS qual_md5 FROM {R}")
def fq2fa(spark, sf_dir):
    return digest(records.fq2fa(reads(spark, sf_dir)), "id")


_COLOUR = "CASE upper(x) WHEN 'A' THEN '32' WHEN 'C' THEN '34' WHEN 'G' THEN '33' WHEN 'T' THEN '31' WHEN 'U' THEN '31' ELSE '37' END"


@query(f"SELECT ord, md5(coalesce(list_aggregate(list_transform(list_filter(string_split(seq, ''), lambda x: x <> ''), lambda x: chr(27) || '[' || {_COLOUR} || 'm' || x || chr(27) || '[0m'), 'string_agg', ''), '')) AS colour_md5 FROM {R}")
def seq_colour(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", F.md5(X.coloured(F.col("seq")).cast("binary")).alias("colour_md5"))


# grep


@query(f"SELECT ord, id FROM {R} WHERE id IN (SELECT 'd' || doc_id FROM labels WHERE quality = 1)")
def grep_id_exact(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id")).alias("pattern"))
    return search.grep(reads(spark, sf_dir), ids).select("ord", "id")


@query(f"SELECT ord, id FROM {R} WHERE id NOT IN (SELECT 'd' || doc_id FROM labels WHERE quality = 1)")
def grep_id_anti(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id")).alias("pattern"))
    return search.grep(reads(spark, sf_dir), ids, invert=True).select("ord", "id")


def _grep(name: str, where: str, *args, **options) -> None:
    def run(spark, sf_dir):
        return search.grep(reads(spark, sf_dir), *args, **options).select("ord", "id")

    run.__name__ = name
    query(f"SELECT ord, id FROM {R} WHERE {where}")(run)


_grep("grep_name_substr", """contains(id || ' ' || "desc", ' fr ') OR contains(id || ' ' || "desc", 'src1')""", [" fr ", "src1"], by="name")
_grep("grep_seq_substr", "contains(seq, 'GATTACA')", "GATTACA", by="seq")
_grep("grep_seq_regex", "regexp_matches(seq, 'A[CT]GA{2}C')", "A[CT]GA{2}C", by="seq", regex=True)
_grep("grep_qual", "contains(qual, 'E!E')", "E!E", by="qual")
_grep("grep_icase", """contains(lower(id || ' ' || "desc"), 'en src7')""", "EN Src7", by="name", ignore_case=True)
_grep("grep_invert", "NOT contains(seq, 'ACGT')", "ACGT", by="seq", invert=True)


@query(f"SELECT count(*)::BIGINT AS n FROM {R} WHERE contains(seq, 'NN')")
def grep_count(spark, sf_dir):
    return search.grep(reads(spark, sf_dir), "NN", by="seq").agg(F.count("*").alias("n"))


# locate


def _locate(name: str, pattern: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        return search.locate(reads(spark, sf_dir), pattern, **options).select("ord", "id", "start", "end", "match")

    run.__name__ = name
    query(sql)(run)


def _places(test: str, m: int) -> str:
    return f"""SELECT ord, id, i AS s, substr(seq, i::INTEGER, {m}) AS match FROM {R}, unnest(list_filter(range(1, greatest(length(seq) - {m} + 2, 1)), lambda i: {test})) AS u(i)"""


_LIT = _places("substr(seq, i::INTEGER, 3) = 'ACA'", 3)
_locate("locate_literal_all", "ACA", f'SELECT ord, id, s::BIGINT AS start, (s + 2)::BIGINT AS "end", match FROM ({_LIT})', all=True)
_locate("locate_first", "ACA", f'SELECT ord, id, min(s)::BIGINT AS start, (min(s) + 2)::BIGINT AS "end", min(match) AS match FROM ({_LIT}) GROUP BY ord, id')
_locate("locate_bed", "ACA", f'SELECT ord, id, (s - 1)::BIGINT AS start, (s + 2)::BIGINT AS "end", match FROM ({_LIT})', all=True, bed=True)
_RE = _places("regexp_full_match(substr(seq, i::INTEGER, 3), 'A[CT]G')", 3)
_locate("locate_regex", "A[CT]G", f'SELECT ord, id, s::BIGINT AS start, (s + 2)::BIGINT AS "end", match FROM ({_RE})', all=True, regex=True)
_locate("locate_icase", "aca", f'SELECT ord, id, s::BIGINT AS start, (s + 2)::BIGINT AS "end", match FROM ({_LIT})', all=True, ignore_case=True)


# rmdup


def _rmdup(name: str, key: str, order_by: str = "ord", id_sql: str = "id", **options) -> None:
    def run(spark, sf_dir):
        return digest(duplicates.rmdup(reads(spark, sf_dir), **options), "id")

    run.__name__ = name
    query(f"""SELECT ord, {id_sql} AS id, {DIGEST} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order_by}) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {R}) WHERE rn = 1""")(run)


_rmdup("rmdup_first", "seq", by="seq")
_rmdup("rmdup_last", "seq", "ord DESC", by="seq", keep="last")
_rmdup("rmdup_count_mark", "seq", id_sql="id || ';count=' || n || CASE WHEN n > 1 THEN ';dup=' || (n - 1) ELSE '' END", by="seq", count_dup=True, mark_dup=True)
_rmdup("rmdup_full", "id, seq, qual", by="full")
_rmdup("rmdup_id", "id", by="id")


# rename


def _rename(name: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        return rename.rename(reads(spark, sf_dir), **options).select("ord", "id", "desc")

    run.__name__ = name
    query(f'SELECT ord, {sql} AS id, "desc" FROM {R}')(run)


_rename("rename_generate", "'read_' || printf('%08d', 5 + row_number() OVER (ORDER BY ord) - 1)", prefix="read_", start=5, width=8)
_rename("rename_template", "'lib_r_' || printf('%04d', row_number() OVER (ORDER BY ord)) || '!'", prefix="r", width=4, template="lib_{prefix}_{n}!")
_rename("rename_regex", r"regexp_replace(id, '^d(\d+)(\d)$', 'x\2_\1')", match_regex=r"^d(\d+)(\d)$", replace="x${2}_$1")


@query(f"""SELECT r.ord, coalesce(m.new_id, r.id) AS id, r."desc" FROM {R} r LEFT JOIN (SELECT 'd' || doc_id AS old_id, 'q' || quality || '_' || doc_id AS new_id FROM labels) m ON m.old_id = r.id""")
def rename_map(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mapping = labels.select(F.concat(F.lit("d"), F.col("doc_id")).alias("old_id"), F.concat(F.lit("q"), F.col("quality"), F.lit("_"), F.col("doc_id")).alias("new_id"))
    return rename.rename(reads(spark, sf_dir), mapping=mapping).select("ord", "id", "desc")


# sort, head, tail


def _sort(name: str, keys: str, source: str = R, rows=reads, **options) -> None:
    def run(spark, sf_dir):
        return order.sort(rows(spark, sf_dir), **options).select("ord", "id")

    run.__name__ = name
    query(f"SELECT row_number() OVER (ORDER BY {keys}) - 1 AS ord, id FROM {source}")(run)


def events_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ids that are numbers, some with a letter."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.when(F.col("event_id") % 7 == 0, "x").otherwise("")
    return e.select("event_id", F.concat((F.col("user_id") * 37 % 1009).cast("string"), odd).alias("id"), F.col("event_type").alias("desc"), F.col("event_type").alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit("events").alias("file"), F.col("event_id").alias("ord")).drop("event_id")


_EVENTS = "(SELECT event_id AS ord, (user_id * 37 % 1009)::VARCHAR || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END AS id FROM events)"
_sort("sort_id", "id, ord", by="id")
_sort("sort_name_desc", """id || ' ' || "desc" DESC, ord""", by="name", reverse=True)
_sort("sort_len", "length(seq), ord", by="len")
_sort("sort_seq", "seq, ord", by="seq")
_sort("sort_numeric", "NOT regexp_full_match(id, '[0-9]+'), try_cast(id AS BIGINT), id, ord", _EVENTS, events_as_records, by="id", numeric=True)


@query(f"SELECT ord, id FROM {R} ORDER BY ord LIMIT 123")
def head_n(spark, sf_dir):
    return order.head(reads(spark, sf_dir), 123).select("ord", "id")


@query(f"SELECT ord, id FROM {R} WHERE ord < ceil((SELECT count(*) FROM documents) * 0.34::DOUBLE)")
def head_prop(spark, sf_dir):
    return order.head(reads(spark, sf_dir), proportion=0.34).select("ord", "id")


@query(f"SELECT ord, id FROM {R} ORDER BY ord DESC LIMIT 77")
def tail_n(spark, sf_dir):
    return order.tail(reads(spark, sf_dir), 77).select("ord", "id")


@query(f"SELECT ord, id FROM {R} WHERE ord >= (SELECT count(*) FROM documents) - ceil((SELECT count(*) FROM documents) * 0.21::DOUBLE)")
def tail_prop(spark, sf_dir):
    return order.tail(reads(spark, sf_dir), proportion=0.21).select("ord", "id")


# sample, shuffle, spike


@query(f"SELECT ord, id FROM {R} WHERE {UNIFORM.format(seed=42)} <= 0.3")
def sample_rate(spark, sf_dir):
    return sampling.sample(reads(spark, sf_dir), rate=0.3).select("ord", "id")


@query(f"SELECT ord, id FROM {R} ORDER BY {MD5.format(seed=7)}, ord LIMIT 100")
def sample_num(spark, sf_dir):
    return sampling.sample(reads(spark, sf_dir), num=100, seed=7).select("ord", "id")


@query(f"SELECT row_number() OVER (ORDER BY {MD5.format(seed=42)}, ord) - 1 AS ord, id FROM {R}")
def shuffle(spark, sf_dir):
    return sampling.shuffle(reads(spark, sf_dir)).select("ord", "id")


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = letters(F.col("text"))
    return b.select(F.lit("benchmark").alias("file"), F.col("item_id").alias("ord"), F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.lit(None).cast("string").alias("desc"), own.alias("seq"), own.alias("qual"))


_SLOT = "least(floor({u} * ({n} + 1)), {n})"


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT id, ord, 2 * ord + 1 AS slot FROM {R}
      UNION ALL SELECT 'b' || ord, ord, 2 * {_SLOT.format(u=UNIFORM.format(seed=42), n='n')}::BIGINT FROM (SELECT item_id AS ord FROM benchmark), n)
SELECT row_number() OVER (ORDER BY slot, ord) - 1 AS ord, id FROM x"""
)
def spike(spark, sf_dir):
    return sampling.spike(reads(spark, sf_dir), inserts(spark, sf_dir)).select("ord", "id")


# pairs

_Z = f"({A.zipped()})"
_PAIR_DIGEST = "md5(seq1) AS seq1_md5, md5(seq2) AS seq2_md5"


def pair_digest(df: DataFrame, *more: str) -> DataFrame:
    return df.select("ord", "id1", "id2", *more, *(F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("seq1", "seq2")))


@query(f"SELECT ord, id1, id2, status, {_PAIR_DIGEST} FROM {_Z}")
def pair_zip(spark, sf_dir):
    z = pairs.zip_mates(*turn_mates(spark, sf_dir))
    return pair_digest(z, "status").select("ord", "id1", "id2", "status", "seq1_md5", "seq2_md5")


@query(f"SELECT status, count(*)::BIGINT AS n FROM {_Z} GROUP BY status")
def pair_invalid_report(spark, sf_dir):
    return pairs.pair_report(pairs.zip_mates(*turn_mates(spark, sf_dir)))


@query(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, id1, id2, {_PAIR_DIGEST} FROM {_Z} WHERE status = 'valid'")
def pair_validate(spark, sf_dir):
    return pair_digest(pairs.pair_up(*turn_mates(spark, sf_dir), allow_unpaired=True))


def _pair(name: str, sql: str, f) -> None:
    def run(spark, sf_dir):
        return pair_digest(f(paired(spark, sf_dir)))

    run.__name__ = name
    query(sql)(run)


_SELECT = f"SELECT ord, id1, id2, {_PAIR_DIGEST} FROM {P}"
_pair("grep_pair_any", f"{_SELECT} WHERE contains(seq1, 'GATTAC') OR contains(seq2, 'GATTAC')", lambda p: search.grep_pairs(p, "GATTAC", by="seq"))
_pair("grep_pair_both", f"{_SELECT} WHERE NOT (contains(seq1, 'NA') AND contains(seq2, 'NA'))", lambda p: search.grep_pairs(p, "NA", by="seq", pair_mode="both", invert=True))
_pair("head_pair", f"{_SELECT} WHERE ord < 50", lambda p: order.head(p, 50))
_pair("tail_pair", f"{_SELECT} WHERE ord >= (SELECT count(*) FROM documents) - ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE)", lambda p: order.tail(p, proportion=0.1))
_pair("sample_pair", f"{_SELECT} ORDER BY {MD5.format(seed=7)}, ord LIMIT 100", lambda p: sampling.sample(p, 100, seed=7))
_pair("sample_rate_pair", f"{_SELECT} WHERE {UNIFORM.format(seed=42)} <= 0.3", lambda p: sampling.sample(p, rate=0.3))
_pair("shuffle_pair", f"SELECT row_number() OVER (ORDER BY {MD5.format(seed=42)}, ord) - 1 AS ord, id1, id2, {_PAIR_DIGEST} FROM {P}", sampling.shuffle)
_pair(
    "rename_pair",
    f"SELECT ord, c || '/1' AS id1, c || '/2' AS id2, {_PAIR_DIGEST} FROM (SELECT *, 'pair_' || printf('%06d', row_number() OVER (ORDER BY ord)) AS c FROM {P})",
    lambda p: rename.rename(p, prefix="pair_", keep_pair_suffix=True),
)
_pair(
    "rmdup_pair",
    f"""SELECT ord, id1 || ';count=' || n || CASE WHEN n > 1 THEN ';dup=' || (n - 1) ELSE '' END AS id1, id2, {_PAIR_DIGEST}
FROM (SELECT *, row_number() OVER (PARTITION BY seq1, seq2 ORDER BY ord) AS rn, count(*) OVER (PARTITION BY seq1, seq2) AS n FROM {P}) WHERE rn = 1""",
    lambda p: duplicates.rmdup(p, by="seq", count_dup=True, mark_dup=True),
)


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM documents),
b AS (SELECT item_id AS ord, 'b' || item_id AS id, {A.LETTERS.format('text')} AS seq FROM benchmark),
x AS (SELECT ord, 2 * ord + 1 AS slot, id1, id2, seq1, seq2 FROM {P}
      UNION ALL SELECT ord, 2 * {_SLOT.format(u=UNIFORM.format(seed=42), n='n')}::BIGINT, id || '/1', id || '/2', seq, reverse(seq) FROM b, n)
SELECT row_number() OVER (ORDER BY slot, ord) - 1 AS ord, id1, id2, {_PAIR_DIGEST} FROM x"""
)
def spike_pair(spark, sf_dir):
    b = inserts(spark, sf_dir)
    one = b.withColumn("id", F.concat("id", F.lit("/1")))
    two = b.withColumn("id", F.concat("id", F.lit("/2"))).withColumn("seq", F.reverse("seq"))
    return pair_digest(sampling.spike(paired(spark, sf_dir), pairs.pair_up(one, two)))


@query(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, id1, id2, {_PAIR_DIGEST} FROM {_Z} WHERE status = 'valid' ORDER BY ord LIMIT 5")
def head_pair_invalid(spark, sf_dir):
    return pair_digest(order.head_zipped(pairs.zip_mates(*turn_mates(spark, sf_dir)), 5, allow_unpaired=True))


# Sources and sinks: the reads written as files of each kind, and read back.

_FIELDS = f'SELECT id, "desc", {DIGEST} FROM {R}'
_BARE = f'SELECT id, "desc", md5(seq) AS seq_md5, NULL::VARCHAR AS qual_md5 FROM {R}'


def fields(df: DataFrame) -> DataFrame:
    return digest(df, "id", "desc").drop("ord")


@query(_BARE)
def fasta_scan(spark, sf_dir):
    path = sources.scratch(spark, "fasta")
    sources.write_fastx(reads(spark, sf_dir), path, "fasta")
    return fields(sources.read_fasta_text(spark, path))


@query(_BARE)
def fasta_xz_scan(spark, sf_dir):
    path = sources.scratch(spark, "fasta-xz")
    sources.write_fastx(reads(spark, sf_dir), path, "fasta", "xz")
    return fields(sources.read_fastx(spark, path, "fasta"))


@query(_FIELDS)
def fastq_scan(spark, sf_dir):
    path = sources.scratch(spark, "fastq")
    sources.write_fastx(reads(spark, sf_dir), path, "fastq")
    return fields(sources.read_fastx(spark, path, "fastq"))


@query(_FIELDS)
def fastq_gz_scan(spark, sf_dir):
    path = sources.scratch(spark, "fastq-gz")
    sources.write_fastx(reads(spark, sf_dir), path, "fastq", "gz")
    return fields(sources.read_fastx(spark, path, "fastq"))


@query(_FIELDS)
def fastq_text_scan(spark, sf_dir):
    path = sources.scratch(spark, "fastq-text")
    sources.write_fastx(reads(spark, sf_dir), path, "fastq")
    return fields(sources.read_fastq_text(spark, path))


_ALIGNED = f"SELECT id, md5(seq) AS seq_md5, md5(CASE WHEN {{}} THEN qual END) AS qual_md5 FROM {R}"


@query(_ALIGNED.format("seq <> '' AND qual <> '*'"))
def sam_scan(spark, sf_dir):
    """A star stands for an empty sequence, and for qualities that are missing."""
    path = sources.scratch(spark, "sam")
    cells = (F.when(F.col(c) == "", "*").otherwise(F.col(c)) for c in ("seq", "qual"))
    line = F.concat_ws("\t", "id", *(F.lit(x) for x in "4 * 0 0 * * 0 0".split()), *cells)
    reads(spark, sf_dir).select(line.alias("value")).write.text(path)
    return fields(sources.read_sam(spark, path)).drop("desc")


@query(_ALIGNED.format("seq <> ''"))
def bam_scan(spark, sf_dir):
    path = sources.scratch(spark, "bam")
    sources.write_bam(reads(spark, sf_dir), path)
    return fields(sources.read_fastx(spark, path, alignments=True)).drop("desc")


@query(_stats_sql(f"SELECT *, 'reads' AS file FROM {R}", fmt="bam"))
def stats_bam(spark, sf_dir):
    path = sources.scratch(spark, "bam")
    sources.write_bam(reads(spark, sf_dir), path)
    return stats.stats(sources.read_fastx(spark, path, alignments=True).withColumn("file", F.lit("reads")), format="bam")


_TSV = "concat_ws(chr(9), file, format, seq_type, records, total_bases, min_len, max_len, printf('%.3f', mean_len), printf('%.3f', gc_pct), n50)"


@query(f"SELECT 0::BIGINT AS line, {chr(39)}{chr(9).join(report.TITLES.get(c, c) for c in report.BASIC)}{chr(39)} AS text UNION ALL SELECT row_number() OVER (ORDER BY file), {_TSV} FROM ({_stats_sql(_BY_LANG, False)})")
def stats_tsv(spark, sf_dir):
    """The lines of the tab-separated report, files in order of their names."""
    rows = [r.asDict() for r in stats.stats(_by_lang(spark, sf_dir), quality=False).orderBy("file").collect()]
    return spark.createDataFrame(list(enumerate(report.tsv(rows).splitlines())), "line long, text string")


@query(f"SELECT ord, id, id || ' ' || \"desc\" AS header FROM {R}")
def raw_headers(spark, sf_dir):
    """Whole header lines as ids."""
    path = sources.scratch(spark, "raw")
    sources.write_fastx(reads(spark, sf_dir), path, "fasta")
    found = sources.read_fastx(spark, path, "fasta", raw_header=True, columns=("id",))
    name = F.split("id", " ")[0]
    return found.select(F.substring(name, 2, 20).cast("long").alias("ord"), name.alias("id"), F.col("id").alias("header"))


@query(f"SELECT ord, id FROM {R} WHERE id NOT IN (SELECT 'd' || doc_id FROM labels WHERE quality = 0)")
def grep_pattern_file(spark, sf_dir):
    """Ids of a pattern file, blank lines and blanks around them left out."""
    path = sources.scratch(spark, "patterns")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
    labels.select(F.concat(F.lit(" d"), F.col("doc_id"), F.lit(" \n")).alias("value")).write.text(path)
    return search.grep(reads(spark, sf_dir), sources.read_patterns(spark, path), invert=True).select("ord", "id")


@query(f"SELECT ord, '$' || regexp_extract(id, '([0-9])([0-9]*)$', 1) || 'x' || regexp_extract(id, '([0-9])([0-9]*)$', 2) || '/' AS id FROM {R}")
def rename_regex_groups(spark, sf_dir):
    """$$ is a dollar, ${1}x the first group and an x, $1x a group of that name, which there isn't."""
    found = rename.rename(reads(spark, sf_dir), mode="regex", match_regex=r"^\w*?(\d)(?<rest>\d*)$", replace="$$${1}x${rest}/$1x")
    return found.select("ord", "id")


# A filter and a sort in one plan.


@query(f"SELECT row_number() OVER (ORDER BY id, ord) - 1 AS ord, id FROM {R} WHERE length(seq) >= 1000")
def sort_filtered(spark, sf_dir):
    return with_position(records.seq(reads(spark, sf_dir), min_len=1000), "id", "ord").select("ord", "id")
