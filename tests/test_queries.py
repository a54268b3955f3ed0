"""Every registered query against its SQL in DuckDB, on the driver's smallest tables."""

import hashlib
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from strandlake.plans.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.10g}")
        return v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(duck.sql(f"SELECT {order} FROM ({ORACLES[name]})").fetchall())


def test_every_record_is_coloured(spark):
    """Records of more than 1,000 letters too."""
    from strandlake.model import reads

    codes = {**dict.fromkeys("Aa", 32), **dict.fromkeys("Cc", 34), **dict.fromkeys("Gg", 33), **dict.fromkeys("TtUu", 31)}
    want = {r.ord: hashlib.md5("".join(f"\x1b[{codes.get(x, 37)}m{x}\x1b[0m" for x in r.seq).encode()).hexdigest() for r in reads(spark, SF).collect()}
    got = {r.ord: r.colour_md5 for r in QUERIES["seq_colour"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 4 and df.columns[0] == "file"
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_plans_stay_narrow(spark):
    """Row operators don't shuffle, columns and filters reach the scan, and only mean quality uses Python."""
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("seq_revcomp", "seq_comp", "seq_len_filter", "grep_seq_regex", "rename_regex", "sample_rate", "fq2fa"):
        assert "Exchange" not in plan(name) and "Python" not in plan(name), name
    assert "source" not in plan("grep_seq_regex") and "n_chars" not in plan("seq_revcomp")
    assert "BroadcastHashJoin" in plan("grep_id_exact")
    assert "TakeOrderedAndProject" in plan("head_n")
