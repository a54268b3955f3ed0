"""The training-data queries that SQL can express, on the driver's smallest tables."""

import hashlib
import os
import zlib

import pytest
from test_learned_operators import brute_base

from strandlake.llm.oracles import ORACLES
from strandlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_pages_without_an_id_match_the_sql(spark, duck, tmp_path):
    rows = [(3, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "v", "only without"), (None, None, "only without"), (None, "u", None), (7, "u", "b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op6_warc"](spark, str(tmp_path))
    columns = sorted(got.columns)
    sql = ORACLES["op6_warc"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert len(want) == len(rows)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)


COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_string_tiling": ["doc_id", "item_id", "n_tiles", "covered_words", "item_words"],
    "op5_retrieval_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_bit_packing": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_other_queries_columns(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    if name in ("op1_toxicity", "op9_pii", "op10_bit_packing"):
        assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in duck.sql("SELECT doc_id FROM documents").fetchall())
    if name == "op1_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    if name == "op9_pii":
        texts = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
        for r in rows:
            base = brute_base(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in ("email", "ip", "card", "phone")]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert sum(r.n_phone for r in rows) and sum(r.n_email for r in rows)
    if name == "op5_retrieval_packing":
        assert len({r.doc_id for r in rows}) == n
    if name == "op2_string_tiling":
        assert rows and all(r.covered_words >= 0.5 * r.item_words for r in rows)
