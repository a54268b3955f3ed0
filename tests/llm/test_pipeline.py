"""The pipeline: each stage against a brute-force version, on its own input."""

import pytest

import corpus_pipeline as P
from test_text_operators import brute_components, brute_lines
from test_token_operators import check_pieces

from strandlake.llm import quality_rules


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(texts[2].split()[3:30])), (1, "not in any text of ours at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def keyed(df):
    rows = {r.doc_id: r.text for r in df.collect()}
    return rows


def test_stages(spark, docs, sf_dir):
    names = docs.columns
    now = docs
    for name, stage in P.STAGES[:-1]:
        before = keyed(now)
        out = stage(spark, now, sf_dir)
        assert out.columns == names, name
        after = keyed(out)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.annotate(now).where("quality.kept").collect()}
            assert after == {i: t for i, t in before.items() if i in kept} and after
        elif name == "line_dedup":
            lines = brute_lines(before.items(), by_sentence=False)
            assert after == {i: t for i, (t, n, gone, _) in lines.items() if not n or gone < n}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "ngram_jaccard_join":
            groups = brute_components(before.items())
            assert after == {i: t for i, t in before.items() if groups[i][1] == i}
        else:
            assert set(before) - set(after) == {6}
        out.write.mode("overwrite").parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
    assert now.count() >= 5


def test_run_and_awkward_tables(spark, docs, sf_dir, none, odd, tmp_path):
    pieces = P.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0
    for table in (none, odd):
        now = table
        for name, stage in P.STAGES:
            now = stage(spark, now, sf_dir)
            if name != "packing":
                assert now.columns == table.columns
        now.count()


def test_near_duplicates_keep_one_of_repeated_rows(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(4, text), (4, text), (9, text + " x"), (11, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, sf_dir).collect()) == [4, 11]


def test_repeated_and_missing_ids_keep_their_texts(spark, sf_dir):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = spark.createDataFrame([(4, one), (4, two), (4, one), (9, one + " x"), (None, three), (None, three), (None, two), (11, None)], "doc_id long, text string")
    want = sorted([(4, one), (4, two), (None, three), (None, two), (11, None)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, sf_dir).collect()), key=repr) == want
    for stage in (P.lines, P.decontaminate):
        got = [r.text for r in stage(spark, df, sf_dir).where("doc_id is null").collect()]
        assert sorted(got) == sorted([three, three, two]), stage


def test_packing_stage(spark, docs, sf_dir):
    from strandlake.llm import packing
    from strandlake.llm.queries import vocabulary

    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()])
