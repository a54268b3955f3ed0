"""Documents with the awkward cases that every operator has to take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "le", "der"]) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(4)
    base = [" ".join(words(rng, rng.randrange(20, 200))) for _ in range(24)]
    near = base[3].split()
    near[len(near) // 2] = "changed"
    moved = base[5].split()
    found = [*base, base[3], base[3], " ".join(near), base[5] + " and five more words here", base[7] + "\n" + base[8], "\n".join(base[9:12]), "\n".join((base[10], base[11]))]
    found += [None, "", " \t\n", "one", "two words here now", "Ünïcode ß 漢字 text with odd spaces", "x" * 5000, "a b " * 30_000, " ".join(moved[::-1])]
    found += ["line one of five tokens\nline two of five tokens\n\n  \nline one of five tokens", "<|endoftext|> it's 12,5 %\r\nnext\x0bline"]
    return found


@pytest.fixture(scope="session")
def rows(texts):
    return [(i * 3, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, a doc_id with two texts, a null doc_id, and columns named as operators name theirs."""
    from pyspark.sql import functions as F

    more = [rows[0], rows[0], (rows[1][0], "another text of some words", "en", "s", 26), (None, "no id", "en", "s", 5)]
    df = spark.createDataFrame(rows[:6] + more, SCHEMA)
    names = ("score", "n", "class_id", "component", "component_id", "shingle", "part", "segment", "start", "ids", "signature", "n_lines", "n_dropped", "n_cut", "rules", "leaf", "payload", "digest", "x", "a", "b", "_doc", "spans", "chunk", "quality")
    return df.withColumns({n: F.lit("own") for n in names})
