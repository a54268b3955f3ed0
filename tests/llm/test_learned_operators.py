"""Toxicity and PII."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import pii, toxicity

# Toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    bad = ["vile", "rotten", "filthy", "nasty"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.15
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", ",", "!!"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(*toxicity.sample(docs, labels))
    scored = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    rows = scored.where("held_out").collect()
    caught = [r.score >= 0.7 for r in rows if r.toxic]
    wrong = [r.score >= 0.7 for r in rows if not r.toxic]
    assert sum(caught) >= 0.95 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_toxicity_learns_only_from_its_part(spark, labelled):
    """Held-out labels don't matter, nor do the order of rows and the number of partitions."""
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.train(*toxicity.sample(docs, labels))
    b = toxicity.train(*toxicity.sample(docs.repartition(7), turned.repartition(5)))
    assert a == b
    assert [bool(x[0]) for x in spark.range(12).select(toxicity.held_out(F.col("id"))).collect()] == [__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in range(12)]


def test_toxicity_bounds_and_awkward_tables(spark, labelled, docs, none, odd):
    positive, others = toxicity.sample(*labelled, most_positive=10, most_unlabelled=20)
    assert len(positive) == 10 and len(others) == 20
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample(docs, empty))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {toxicity.Model({}, -30.0).score(b"")}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.train(*toxicity.sample(*labelled))).count() == odd.count()


def test_risk_correction_keeps_the_prior():
    """Unlabelled texts that are like the positives pull scores up only to the class prior."""
    rng = np.random.default_rng(1)
    positive = [{b"bad", b"w%d" % rng.integers(50)} for _ in range(300)]
    unlabelled = [{b"bad"} if rng.random() < 0.1 else {b"good", b"w%d" % rng.integers(50)} for _ in range(2000)]
    model = toxicity.train(positive, unlabelled, prior=0.1)
    assert model.score(b"so bad") > 0.7 > 0.3 > model.score(b"so good")


def test_step_follows_the_risk():
    """The direction against differences of the risk, written out, in both of its cases."""
    rng = np.random.default_rng(3)
    loss = lambda z: 1 / (1 + np.exp(z))
    bracket = lambda p, u, prior: loss(-u).mean() - prior * loss(-p).mean()
    cases = set()
    for shift in (-3, 0):
        p, u, prior = rng.normal(1, 1, 7), rng.normal(shift, 1, 11), 0.3
        if bracket(p, u, prior) >= 0:
            goal = lambda p, u: prior * loss(p).mean() + bracket(p, u, prior)  # noqa: B023, E731
        else:
            goal = lambda p, u: -bracket(p, u, prior)  # noqa: B023, E731
        cases.add(bracket(p, u, prior) >= 0)
        dp, du = toxicity.gradient(p, u, prior)
        for z, d, f in ((p, dp, lambda z: goal(z, u)), (u, du, lambda z: goal(p, z))):  # noqa: B023
            for k in range(len(z)):
                step = np.zeros(len(z))
                step[k] = 1e-5
                assert d[k] == pytest.approx((f(z + step) - f(z - step)) / 2e-5, rel=1e-4)
    assert cases == {True, False}


def test_held_out_recall_on_the_tables(spark):
    """Toxic texts that weren't trained on, at sf0.1: those missed mostly have no word that tells."""
    import os

    from strandlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    rows = QUERIES["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught, wrong = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def test_rows_without_an_id_are_scored(spark, labelled):
    df = spark.createDataFrame([(None, "vile rotten filthy nasty"), (1, None)], "doc_id long, text string")
    scored = toxicity.score(df, toxicity.train(*toxicity.sample(*labelled))).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    assert sorted((r.doc_id is None, r.held_out) for r in scored.collect()) == [(False, False), (True, False)]


@pytest.mark.parametrize("share", [0.02, 0.13, 0.4])
def test_toxicity_at_other_shares(spark, tmp_path, share):
    """op1 takes the class prior from the labels, so a table rich in toxic texts keeps its recall."""
    from strandlake.llm.queries import QUERIES

    rng = random.Random(17)
    texts, labels = [], []
    for i in range(6000):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < share
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "filthy", "nasty"]))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.predicted, labels[r.doc_id][1]) for r in QUERIES["op1_toxicity"](spark, str(tmp_path)).where("held_out").collect()]
    caught, wrong = [p for p, t in rows if t], [p for p, t in rows if not t]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.02 * len(wrong)
    trained = [t for i, t in labels if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    assert toxicity.prior(table) == pytest.approx(sum(trained) / len(trained))


def test_prior_counts_ids_once(spark):
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 3 != 1][:4]
    rows = [(ids[0], 1), (ids[0], 0), (ids[0], 0), (ids[1], 0), (ids[2], None), (ids[3], 0), (None, 1)]
    assert toxicity.prior(spark.createDataFrame(rows, "doc_id long, toxic int")) == pytest.approx(1 / 3)
    assert toxicity.prior(spark.createDataFrame([], "doc_id long, toxic int")) == 0


# PII


def brute_base(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


def test_base_spans_match_the_patterns():
    rng = random.Random(12)
    pieces = ["a", "b.c", "@", "x@y.z", "@d.e", ".", "1", "255", "300", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", "+1 (212) 555-0100", "+", " ", "-", "é", "漢", "007", "..", "%", "\n", "12345678901234567890"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 200_000 + "@ " + "1" * 200_000 + "." * 50_000) is not None


def test_gradients():
    rng = np.random.default_rng(0)
    net = pii.Network.fresh(hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, pii.CLASSES, (3, 6))
    y = np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 6, 0], [7, 8, 0, 0, 0, 0]])
    m = np.ones((3, 6), bool)
    m[1, 4:] = False
    _, grad = net.loss(x, y, m)
    for name in net.p:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            if name == "t" and not pii.allowed()[at]:
                continue
            old, h = net.p[name][at], 1e-3
            net.p[name][at] = old + h
            up = net.loss(x, y, m)[0]
            net.p[name][at] = old - h
            down = net.loss(x, y, m)[0]
            net.p[name][at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * h), rel=0.03, abs=2e-4), name


@pytest.fixture(scope="module")
def filled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice("alpha beta gamma delta epsilon the of and to in".split()) for _ in range(60)]
        if i % 3 == 0:
            words[20] = f"joe{i}.x@mail{i}.example.com"
            words[40] = f"+1 (212) 555-0{100 + i}"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "call 212-555-0187 or (212) 555-0188 today"), (1003, "nothing of 2024-05-06 and 12.5 here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_network_learns_and_adds(filled):
    net = pii.train(filled)
    texts = [r.text for r in filled.collect() if r.text]
    x, y, m = pii.examples(texts, 150, seed=77)
    e, right, wanted = net.emissions(x), 0, 0
    for i in range(len(x)):
        n = int(m[i].sum())
        gold = set(pii.spans_of(y[i][:n]))
        right += len(gold & set(pii.spans_of(net.viterbi(e[i][:n]))))
        wanted += len(gold)
    assert right >= 0.7 * wanted
    got = {r.doc_id: (r.base, r.spans) for r in pii.detect(filled, net).collect()}
    for r in filled.collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(r.text or "")]
        assert got[r.doc_id][0] == base and set(base) <= set(got[r.doc_id][1])
    assert got[1003] == ([], [])


def test_national_numbers_and_written_at(filled):
    phones = ["01 23 45 67 89", "612 345 678", "912 34 56 78", "030 1234567", "0201/123456", "020 7946 0958", "0161 496 0000", "(030) 1234567", "07700 900123"]
    addresses = ["joe.smith (at) mail.com", "joe.smith(at)mail.com", "joe.smith [at] mail.com", "joe.smith (at) mail (dot) com", "joe.smith @ mail.com"]
    assert all(pii.plausible("phone", x) for x in phones) and all(pii.plausible("email", x) for x in addresses)
    no = ["2024-05-06", "123456789", "123 456 789", "912.345.678", "1234 5678 90", "00 12 34 56 78", "012345678901", "12.05.2024 10"]
    assert not any(pii.plausible("phone", x) for x in no) and not pii.plausible("email", "meet (at) noon")
    assert list(pii.clusters("alpha beta joe.smith(at)mail.com")) and list(pii.clusters("tel 612 345 678")) and not list(pii.clusters("tel 612 345 67"))
    net = pii.train(filled)
    found = {}
    for kind, some in (("phone", phones), ("email", addresses)):
        for x in some:
            text = f"alpha beta gamma {x} delta epsilon"
            base, full = pii.find(text, net)
            assert base == []
            found[x] = [(k, text[a:b]) for k, a, b in full] == [(kind, x)]
    assert sum(found.values()) >= 0.7 * len(found), found


def test_recall_of_formats_that_training_never_wrote(filled):
    """Spans of withheld formats in texts that weren't trained on: nine of ten are found, and numbers that are none stay."""
    rng = np.random.default_rng(5)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(3, 9)))

    def card(groups):
        body = d(sum(groups) - 1)
        digits = next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
        at = np.concatenate(([0], np.cumsum(groups)))
        return " ".join(digits[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    forms = {
        "glued area code": lambda: ("phone", f"({d(3)}){d(3)}-{d(4)}"),
        "mixed separators": lambda: ("phone", f"{d(3)} {d(3)}.{d(4)}"),
        "4-6-5": lambda: ("card", card((4, 6, 5))),
        "4-6-4": lambda: ("card", card((4, 6, 4))),
        "mixed brackets": lambda: ("email", f"{w()}.{w()} [at] {w()} (dot) com"),
        "two domains": lambda: ("email", f"{w()}.{w()} @ {w()}.{w()}.org"),
        "none": lambda: ("O", f"{d(2)}.{d(2)}.{d(4)} {d(2)}:{d(2)} {d(3)}"),
    }
    net = pii.train(filled)
    found = dict.fromkeys(forms, 0)
    for name, form in forms.items():
        for _ in range(50):
            kind, s = form()
            before = " ".join(w() for _ in range(6)) + " "
            text = before + s + " " + " ".join(w() for _ in range(6))
            base, full = pii.find(text, net)
            added = [x for x in full if x not in base]
            found[name] += added == ([] if kind == "O" else [(kind, len(before), len(before) + len(s))])
    assert sum(found.values()) >= 0.9 * 50 * len(found), found


def test_taken_is_a_bisection():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 6)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken = pii._Taken(spans)
        for _ in range(12):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 6)
            free = not any(a < z and y < b for y, z in spans)
            assert taken.add(a, b) == free
            if free:
                spans.append((a, b))


def test_long_clusters_decode_as_one(filled):
    """A cluster of many windows: spans don't overlap and lie in the text, whatever the windows' edges."""
    net = pii.train(filled)
    text = "call " + " or ".join(f"212-555-{1000 + i}" for i in range(60))
    base, full = pii.find(text, net)
    ends = sorted((a, b) for _, a, b in full)
    assert base == [] and all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))
    assert all(pii.plausible(k, text[a:b]) for k, a, b in full)


def test_pii_of_nothing_and_odd_rows(none, odd):
    net = pii.train(none)
    assert pii.detect(none, net).count() == 0
    assert pii.detect(odd, net).count() == odd.count()
    assert hashlib.sha256(b"").hexdigest()


def test_samples_follow_the_hashes(spark):
    """The rows of least hashes that qualify, however many rows there are and whichever share holds them."""
    from strandlake.llm.common import hashed_sample

    df = spark.range(20_000).selectExpr("id as doc_id", "id % 500 = 3 as rare").repartition(5)
    for where in (None, F.col("rare"), F.lit(False)):
        got = [r.doc_id for r in hashed_sample(df, "doc_id", 10, where).collect()]
        ranked = df.where(F.lit(True) if where is None else where).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
        assert got == [r.doc_id for r in ranked.limit(10).collect()]


# The queries' columns


def test_queries_are_registered():
    from strandlake.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
