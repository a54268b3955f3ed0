"""Tokenizer memo, bit packing, retrieval packing, LM scores, archive."""

import base64
import hashlib
import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bitpack, lm_scoring, packing, tokens, warc

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


# Tokens


@pytest.mark.parametrize("name", NAMES)
def test_memo_encodes_as_the_library_does(name, texts):
    encode, memo = plain(name), tokens.Encoder(public_tokenizers.path(name), most_units=500)
    assert memo.form is not None
    cases = [t or "" for t in texts]
    got = memo.encode(cases)
    assert got == [array("I", encode(t)).tobytes() for t in cases]
    assert memo.encode(cases) == got


@pytest.mark.parametrize("name", NAMES)
def test_strings_of_special_tokens(name):
    """They are the tokens, as in the library; with special_as_text they are ordinary text."""
    encode = plain(name)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|startoftext|>b ", "  <|endoftext|>\n x", "<|endoftext|", "e\u0301<|endoftext|>\u0301", "<|ENDOFTEXT|>", "one\u00a0two <|endoftext|> three"]
    memo = tokens.Encoder(public_tokenizers.path(name))
    assert memo.encode(texts) == [array("I", encode(t)).tobytes() for t in texts]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    memo = tokens.Encoder(public_tokenizers.path(name), special_as_text=True)
    assert memo.encode(texts) == [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " "]), st.text(alphabet="aZ é.'\n\u0301 1<|", max_size=6)), max_size=8))
def test_memo_around_special_tokens(parts):
    text = "".join(parts)
    for name in NAMES:
        assert tokens.encoder(public_tokenizers.path(name)).encode([text])[0] == array("I", ENCODE[name](text)).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZ éßÖ.,'! \n\t\r\x0b  \x1c\x85　Σσ1²ⅧéİK<|>_-🙂漢"), st.characters(codec="utf-8")), max_size=40))
def test_memo_on_any_text(text):
    for name in NAMES:
        memo = tokens.encoder(public_tokenizers.path(name))
        assert memo.encode([text])[0] == array("I", ENCODE[name](text)).tobytes()


ENCODE = {name: plain(name) for name in NAMES}


# Bit packing


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = bitpack.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (bitpack.unpack(data, bits, n) == ids).all()


def test_widths():
    assert [bitpack.width(v) for v in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_segment_random_access():
    rng = np.random.default_rng(1)
    lengths = [0, 5, 300, 1, 0, 77]
    ids = rng.integers(0, 50_000, sum(lengths)).astype("<u4")
    for bits in (16, 17):
        s = bitpack.Segment(bitpack.build_segment([5, 6, 7, 8, 9, 10], lengths, ids, bits, block=64))
        at = 0
        for k, n in enumerate(lengths):
            assert (s.document(k) == ids[at : at + n]).all()
            at += n
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (s.read(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        bitpack.build_segment([1], [1], np.array([1 << 16], "<u4"), 16)
    with pytest.raises(ValueError):
        bitpack.Segment(b"nothing of the kind")


def packed(docs, **options):
    segments = bitpack.write_segments(docs, public_tokenizers.path(NAMES[0]), 49_408, end_id=2, **options)
    return segments, bitpack.with_global_start(bitpack.read_segments(segments), segments)


def test_bit_packing_of_a_table(docs, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(bitpack, "SEGMENT_IDS", 3000)
    segments, read = packed(docs, bytes_each=20_000)
    assert segments.count() > 3
    start = 0
    got = {r.doc_id: r for r in read.withColumn("crc", F.crc32("ids")).collect()}
    for doc_id, text, *_ in sorted(rows):
        ids = [*ENCODE[NAMES[0]](text or ""), 2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.crc) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert bitpack.export(segments, str(tmp_path)) == segments.count() == len(list(tmp_path.iterdir()))


def test_bit_packing_of_nothing_and_odd_rows(none, odd):
    assert packed(none)[1].count() == 0
    got = packed(odd)[1].orderBy("start").collect()
    assert len(got) == odd.where("doc_id is not null").count()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


# Retrieval packing


def check_pieces(pieces, rows, window=1024):
    encode, end = ENCODE[NAMES[1]], [0]
    want = sorted((i, tuple([*encode(t or ""), *end])) for i, t in rows)
    by_sequence, by_document = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(len(t) for _, t in want) == sum(r.length for r in pieces)
    if len({i for i, _ in want}) == len(want):
        for doc_id, ids in want:
            parts = sorted(by_document[doc_id, len(ids)])
            assert [s for s, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
            assert tuple(x for _, p in parts for x in p) == ids
    return by_sequence


def test_packing_of_a_table(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 8000)
    pieces = packing.pack(docs, public_tokenizers.path(NAMES[1]), bytes_each=50_000).collect()
    sequences = check_pieces(pieces, [(r[0], r[1]) for r in rows])
    short = [s for s, parts in sequences.items() if sum(r.length for r in parts) < 1024]
    assert len(short) == len({s // packing.SEQUENCES_A_SHARD for s in short})  # the last of a shard at most


def test_packing_of_nothing_and_odd_rows(none, odd):
    assert packing.pack(none, public_tokenizers.path(NAMES[1])).count() == 0
    known = odd.where("doc_id is not null")
    check_pieces(packing.pack(odd, public_tokenizers.path(NAMES[1])).collect(), [(r.doc_id, r.text) for r in known.collect()])


def test_index_scores_are_bm25():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(25)]
    index, n = packing.Index(pieces), len(pieces)
    mean = sum(map(len, pieces)) / n
    df = Counter(t for p in pieces for t in set(p.tolist()))
    for q in range(n):
        got = index.scores(q)
        for d, p in enumerate(pieces):
            tf, want = Counter(p.tolist()), 0.0
            for t in set(pieces[q].tolist()):
                idf = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
                want += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(p) / mean))
            assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_neighbours_share_windows():
    """Texts of two kinds, mixed: windows keep to one kind while it lasts."""
    rng = np.random.default_rng(6)
    docs = [(i, rng.integers(0, 200, 100).astype("<u2") + 300 * (i % 2)) for i in range(40)]
    alone = 0
    for sequence in packing.pack_shard(docs, 1000):
        kinds = {doc_id % 2 for doc_id, *_ in sequence}
        alone += len(kinds) == 1
    assert alone == 4


# LM scores


def brute_scores(rows, order=3, least=2, discount=0.4):
    texts = [(i, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()) for i, t in rows]
    counts = Counter(tuple(w[i : i + k]) for _, w in texts for k in range(1, order + 1) for i in range(len(w) - k + 1))
    words = sum(len(w) for _, w in texts)
    out = {}
    for doc_id, w in texts:
        total = 0.0
        for i in range(len(w)):
            most = min(i + 1, order)
            for k in range(most, 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1 or counts[gram] >= least:
                    total += math.log(counts[gram] / (counts[gram[:-1]] if k > 1 else words)) + (most - k) * math.log(discount)
                    break
        out[doc_id] = (len(w), total)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_brute_force(docs, rows, order):
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scoring.scores(docs, order, bytes_each=15_000).collect()}
    want = brute_scores([(r[0], r[1]) for r in rows], order)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_scores_of_nothing_and_odd_rows(none, odd):
    assert lm_scoring.scores(none).count() == 0
    assert lm_scoring.scores(odd).count() == odd.count()


# Archive


def page_rows():
    rng = random.Random(2)
    html = [f"<p>{rng.random()}</p>" * rng.randrange(1, 50) for _ in range(12)] + ["", None, "ünïcode 漢字 🙂", "x" * 200_000]
    return [(i * 7 % 61, f"https://h{i % 3}/p{i}", html[(i * i) % len(html)]) for i in range(60)]


def expected(pages):
    first = {}
    for i, _, t in pages:
        first[t or ""] = min(first.get(t or "", i), i)
    out = {}
    for i, _, t in pages:
        data = (t or "").encode()
        f = first[t or ""]
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    return out


def test_archive(spark):
    pages = page_rows()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archive = warc.write_archive(df)
    assert archive.payloads.count() == len({t or "" for _, _, t in pages})
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(archive).collect()}
    assert got == expected(pages)
    heads = {r.page_id: bytes(r["head"]) for r in archive.headers.collect()}
    for r in warc.read_responses(archive).collect():
        text = next(t for i, _, t in pages if i == r.page_id)
        assert bytes(r.record) == heads[r.page_id] + (text or "").encode() + b"\r\n\r\n"
        fields = dict(x.split(": ", 1) for x in heads[r.page_id].split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(bytes(r.record)) - heads[r.page_id].index(b"\r\n\r\n") - 8


def test_archive_small_payloads_and_damage(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, None, "long enough"), (4, "a\r\nWARC-Type: x", "long enough")], "page_id long, url string, html string")
    archive = warc.write_archive(df, least_bytes=5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archive(archive).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    bad = warc.Archive(archive.payloads.withColumn("digest", F.expr("unhex(sha2(digest, 256))")), archive.headers.withColumn("digest", F.expr("unhex(sha2(digest, 256))")))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_responses(bad).collect()


def test_archive_of_nothing_and_odd_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(empty)).count() == 0
    odd = spark.createDataFrame([(1, "u", "a", 5), (1, "u", "a", 5), (2, "u", "a", 5), (2, "u", "b", 6)], "page_id long, url string, html string, digest long")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(warc.write_archive(odd)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "response", None), (2, "revisit", 1)]
