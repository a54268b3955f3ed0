"""Quality rules, line templates, string tiling, n-gram join."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import graph, line_templates, ngram_join, quality_rules, shingles, string_tiling

WORD = re.compile(r"[^ \t-\r]+")


def plain_words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# Quality rules


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality_rules.annotate(docs).select("doc_id", "text", "quality.*").collect()}
    assert len(got) == docs.count()
    for r in got.values():
        n, chars, symbols, dup, repeat = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.doc_id
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_is_one_projection(docs, none, odd):
    plan = quality_rules.annotate(none)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert quality_rules.annotate(none).count() == 0
    assert quality_rules.annotate(odd).count() == odd.count()
    assert set(quality_rules.annotate(odd, into="quality").columns) == set(odd.columns)


# Words and shingles


def test_word_hashes_follow_words():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aAbB \t\n\x0b.é漢") for _ in range(rng.randrange(0, 40)))
        a = shingles.PLAIN.hashes(text.encode())
        want = plain_words(text)
        assert len(a) == len(want)
        seen = {}
        for h, w in zip(a.tolist(), want, strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    both = shingles.PLAIN.hashes(b"left x left"), shingles.PLAIN.hashes(b"left")
    assert both[0][0] == both[0][2] == both[1][0] != both[0][1]


# N-gram join


def brute_sets(text, k=5):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_join(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, **options)[0].collect()}
    assert got == brute_components(rows)


def test_join_matches_brute_force(spark, rows):
    check_join(spark, [(r[0], r[1]) for r in rows])


def test_join_of_chains_and_crowds(spark, monkeypatch):
    """Chains of edits, a crowd of near copies, and a passage that many texts share; tiles smaller than the crowd."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    texts, chain = [], list(base)
    for i in range(12):
        chain = list(chain)
        chain[(7 * i) % 80] = f"c{i}"
        texts.append(" ".join(chain))
    for i in range(30):
        own = list(base)
        own[rng.randrange(80)] = f"n{i}"
        texts.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(40))
    for i in range(30):
        texts.append(passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(rng.randrange(4, 14))))
    monkeypatch.setattr(ngram_join, "HOT", 10)
    check_join(spark, [(i * 5 + 2, t) for i, t in enumerate(texts)], tile=7)
    check_join(spark, [(i * 5 + 2, t) for i, t in enumerate(texts)], tile=7, dense=0)


@pytest.mark.parametrize("dense", [0, 1])
def test_join_gives_rows_by_points(spark, dense):
    """Texts that differ in one block each meet in the same trees; links are found in the tile or after it."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(70):
        own, at = list(base), rng.randrange(0, 110)
        own[at : at + 4 + i % 3] = [f"x{i}.{k}" for k in range(4 + i % 3)]
        texts.append(" ".join(own))
        if i % 4 == 0:
            texts.append(" ".join([*own[:-1], "end"]))
    check_join(spark, list(enumerate(texts)), dense=dense, tile=50)


def test_join_of_repeated_ids(spark):
    """One id with several texts is one node; other documents' links don't suffer from it."""
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    bases = [text(90) for _ in range(6)]
    rows = []
    for i, b in enumerate(bases):
        for k in range(4):
            own = list(b)
            own[rng.randrange(90)] = f"n{i}.{k}"
            rows.append((10 * i + k, " ".join(own)))
    rows += [(3, rows[12][1]), (3, " ".join(text(30))), (41, rows[0][1]), (9, rows[21][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.join(df)[0].collect()}
    want = brute_components([((d, i), t) for i, (d, t) in enumerate(rows)])
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (d, _), (_, (e, _)) in want.items():
        x, y = sorted((find(d), find(e)))
        root[y] = x
    assert got == {d: find(d) for d in root} and len(set(got.values())) < len(got) - 8


def test_large_counts_stay_bounds():
    """Counts above a byte's room: what they leave out is part of the bound."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 90_000, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.sort(np.concatenate((sets[0][:80_000], sets[1][:8_000]))))
    points, sizes = np.array([ngram_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    got = {tuple(sorted((int(order[p]), int(order[q])))) for ps, qs in ngram_join.RTree(points[order], sizes[order]).pairs(80) for p, q in zip(ps, qs, strict=True)}
    assert points.max() == 255 and (0, 2) in got


def test_hashes_of_long_texts_and_long_words():
    rng = np.random.default_rng(0)
    text = np.where(rng.random(5 * shingles.BLOCK) < 0.1, 32, rng.integers(97, 123, 5 * shingles.BLOCK)).astype(np.uint8).tobytes()
    text = text[:200_000] + b"y" * (2 * shingles.BLOCK + 5) + b" " + text[200_000:]
    whole = shingles.PLAIN.hashes(text)
    words = text.split()
    assert len(whole) == len(words)
    for k in (0, 1, 77, len(words) // 2, len(words) - 1, max(range(len(words)), key=lambda i: len(words[i]))):
        assert shingles.PLAIN.hashes(words[k])[0] == whole[k]


def test_join_of_nothing_and_odd_rows(none, odd):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.near_duplicates(odd).count() == odd.where("doc_id is not null").count()


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.uint8)
    points[100:200] = points[:100]
    points[100:200, 5] += 1
    sizes = points.sum(axis=1, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    tree = ngram_join.RTree(points[order], sizes[order])
    got = {tuple(sorted((int(order[p]), int(order[q])))) for ps, qs in tree.pairs(80) for p, q in zip(ps, qs, strict=True)}
    want = set()
    for a, b in itertools.combinations(range(300), 2):
        most = int(np.minimum(points[a], points[b]).sum(dtype=np.int64))
        if 100 * most >= 80 * (sizes[a] + sizes[b] - most):
            want.add((a, b))
    assert got == want and len(want) >= 100


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(20)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert graph.components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


# Line templates


def brute_lines(rows, by_sentence=True):
    """text, n_lines, n_dropped and n_cut of each document, unit by unit in plain Python."""

    def tokens(unit):
        raw = [w for w in re.split(r"[ \t-\r]+", unit) if w]
        general = ["<*>" if re.search("[0-9]", w) else w for w in raw]
        constant = sum(w != "<*>" for w in general)
        return [] if not constant else general if 2 * constant >= len(raw) else raw

    def cut(line):
        return [x for x in re.sub(r"([.!?][ \t-\r]+)", "\\1\0", line).split("\0") if x]

    def whole(line):
        t = tokens(line)
        found = {(len(t), None, tuple(t))} if t else set()
        if len(t) >= 8:
            at = [2 + (len(t) - 2) * k // 4 for k in range(5)]
            found |= {(len(t), k, tuple(t[: at[k]] + ["<*>"] + t[at[k + 1] :])) for k in range(4)}
        return found

    def part(sentence):
        t = tokens(sentence)
        return {(len(t), None, tuple(t))} if by_sentence and len(t) >= 8 else set()

    owners = {}
    for i, text in rows:
        for line in [] if text is None else text.split("\n"):
            for leaf in whole(line).union(*(part(x) for x in cut(line) if len(cut(line)) > 1)):
                owners.setdefault(leaf, set()).add(i)
    out = {}
    for i, text in rows:
        gone = lambda found, i=i: any(len(owners[f]) > 1 and min(owners[f]) != i for f in found)
        lines, kept, n_cut = [] if text is None else text.split("\n"), [], 0
        for line in lines:
            if gone(whole(line)):
                continue
            parts = cut(line)
            stay = [x for x in parts if not gone(part(x))] if len(parts) > 1 else parts
            if len(stay) == len(parts):
                kept.append(line)
            elif stay:
                kept.append("".join(stay))
                n_cut += len(parts) - len(stay)
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept), n_cut)
    return out


def test_lines_match_brute_force(docs, rows):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.n_cut) for r in line_templates.drop_recurring(docs).collect()}
    assert got == brute_lines([(r[0], r[1]) for r in rows])


def test_variable_fields_are_generalised(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    texts = ["user 17 logged in from host a7", long, "user 99 logged in from host b4", long.replace("lambda", "other"), "user 99 logged out at noon today", "a clean line that stands alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(df, least_documents=3).collect()} == dict.fromkeys(range(6), 0)


def test_short_lines_and_passages_within_lines(spark):
    """Lines of a word or more recur, numbers alone don't; a passage goes from the middle of other lines."""
    passage = "The first of these sentences is long enough to count. The second of them, too, has its nine words or so. "
    texts = [
        "Accept all cookies\n42\n12 13 14 x",
        "Accept all cookies\nits own line\n42",
        "Before it stands something. " + passage + "And behind it something else.",
        passage + "Quite another end.",
        passage.strip(),
        "Short one. Short two. Own words here.",
        "Short one. Short two. Other words there.\n15 16 17 x",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.n_cut) for r in line_templates.drop_recurring(df).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    whole = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.n_cut) for r in line_templates.drop_recurring(df, least_sentence=None).collect()}
    assert whole == brute_lines(list(enumerate(texts)), by_sentence=False) and whole[3][0] == texts[3]
    assert got[1] == ("its own line\n42", 3, 1, 0) and got[2][0] == texts[2] and got[3] == ("Quite another end.", 1, 0, 2)
    assert got[4] == ("", 1, 1, 0) and got[5][0] == texts[5] and got[6][0] == texts[6]


def test_long_lines_without_digits_are_parsed_in_linear_time():
    assert len(line_templates.leaves(b"x" * 3_000_000 + b" 1")) == 1
    assert len(line_templates.leaves(b"word and others. " * 100_000)) == 5


def test_lines_of_nothing_and_odd_rows(none, odd):
    assert line_templates.drop_recurring(none).count() == 0
    out = line_templates.drop_recurring(odd)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)


# String tiling


def brute_tiles(p, t, least):
    """Greedy string tiling as first described: all maximal matches again in each round."""
    marked_p, marked_t, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not marked_p[i + n] and not marked_t[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        for i, j in found:
            if not any(marked_p[i : i + best]) and not any(marked_t[j : j + best]):
                marked_p[i : i + best] = [True] * best
                marked_t[j : j + best] = [True] * best
                tiles.append((i, j, best))
        if not found:
            return tiles


def test_tiling_matches_brute_force():
    """The same tiles, one by one, ties included."""
    rng = random.Random(6)
    for round_ in range(250):
        letters = "ab" if round_ % 5 == 0 else "abcd"
        p = [rng.choice(letters) for _ in range(rng.randrange(4, 30))]
        t = [rng.choice(letters) for _ in range(rng.randrange(4, 40))]
        known = {}
        code = lambda w, known=known: known.setdefault(tuple(w), len(known) + 1)
        item = np.array([code(p[i : i + 3]) for i in range(len(p) - 2)])
        at = [j for j in range(len(t) - 2) if tuple(t[j : j + 3]) in known]
        got = string_tiling.tiles(item, np.array([code(t[j : j + 3]) for j in at], np.int64), np.array(at, np.int64), 3)
        assert sorted(got) == sorted(brute_tiles(p, t, 3)), (p, t)


def brute_leaks(docs, bench, least=5, share=0.5):
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^ \t-\r!-/:-@\[-`{-~]+", t or "")]
    found = []
    for d, text in docs:
        for i, item in bench:
            t, p = words(text), words(item)
            if p:
                n = min(least, len(p))
                tiles = brute_tiles(p, t, n)
                covered = sum(x[2] for x in tiles)
                if covered >= share * len(p):
                    found.append((d, i, len(tiles), covered, len(p)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_match_brute_force(spark, monkeypatch, broadcast):
    """Moved, repeated and overlapping passages, equal rows and repeated ids, by either join."""
    if not broadcast:
        monkeypatch.setattr(string_tiling, "MOST_BROADCAST", 0)
    rng = random.Random(12)
    word = lambda k=60: f"W{rng.randrange(k)}"
    bench = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(12)]
    bench += [(3, bench[3][1]), (5, "one two, three"), (None, bench[2][1]), (13, "aa aa aa aa aa aa aa aa"), (14, None), (15, " . ")]
    docs = []
    for i in range(30):
        parts = [word(1000) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            own = rng.choice(bench[:12])[1].split()
            a = rng.randrange(len(own))
            parts[rng.randrange(len(parts) + 1) : 0] = own[a : a + rng.randrange(1, 40)]
        docs.append((i, " ".join(parts)))
    docs += [(4, docs[4][1]), (4, bench[7][1]), (None, bench[8][1] + "!"), (40, "AA, " * 30), (41, "x one TWO three"), (42, None), (43, "")]
    got = string_tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = brute_leaks(docs, bench)
    assert sorted(((r.doc_id, r.item_id, r.n_tiles, r.covered_words, r.item_words) for r in got), key=repr) == want and len(want) >= 15


def test_texts_of_one_repeated_word(spark):
    """Places meet as seeds, not pair by pair."""
    docs = spark.createDataFrame([(1, "the " * 200_000), (2, "of the the the the the")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "the " * 300)], "item_id long, text string")
    got = [(r.doc_id, r.covered_words) for r in string_tiling.leaks(docs, bench).collect()]
    assert got == [(1, 300)]


def test_leaks(spark):
    item = [f"b{i}" for i in range(30)]
    other = [f"o{i}" for i in range(100)]
    texts = {
        1: " ".join(other[:20] + item + other[20:]),
        2: " ".join(item[20:] + other[:5] + item[:10] + other[5:9] + item[10:20]),  # moved about
        3: " ".join(w.upper() + "," for w in item),
        4: " ".join(other + item[:10]),  # a third of the item
        5: " ".join(x for p in zip(item, other, strict=False) for x in p),  # every word, no run
        6: None,
        7: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "b0 b1 b2"), (11, None), (12, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.covered_words) for r in string_tiling.leaks(docs, bench).collect()}
    assert got == {(1, 9): (1, 30), (2, 9): (3, 30), (3, 9): (1, 30), **{(d, 10): (1, 3) for d in (1, 2, 3, 4)}}


def test_leaks_of_nothing_and_odd_rows(spark, none, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert string_tiling.leaks(none, empty).count() == string_tiling.leaks(odd, empty).count() == 0
    bench = odd.selectExpr("doc_id as item_id", "text", "score")
    assert string_tiling.leaks(none, bench).count() == 0
    assert string_tiling.leaks(odd, bench).where(F.col("doc_id") == F.col("item_id")).count() > 0
