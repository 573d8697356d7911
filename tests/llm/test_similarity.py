"""Jaccard join, exact search, components and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnout.llm import jaccard, recompression, topk, wordhash
from turnout.llm.components import components


def words(text):
    return (text or "").encode().split()


def brute_components(rows, size, percent):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, text in rows:
        w = words(fold(text))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), None if k is None else least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(r, base, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def near_rows(seed):
    r = random.Random(seed)
    rows = []
    for f in range(6):
        base = [f"W{r.randrange(60)}" for _ in range(r.choice([4, 12, 40, 90]))]
        rows += [" ".join(base)] * r.randrange(1, 4) + [family(r, base, r.randrange(5)) for _ in range(12)]
    common = " ".join(f"w{i}" for i in range(15))
    rows += [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(12))) for _ in range(40)]
    rows += [None, "", "  ", "one", "ONE", "one two", "One Two"]
    r.shuffle(rows)
    return [(i * 3 % 97 if i % 9 else i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, None)]


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_jaccard_join_matches_all_pairs(spark, size, percent, seed):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(3)
    out = jaccard.jaccard_join(docs, size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(rows, size, percent)


def test_groups_of_one_prefix_are_expanded(spark):
    """Sets that differ only behind a common prefix: one group, whose members are verified one by one."""
    r = random.Random(4)
    rows = []
    for k in range(60):
        tail = [f"t{r.randrange(3)}-{i}" for i in range(8)]
        rows.append((k, " ".join([f"b{i}" for i in range(60)] + tail)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_join(docs, 1, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(rows, 1, 85)


def test_jaccard_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(docs).collect() == [] and jaccard.without_near_copies(docs).collect() == []


def test_one_of_each_component_stays(spark):
    rows = near_rows(5)
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, class string")
    kept = jaccard.without_near_copies(docs, 3, 90)
    comps = brute_components(rows, 3, 90)
    want = Counter()
    for k, n, c in comps:
        if k is None or n == 0:
            want[k] += 1
    for c in {(c) for k, n, c in comps if k is not None and n}:
        want[c] += 1
    assert kept.columns == docs.columns
    assert len(kept.collect()) >= sum(want.values())  # ids that repeat with other texts can head several components
    assert {r.doc_id for r in kept.collect()} == set(want)


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(0)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (201, 202), (202, 203), (203, 201)]
    links += [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(160)]
    root = {n: n for e in links for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: find(n) for n in root if n != 200 and any(n in e and e[0] != e[1] for e in links)} == out
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_top(rows, wanted, k):
    out = []
    sound = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and sound(v)]
    for q in sorted({i for i, _ in whole if i in wanted}):
        vector = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 2e6])
def test_top_k_matches_all_scores(spark, scale):
    r = random.Random(6)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.gauss(0, 1)]) * scale for _ in range(r.choice([4, 6]))]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [float("inf"), 1.0]), (304, []), (None, [1.0]), (5, [0.5]), (5, [0.5])]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    wanted = {i for i, _ in rows if i is not None and i % 5 == 0}
    out = topk.top_k(table.where("vec_id % 5 = 0"), table, 7, block_rows=30, block_queries=8).collect()
    assert sorted(tuple(x) for x in out) == brute_top(rows, wanted, 7)


def test_top_k_shuffles_names_and_deals_both_sides(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = topk.top_k(table.where("vec_id % 2 = 0"), table, 3, block_rows=20, block_queries=50, slices_a_task=2)
    assert sorted(tuple(x) for x in out.collect()) == brute_top(rows, {i for i, _ in rows if i % 2 == 0}, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert scan and all("vector" not in line for line in scan)


def test_top_k_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(table.where("vec_id = 0"), table).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(table.limit(0), table).collect() == [] and topk.top_k(table, table.limit(0)).collect() == []


def brute_removed(rows, length):
    first = {}
    for k, text in rows:
        if k is not None:
            w = words(text)
            for i in range(len(w) - length + 1):
                key = tuple(w[i:i + length])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            if k is not None and first[tuple(w[i:i + length])] < k:
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows(seed, letters):
    r = random.Random(seed)
    passages = [[r.choice(letters) for _ in range(r.randrange(8, 40))] for _ in range(8)] + [["x"] * 60, ["x", "y"] * 30]
    rows = []
    for k in range(70):
        parts = [r.choice([r.choice(passages), [r.choice(letters) for _ in range(r.randrange(25))], [f"u{r.randrange(10**6)}"] * r.randrange(3)]) for _ in range(r.randrange(6))]
        rows.append((k, r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(70 + i, rows[i][1]) for i in range(6)] + [(3, rows[9][1]), (4, rows[4][1]), (None, rows[5][1]), (80, None), (81, ""), (82, " " + rows[6][1] + "\n")]
    return rows


@pytest.mark.parametrize("length, letters, seed", [(12, "abcdefgh", 1), (20, "ab", 2), (9, [f"w{i}" for i in range(400)], 3), (50, "abc", 4)])
def test_repeats_match_all_windows(spark, length, letters, seed):
    rows = repeat_rows(seed, letters)
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_words int").repartition(3)
    out = recompression.word_digests(docs, length).collect()
    assert sorted((tuple(x) for x in out), key=repr) == brute_removed(rows, length)


def test_cut_texts_keep_the_rest_as_it_was(spark):
    rows = [(1, "A b\tc d  e f"), (2, "x\n\nb\tc d  y  z"), (3, "b c d q"), (4, "A b\tc d  e f"), (5, None), (6, "p  b c d"), (7, " n ")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, starts string")
    out = recompression.without_repeats(docs, 3)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "A b\tc d  e f", 2: "x\n\ny  z", 3: "q", 5: None, 6: "p", 7: " n "}
    assert recompression.without_repeats(docs.limit(0), 3).collect() == [] and recompression.word_digests(docs.limit(0)).collect() == []


@pytest.mark.parametrize("letters", [2, 5, 1000])
def test_equal_windows_have_equal_keys_wherever_they_stand(letters):
    r = np.random.default_rng(letters)
    text = wordhash.mix(r.integers(0, letters, 4000).astype(np.uint64))
    bounds = np.array([0, 4000])
    starts, keys = recompression.window_keys(text, bounds, 50)
    for at in r.integers(0, 3900, 60).tolist():
        own = text[at:at + 50]
        for left, right in ((0, 0), (7, 30), (90, 1)):
            around = np.concatenate([wordhash.mix(r.integers(0, letters, left).astype(np.uint64)), own, wordhash.mix(r.integers(0, letters, right).astype(np.uint64))])
            s, k = recompression.window_keys(around, np.array([0, len(around)]), 50)
            assert k[s.tolist().index(left)] == keys[at]
    assert len(starts) == 3951 and (letters < 1000 or len(np.unique(keys)) < 600)


def test_runs_and_pairs_shrink_the_text():
    text = wordhash.mix(np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64))
    levels = recompression.recompress(text, np.array([0, 1000, 3000]))
    assert [len(a.name) > len(b.name) for a, b in zip(levels, levels[1:])] == [True] * recompression.ROUNDS
    for level in levels:
        assert (level.start[1:] == level.stop[:-1]).all() and (np.diff(level.low) >= 0).all() and (np.diff(level.high) >= 0).all()
    run = recompression.recompress(wordhash.mix(np.zeros(500, np.uint64)), np.array([0, 500]))
    assert len(run[1].name) == 1


def test_word_digests_depend_on_bytes_alone():
    import pyarrow as pa

    column = pa.array(["a bb", None, "", "bb\x0bA", "é z a"])
    found = wordhash.words_of(column)
    texts = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.stops, strict=True)]
    assert texts == ["a", "bb", "bb", "A", "é z", "a"] and found.bounds.tolist() == [0, 2, 2, 2, 4, 6]
    assert found.digests[1] == found.digests[2] and found.digests[0] == found.digests[5] and len(set(found.digests.tolist())) == 4
    folded = wordhash.words_of(column.slice(3), fold=True)
    assert folded.digests[1] == found.digests[0]


def alternating(turns):
    """A pattern over 0 and 1, and its complement, that collide under a polynomial modulo 2^64 whatever its odd base."""
    pattern = np.zeros(1, int)
    for _ in range(turns):
        pattern = np.r_[pattern, 1 - pattern]
    return pattern, 1 - pattern


@pytest.mark.parametrize("letters", [("a", "b"), ("a", "B"), ("é", "ü")])
def test_words_of_alternating_letters_stay_apart(spark, letters):
    for turns in (10, 11, 12):
        one, other = ("".join(letters[k] for k in p) for p in alternating(turns))
        assert len(set(wordhash.words_of(pa.array([one, other])).digests.tolist())) == 2
        rest = " ".join(f"w{i}" for i in range(49))
        docs = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"x y {one}"), (4, f"x y {other}")], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in recompression.word_digests(docs.where("doc_id < 3")).collect()} == {1: 0, 2: 0}
        linked = jaccard.jaccard_join(docs.where("doc_id > 2"), words=3, percent=90).collect()
        assert {r.doc_id: r.component_id for r in linked} == {3: 3, 4: 4}


def test_runs_of_alternating_words_stay_apart(spark):
    one, other = (" ".join(("left", "right")[k] for k in p) for p in alternating(11))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.word_digests(docs, 2048).collect()} == {1: 0, 2: 0}
    linked = jaccard.jaccard_join(docs, words=2048, percent=90).collect()
    assert {r.doc_id: r.component_id for r in linked} == {1: 1, 2: 2}
    for base in (0, 1):
        digests = wordhash.words_of(pa.array([f"{one} {other}"])).digests
        rolled = wordhash.windows(digests, 2048, base)
        assert rolled[0] != rolled[2048] and wordhash.windows(digests[700:2748], 2048, base)[0] == rolled[700]


def test_products_modulo_the_prime():
    prime = (1 << 61) - 1
    edge = [0, 1, 2, (1 << 31) - 1, 1 << 31, (1 << 60) + 5, prime - 1]
    a, b = (np.array(v, np.uint64) for v in zip(*[(x, y) for x in edge for y in edge], strict=True))
    assert wordhash._times(a, b).tolist() == [x * y % prime for x in edge for y in edge]


def test_grouped_places():
    for top in (3, 1 << 20, 1 << 60):
        codes = np.random.default_rng(top % 97).integers(0, top, 500)
        codes = np.r_[codes, codes[:100]]
        first, count, inverse = wordhash.grouped(codes)
        want, at, back, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        assert (first == at).all() and (count == n).all() and (inverse == back).all() and (wordhash.distinct(codes) == want).all()
    assert all(len(x) == 0 for x in wordhash.grouped(np.zeros(0, np.int64)))
