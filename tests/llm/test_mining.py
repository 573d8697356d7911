"""Phrase collocations, hard negatives and the quality classifier against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnout.llm import collocations, nbsvm, negatives
from turnout.llm.files import run_folder

# --- collocations ------------------------------------------------------------------------


def plain_counts(rows, longest):
    f = Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, k, " ".join(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return f


def plain_collocations(rows, threshold, longest, top, inside=50):
    f = plain_counts(rows, longest)
    n = Counter()
    for (lang, k, _), c in f.items():
        n[lang] += c if k == 1 else 0
    found = {key: c for key, c in f.items() if key[1] >= 2 and c >= threshold}
    out = []
    for (lang, k, phrase), a in found.items():
        w = phrase.split(" ")
        if any(l2 == lang and k2 > k and 100 * c >= inside * a and any(p.split(" ")[i:i + k] == w for i in range(k2 - k + 1)) for (l2, k2, p), c in found.items()):
            continue
        cuts = []
        for cut in range(1, k):
            left, right = f[lang, cut, " ".join(w[:cut])], f[lang, k - cut, " ".join(w[cut:])]
            cuts.append((1_000_000 * a * a // (left * right), cut, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, phrase, a, left, right, n[lang], score))
    result = []
    for lang in n:
        ranked = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(lang, i + 1, *r[1:]) for i, r in enumerate(ranked)]
    return sorted(result)


def phrase_rows():
    rng = random.Random(5)
    words = ["Aa", "bB", "c", "é", "ÉÉ", "d-d", "e'", "|", "f" * 300]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(rng.randrange(0, 60))),
             rng.choice(["en", "en", "de", None, ""])) for i in range(120)]
    rows += [(1000, "one hot line of words. " * 400, "en"), (1001, None, "en"), (1002, "", None), (None, "no id no id no id", "de"), (5, "no id no id", "de"), (5, "no id no id", "de")]
    return rows


@pytest.mark.parametrize(("shards", "longest", "threshold"), [(1, 3, 4), (3, 3, 4), (4, 4, 6)])
def test_collocations_match_plain_python(spark, shards, longest, threshold):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, c int")
    found = collocations.collocations(docs, threshold=threshold, longest=longest, top=40, shards=shards)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, threshold, longest, 40)


def test_phrase_counts_are_exact_even_if_all_slots_are_shared(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {(r.lang, r.k, r.phrase): r.c for r in collocations.phrase_counts(docs, threshold=5, longest=3, shards=2).collect() if r.k}
    assert counts == {k: c for k, c in plain_counts(rows, 3).items() if c >= 5}
    block = collocations.Occurrences(pa.array([t or "" for _, t, _ in rows]), pa.array([lang or "" for _, _, lang in rows]))
    # With every slot reached in scan 0, all phrases are active from scan 1 on, for as many scans as there are shards.
    everything = np.zeros(1 << collocations.SLOT_BITS, np.uint8)
    lengths = [{k for b in collocations.count_block(block, everything, scan, 2, 3) for k in b.column("k").to_pylist()} for scan in range(4)]
    assert lengths == [{0, 1}, {0, 1, 2, 3}, {2, 3}, set()]


def test_rows_that_are_summed_are_one_key_a_count_and_a_mark(spark):
    docs = spark.createDataFrame(phrase_rows(), "doc_id long, text string, lang string").na.fill("", ["text"]).na.fill("und", ["lang"])
    run = run_folder(spark, "test")
    spark.createDataFrame([], "slot int").write.parquet(f"{run}/reached-0")
    shard = collocations.scan_shard(docs, run, 0, 3, 3)
    assert shard.columns == ["key", "c", "mark"]
    assert {r.mark >> 32 for r in shard.collect()} == {0, 1}


def test_phrases_and_languages_with_blanks_bad_bytes_and_long_words_are_told_apart(spark):
    rows = [(i, f"a b{' ' * (i % 3 + 1)}{'w' * 33} {'w' * 32}", lang) for i, lang in enumerate(["", " ", "\t", "b \ten", "en", "und", None] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {(r.lang, r.k, r.phrase): r.c for r in collocations.phrase_counts(docs, threshold=3, longest=4).collect() if r.k}
    assert counts == {k: c for k, c in plain_counts(rows, 4).items() if c >= 3}
    broken = docs.select("doc_id", "lang", F.expr("string(unhex('61E320E3'))").alias("text"))
    found = collocations.phrase_counts(broken, threshold=3).where("k = 2").select("lang", F.expr("hex(binary(phrase))"), "c")
    assert sorted(tuple(r) for r in found.collect()) == sorted((lang, "61E320E3", 6 if lang == "und" else 3) for lang in ["", " ", "\t", "b \ten", "en", "und"])


def test_digests_go_by_all_bytes_of_a_string_alone():
    words = ["", "a", "a\0", "b", "é", *("x" * n for n in range(1, 40)), *("x" * n + "y" for n in range(40))]
    found = collocations.digests(pa.array(words))
    assert len(set(found.tolist())) == len(words) and not set(found.tolist()) & set(collocations.digests(pa.array(words), 1).tolist())
    assert collocations.digests(pa.array(words[::-1]).slice(3, 50)).tolist() == found[::-1][3:53].tolist()
    assert len(collocations.digests(pa.array([], pa.string()))) == 0


def test_counted_agrees_however_codes_are_grouped():
    words = [f"w{i * i % 97}" for i in range(400)]
    block = collocations.Occurrences(pa.array([" ".join(words)]), pa.array(["en"]))
    for k in range(1, 4):
        at, count = block.counted(np.arange(len(words) - k + 1), k)
        expected = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        assert {tuple(words[i:i + k]): c for i, c in zip(at.tolist(), count.tolist(), strict=True)} == expected


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_scores_stay_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 4_000_000_000_000), ("en", "a", 1, 5_000_000_000_001), ("en", "b", 1, 7_000_000_000_003), ("en", "", 0, 10 ** 14)],
                                   "lang string, phrase string, k int, c long")
    original, collocations.phrase_counts = collocations.phrase_counts, lambda *_: counts
    try:
        row = collocations.collocations(counts).first()
    finally:
        collocations.phrase_counts = original
    assert row.score == 1_000_000 * 4_000_000_000_000 ** 2 // (5_000_000_000_001 * 7_000_000_000_003)


# --- hard negatives ----------------------------------------------------------------------


def plain_negatives(rows, every, positives, negatives_, low, high, scale=256):
    sound = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows
             if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in sound:
        if i % every == 0 and (i not in anchors or (v, lab) < anchors[i]):
            anchors[i] = (v, lab)
    out = []
    for a, (v, lab) in anchors.items():
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))  # noqa: B023, E731
        same = sorted((-score(w), i) for i, own, w in sound if own == lab and i != a)[:positives]
        other = sorted((-score(w), i) for i, own, w in sound if own != lab)
        for s, p in same:
            inside = [(i, -n) for n, i in other if low * -s <= 100 * -n <= high * -s][:negatives_]
            out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(inside)]
    return sorted(out)


def vector_rows():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.4) for _ in range(rng.choice([12, 12, 12, 9, 16]))], rng.randrange(4)) for i in range(300)]
    rows += [(300, None, 1), (301, [0.1, None], 1), (302, [float("nan")] * 12, 1), (303, [float("inf")] * 12, 2), (304, [0.2] * 12, None), (None, [0.2] * 12, 1),
             (305, [], 1), (310, [], 2), (306, [-3.0e4] * 12, 3), (307, [2.5e4] * 12, 0), (308, [0.5] * 12, 1), (309, [0.5] * 12, 1), (40, [0.0] * 12, 1)]
    return rows


@pytest.mark.parametrize(("slice_rows", "block_anchors"), [(64, 7), (8192, 1024)])
def test_hard_negatives_match_plain_python(spark, slice_rows, block_anchors):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, block string").repartition(5)
    found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, positives=3, negatives=4, slice_rows=slice_rows, block_anchors=block_anchors)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 10, 3, 4, 30, 90)


def test_hard_negatives_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("reach", [1, 3, 200, 70_000, 1 << 28])
def test_lookups_equal_products(reach):
    rng = np.random.default_rng(reach)
    for width in (0, 1, 8, 13, 64):
        candidates, anchors = rng.integers(-reach, reach, (50, width)), rng.integers(-reach, reach, (9, width))
        scores = negatives.lookup_scores(negatives.bit_planes(candidates), negatives.subset_sums(anchors))
        assert (scores == candidates @ anchors.T).all()


# --- quality classifier ------------------------------------------------------------------


def quality_rows(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randrange(5, 120))) + "."
        if i % 4 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join([word()] * 50)])
        rows.append((i, text, int(i % 4 != 0)))
    return rows


def test_quality_of_held_out_rows(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "en"), (None, "no id", "en"), (902, "A!! " * 60_000, "en"), (0, rows[0][1], "en")],
                                 "doc_id long, text string, label string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 0), (0, 1), (None, 1), (7, None)], "doc_id long, quality int")
    out = nbsvm.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) + 5
    from zlib import crc32
    for r in out:
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[0]) == 1 and by_id[900] == by_id[901] and max(by_id[902]) < 0.7
    again = nbsvm.quality_scores(docs.repartition(3), labels).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in out}


def test_held_out_labels_teach_nothing(spark):
    rows = quality_rows(160)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(nbsvm.held_out_by("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(nbsvm.quality_scores(docs, labels).collect()) == sorted(nbsvm.quality_scores(docs, turned).collect())


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (3, None)], "doc_id long, text string")
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in nbsvm.quality_scores(docs, ones).collect()} == {2 / 3}
    assert {r.score for r in nbsvm.quality_scores(docs, ones.where("false")).collect()} == {0.5}
    assert nbsvm.quality_scores(docs.where("false"), ones).collect() == []


def test_indicators_are_those_of_each_text_alone():
    texts = ["", "One two two one\n\nTWO ### x9", "é" * 50, "a", "ab", "the same the same", ""]
    bounds, features = nbsvm.indicators(pa.array(texts))
    for i, t in enumerate(texts):
        alone = nbsvm.indicators(pa.array([t]))[1].tolist()
        assert features[bounds[i]:bounds[i + 1]].tolist() == alone and len(set(alone)) == len(alone)
    sliced = nbsvm.indicators(pa.array(texts).slice(1, 3))
    assert sliced[1].tolist() == features[bounds[1]:bounds[4]].tolist()


def test_descent_reaches_the_optimum():
    """The duality gap is small, and no multiplier leaves its box."""
    rng = np.random.default_rng(2)
    dense = (rng.random((80, 30)) < 0.3) * 1.0
    sign = np.where(dense[:, 0] + dense[:, 1] + rng.normal(0, 0.3, 80) > 0.6, 1.0, -1.0)
    bounds = np.r_[0, np.cumsum((dense > 0).sum(axis=1))]
    features = np.nonzero(dense)[1].astype(np.int32)
    values = nbsvm.scaled(bounds, features, rng.normal(0, 2, 30))
    weights, alpha = nbsvm.dual_coordinate_descent(bounds, features, values, sign, 30, cost=2.0, rounds=2000, gap=1e-6)
    assert alpha.min() >= 0 and alpha.max() <= 2.0
    margin = np.array([weights[features[a:b]] @ values[a:b] + weights[-1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    primal = 0.5 * weights @ weights + 2.0 * np.maximum(0, 1 - sign * margin).sum()
    dual = alpha.sum() - 0.5 * weights @ weights
    assert primal - dual < 1e-3 * primal
