"""Quality classifier: a linear support vector machine on indicators scaled by naive Bayes log-count ratios.

Indicators say which n-grams a text has: three neighbouring bytes, one and two words, and one to three word marks.  A mark says of
what kinds of characters a word is made and how far back the same word stood last, so shouting, symbols and repetition show in words never seen before.  n-grams are hashed
to ``FEATURE_BITS`` bits, which bounds everything that is held or shipped.

1. Log-count ratios come from all labelled rows: Spark sums, per feature and class, the texts that have it.
2. The machine minimises hinge loss by dual coordinate descent over unit-length rows of scaled indicators.  It is fitted on the ``SAMPLE`` labelled rows with
   the smallest hashes (a documented bound; fewer if their features pass ``SAMPLE_FEATURES``), so the same rows are picked whatever executor reads them.
3. Margins become scores by a logistic curve fitted to margins of rows that neither the ratios nor the machine had seen: rows fall into folds by
   their hash, and each fold is judged with the other folds' counts and weights.
4. Scoring is one pass over the texts with the folded weights, a table of fixed size.

Defined cases: a null text is empty, an empty text has no indicators and gets the score of the bias; texts are read whole, one at a time if long;
repeated rows are scored alike, and identical labelled rows are one row of the sample; of several labels of an id the majority counts, ties for 1; null labels and labels of null
ids teach nothing; without labels of both classes every score is the smoothed share of label 1; empty tables give no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.files import ship, written
from turnout.llm.wordhash import BASE, blocks, distinct, mix, words_of

FEATURE_BITS, SAMPLE, SAMPLE_FEATURES, FOLDS = 18, 8000, 1 << 24, 3
#: Kinds of characters: lower case and beyond ASCII, capitals, digits, sentence punctuation, anything else.
_KIND = np.full(256, 16, np.uint8)
_KIND[128:] = 1
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 4
_KIND[np.frombuffer(b".,;:!?'\"-()", np.uint8)] = 8
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def word_marks(digests: np.ndarray, kinds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Kinds of a word's characters with the bit length of the distance to the same word before it in the text, up to 7; 0 without one."""
    order = np.lexsort((np.arange(len(digests)), digests, text))
    again = (digests[order][1:] == digests[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.zeros(len(digests), np.int64)
    back[order[1:][again]] = np.diff(order)[again]
    steps = np.where(back > 0, np.minimum(np.floor(np.log2(np.maximum(back, 1))) + 1, 7), 0)
    return kinds.astype(np.uint64) * np.uint64(8) + steps.astype(np.uint64)


def indicators(texts: pa.Array, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's features begin, and the distinct features of each text in order."""
    words = words_of(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    offsets = offsets - offsets[0]
    data = words.data.astype(np.uint64)
    found: list[np.ndarray] = []
    wide = np.uint32 if len(texts).bit_length() + bits <= 32 else np.uint64

    def add(text: np.ndarray, values: np.ndarray, kind: int) -> None:
        hashed = mix(values * np.uint64(BASE) + np.uint64(kind)) >> np.uint64(64 - bits)
        found.append(distinct((text << bits).astype(wide) | hashed.astype(wide)))

    def grams(values: np.ndarray, text: np.ndarray, n: int, kind: int) -> None:
        if len(values) < n:
            return
        total = values[:len(values) - n + 1]
        for j in range(1, n):
            total = mix(total + np.uint64(1)) + values[j:len(values) - n + 1 + j]
        inside = text[n - 1:] == text[:len(text) - n + 1]
        add(text[:len(text) - n + 1][inside], total[inside], kind)

    if len(data) > 2:
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        inside = text[2:] == text[:-2]
        add(text[:-2][inside], (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:])[inside], 1)
    if len(words.starts):
        text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        kinds = np.bitwise_or.reduceat(_KIND[words.data], words.starts)
        for n in (1, 2):
            grams(words.digests, text, n, 1 + n)
        marks = word_marks(words.digests, kinds, text)
        for n in (1, 2, 3):
            grams(marks, text, n, 3 + n)
    keys = distinct(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
    return np.searchsorted(keys, np.arange(len(texts) + 1) << bits), (keys & (1 << bits) - 1).astype(np.int32)


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """Of the counts of texts by class (1, then 0) and feature: log of the smoothed shares' ratio."""
    smooth = counts + 1.0
    shares = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(shares[0] / shares[1])


def scaled(bounds: np.ndarray, features: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Indicators times ratios, every row at unit length."""
    values = ratios[features]
    sizes = np.diff(bounds)
    squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), values * values, len(sizes))
    return values / np.repeat(np.sqrt(np.maximum(squares, 1e-12)), sizes)


def dual_coordinate_descent(bounds: np.ndarray, features: np.ndarray, values: np.ndarray, sign: np.ndarray, size: int, cost: float = 1.0,
                            rounds: int = 20, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the bias last) and dual variables of the hinge-loss machine.

    One dual variable is optimised at a time, in a random order that is the same in every run, until no projected gradient of a round passes ``gap``.
    """
    weights, alpha, rng = np.zeros(size + 1), np.zeros(len(sign)), np.random.default_rng(7)
    rows = [(features[a:b], values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    diagonal = [float(v @ v) + 1.0 for _, v in rows]
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = sign[i] * (weights[at] @ x + weights[size]) - 1.0
            kept = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            worst = max(worst, abs(kept))
            if abs(kept) > 1e-9:
                new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
                step, alpha[i] = (new - alpha[i]) * sign[i], new
                weights[at] += step * x
                weights[size] += step
        if worst < gap:
            break
    return weights, alpha


def margins(bounds: np.ndarray, features: np.ndarray, ratios: np.ndarray, weights: np.ndarray) -> np.ndarray:
    values, sizes = scaled(bounds, features, ratios), np.diff(bounds)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), values * weights[features], len(sizes)) + weights[-1]


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 by margin, by Newton steps on smoothed targets; the slope is positive."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        first = np.array([((p - target) * margin).sum(), (p - target).sum()])
        bend = p * (1 - p) + 1e-12
        second = np.array([[(bend * margin * margin).sum() + 1e-9, (bend * margin).sum()], [(bend * margin).sum(), bend.sum() + 1e-9]])
        step, size, now = np.linalg.solve(second, first), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-9:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    """Ratios, weights with the bias last, and the curve from margins to scores; without ratios every score is ``prior``."""

    prior: float
    ratios: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), self.prior)
        margin = margins(*indicators(texts.fill_null("")), self.ratios, self.weights)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def class_counts(labelled: DataFrame) -> np.ndarray:
    """Texts by fold, class (1, then 0) and feature, over all rows of (text, label, fold); summed within tasks, then by Spark."""
    size = 1 << FEATURE_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * 2 * size, np.int64)
        for batch in batches:
            group = batch.column("fold").to_numpy() * 2 + (1 - batch.column("label").to_numpy())
            for start, stop, part in blocks(batch.column("text")):
                bounds, features = indicators(part)
                total += np.bincount(np.repeat(group[start:stop], np.diff(bounds)) * size + features, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    summed = labelled.select("text", "label", "fold").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    # At most one row for each fold, class and feature.
    rows = summed.toArrow()
    out = np.zeros(FOLDS * 2 * size, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(FOLDS, 2, size)


def _fitted(sample: DataFrame, counts: np.ndarray, cost: float) -> tuple[np.ndarray, float, float]:
    """Weights and curve from the sample, in one task: rows in the order of their hashes, folds judged by what they had no part in."""
    size = 1 << FEATURE_BITS

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(h, label, fold, features) for batch in batches for h, label, fold, features in zip(
            batch.column("hash").to_pylist(), batch.column("label").to_pylist(), batch.column("fold").to_pylist(),
            (np.frombuffer(f, np.int32) for f in batch.column("features").to_pylist()), strict=True)]
        parts.sort(key=lambda p: p[0])
        whole = np.cumsum([0, *(len(p[3]) for p in parts)])
        parts = parts[:max(1, int(np.searchsorted(whole, SAMPLE_FEATURES, side="right")) - 1)]
        label, fold = (np.array([p[c] for p in parts], np.int64) for c in (1, 2))
        sign = 2.0 * label - 1

        def flat(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = [parts[i][3] for i in chosen]
            return np.cumsum([0, *map(len, rows)]), np.concatenate([np.zeros(0, np.int32), *rows])

        seen = np.zeros(len(parts))
        judged = np.zeros(len(parts), bool)
        for k in range(FOLDS):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(test) and len(np.unique(label[train])) == 2:
                ratios = log_count_ratios(counts.sum(axis=0) - counts[k])
                bounds, features = flat(train)
                weights, _ = dual_coordinate_descent(bounds, features, scaled(bounds, features, ratios), sign[train], size, cost)
                seen[test], judged[test] = margins(*flat(test), ratios, weights), True
        ratios = log_count_ratios(counts.sum(axis=0))
        bounds, features = flat(np.arange(len(parts)))
        weights, _ = dual_coordinate_descent(bounds, features, scaled(bounds, features, ratios), sign, size, cost)
        slope, offset = logistic_curve(seen[judged], label[judged]) if judged.any() else (1.0, 0.0)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])], names=["weights", "slope", "offset"])

    row = sample.select("hash", "label", "fold", "features").repartition(1).mapInArrow(fit, "weights binary, slope double, offset double").first()
    return np.frombuffer(bytes(row.weights), np.float64), row.slope, row.offset


def fit(labelled: DataFrame, text: str = "text", label: str = "label", sample: int = SAMPLE, cost: float = 4.0) -> Model:
    """A model of label 1 from rows with a text and a label of 0 or 1."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("bigint").alias("label"))
    rows = written(rows.withColumn("hash", F.xxhash64("text", "label")).withColumn("fold", F.pmod("hash", F.lit(FOLDS))))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    if len(n) < 2:
        return Model(prior)
    counts = class_counts(rows)
    # Another mixing of the hash, so that the sample's order has nothing to do with the folds.
    order = F.xxhash64("hash", F.lit(1))
    last = rows.select(order.alias("o")).distinct().orderBy("o").limit(sample).agg(F.max("o")).first()[0]

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, part in blocks(batch.column("text")):
                bounds, features = indicators(part)
                kept = [features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column(c).slice(start, stop - start) for c in ("hash", "label", "fold")] + [pa.array(kept, pa.binary())],
                                      names=["hash", "label", "fold", "features"])

    chosen = rows.where(order <= last).select("hash", "label", "fold", "text").dropDuplicates(["hash"])
    weights, slope, offset = _fitted(chosen.select("hash", "label", "fold", "text").mapInArrow(featured, "hash bigint, label bigint, fold bigint, features binary"),
                                     counts, cost)
    return Model(prior, log_count_ratios(counts.sum(axis=0)), weights, slope, offset)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    ship(docs.sparkSession)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, part in blocks(batch.column("text")):
                yield pa.record_batch([batch.column("key").slice(start, stop - start), pa.array(model.scores(part))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, f"key {kind}, score double").select(F.col("key").alias(key), "score")


def majority_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, label) with one row an id: the majority of its labels of 0 or 1, ties for 1."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col(key).alias("key")).agg(F.when(F.avg(label) >= 0.5, 1).otherwise(0).alias("label"))


def held_out_by(key: Column | str, folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of an id's text falls into a fold that training leaves out; a null id does not."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) of every document, from a model of the labels outside the held-out fold."""
    taught = majority_labels(labels, key, label).where(~held_out_by("key"))
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    model = fit(plain.join(taught, "key").select("text", "label"))
    scored = score(plain, model, "key", "text")
    return scored.select(F.col("key").alias(key), held_out_by("key").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
