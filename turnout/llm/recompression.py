"""Substring dedup by recompression.

A text's words are symbols.  A round first names every run of one symbol, then every pair of a left and a right symbol (a bit of
the symbol's digest says which), so the text shrinks and equal stretches get equal symbols except near their ends.  Names are
digests of what they stand for: a name is the same in every task, and a round needs no shuffle to be global.  With each symbol goes its
context, the words that alone determine it.  A symbol whose context lies inside a window of ``length`` words stands at the same place
in every equal window, whatever surrounds it: it is an anchor of the window.

Each window picks, of its anchors of the highest level, the one with the smallest digest; the digest of its context is the
window's key.  Spark then groups keys: windows whose key occurs in one document only are unique.  For documents that share keys the
windows themselves are digested, and a window found in a document with a smaller id is a repeat, whose words go.
Whole copies are told by the digest of all words, so only the first copy takes part.

Windows inside a long run or period may have no anchor above the single words; they then pick a word, so none is left out.

Defined cases: a null or empty text has no words; texts shorter than ``length`` words keep all; a null id keeps all its
words and takes none from others; rows that repeat an id never take words from each other; an empty table gives an empty
result.  Words are compared by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.files import discard, ship, written
from turnout.llm.wordhash import BASE, blocks, distinct, mix, powers, windows, words_of

#: Rounds of naming.  More rounds give wider contexts and fewer anchors in a window.
ROUNDS = 3
#: Up to so many documents are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_DOCS = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Level:
    """Symbols of a block in order: name, the words [start, stop) it stands for and its context [low, high)."""

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def first_level(digests: np.ndarray, bounds: np.ndarray) -> Level:
    at = np.arange(len(digests), dtype=np.int64)
    return Level(digests, at, at + 1, at, at + 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))


def _neighbours(level: Level, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left neighbour's low and the right neighbour's high; beyond a text's ends no window reaches."""
    low, high, n = bounds[level.text] - 1, bounds[level.text + 1] + 1, len(level.name)
    if n > 1:
        same = level.text[1:] == level.text[:-1]
        low[1:] = np.where(same, level.low[:-1], low[1:])
        high[:-1] = np.where(same, level.high[1:], high[:-1])
    return low, high


def name_runs(level: Level, bounds: np.ndarray) -> Level:
    """Each run of equal symbols becomes one; a run is determined by its members and both neighbours."""
    if not len(level.name):
        return level
    new = np.r_[True, (level.name[1:] != level.name[:-1]) | (level.text[1:] != level.text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, mix(level.name[first] + size * np.uint64(BASE)), level.name[first])
    low, high = _neighbours(level, bounds)
    return Level(name, level.start[first], level.stop[last], low[first], high[last], level.text[first])


def name_pairs(level: Level, bounds: np.ndarray, turn: int) -> Level:
    """Each left symbol followed by a right one becomes one with it; what stays alone depends on the neighbour it did not join."""
    n = len(level.name)
    if not n:
        return level
    right = (mix(level.name + np.uint64(2 * turn + 1)) >> np.uint64(63)).astype(bool)
    opens = np.zeros(n, bool)
    opens[:-1] = ~right[:-1] & right[1:] & (level.text[1:] == level.text[:-1])
    closes = np.r_[False, opens[:-1]]
    first = np.flatnonzero(~closes)
    paired = opens[first]
    last = first + paired
    low, high = _neighbours(level, bounds)
    name = np.where(paired, mix(level.name[first] * np.uint64(BASE) + mix(level.name[last] + np.uint64(1))), level.name[first])
    return Level(name, level.start[first], level.stop[last],
                 np.where(paired | ~right[first], level.low[first], low[first]), np.where(paired | right[first], level.high[last], high[last]), level.text[first])


def recompress(digests: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The levels from single words upwards."""
    levels = [first_level(digests, bounds)]
    for turn in range(rounds):
        levels.append(name_pairs(name_runs(levels[-1], bounds), bounds, turn))
    return levels


def _least(order: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Leftmost place of the smallest value in each range [first, last], by doubling tables."""
    out = np.empty(len(first), np.int64)
    size = last - first + 1
    table, width = np.arange(len(order)), 1
    while True:
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        a, b = table[first[now]], table[last[now] - width + 1]
        out[now] = np.where(order[b] < order[a], b, a)
        if 2 * width > size.max(initial=0):
            return out
        a, b = table[:-width], table[width:]
        table, width = np.where(order[b] < order[a], b, a), 2 * width


def window_keys(digests: np.ndarray, bounds: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of every window of ``length`` words that lies in one text."""
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    starts = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    keys = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, keys
    power, inverse = powers(len(digests) + 1)
    total = np.zeros(len(digests) + 1, np.uint64)
    np.cumsum(digests * power[:len(digests)], out=total[1:])
    left = np.arange(len(starts))
    for depth, level in reversed([*enumerate(recompress(digests, bounds, rounds))]):
        first = np.searchsorted(level.low, starts[left], "left")
        last = np.searchsorted(level.high, starts[left] + length, "right") - 1
        some = first <= last
        at = _least(mix(level.name), first[some], last[some])
        low, high = level.low[at], level.high[at]
        place = (level.start[at] - low).astype(np.uint64) << np.uint64(8) | np.uint64(depth)
        keys[left[some]] = mix(mix((total[high] - total[low]) * inverse[low] + (high - low).astype(np.uint64)) + place)
        left = left[~some]
        if not len(left):
            break
    return starts, keys


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def describe(docs: DataFrame, length: int, steps: list[str]) -> DataFrame:
    """(doc_id, text_key, n_words, kept_sha256, keys) of every row: SHA-256 of the words joined by a space, by which copies are told, and
    the distinct keys of the windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, part in blocks(batch.column(0)):
                found = words_of(part)
                starts, keys = window_keys(found.digests, found.bounds, length)
                cut = np.searchsorted(starts, found.bounds)
                own = [_signed(distinct(keys[cut[i]:cut[i + 1]])) for i in range(stop - start)]
                sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.to_pylist()]
                yield pa.record_batch([
                    *(batch.column(c).slice(start, stop - start) for c in (1, 2)), pa.array(np.diff(found.bounds), pa.int64()),
                    pa.array(sha), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_words", "kept_sha256", "keys"])

    return written(docs.select("text", "doc_id", "text_key").mapInArrow(
        run, "doc_id bigint, text_key bigint, n_words bigint, kept_sha256 string, keys array<bigint>"), steps)


def _joined_texts(docs: DataFrame, side: DataFrame) -> DataFrame:
    """The documents that ``side`` names, with its columns.

    Their ids alone are broadcast (two numbers a document, up to BROADCAST_DOCS) to pick the texts, so only those picked are shuffled
    to meet the rest of ``side``, whose arrays have no bound.
    """
    keys = ["doc_id", "text_key"]
    picked = docs.join(F.broadcast(side.select(*keys)), keys, "left_semi") if side.count() <= BROADCAST_DOCS else docs
    return picked.join(side.hint("merge"), keys)


def repeated_words(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): what ``describe`` gives with ``copy`` (whether all words repeat a smaller id's text), and for each other
    row with repeats its doc_id, text_key and the ``starts`` of its repeated windows.  docs: text, doc_id, text_key."""
    steps: list[str] = []
    rows = describe(docs, length, steps)
    long = rows.where(f"n_words >= {length} AND doc_id IS NOT NULL")
    firsts = long.groupBy("kept_sha256", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    rows = rows.join(firsts.select("kept_sha256", "n_words", "first").hint("merge"), ["kept_sha256", "n_words"], "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= length)).drop("first")
    rows = written(rows, steps)
    held = rows.where(f"NOT copy AND n_words >= {length} AND doc_id IS NOT NULL").select("doc_id", "text_key", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    taking = written(held.join(shared.hint("merge"), "key").groupBy("doc_id", "text_key").agg(F.collect_set("key").alias("keys")), steps)
    texts = _joined_texts(docs, taking)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, part in blocks(batch.column(0)):
                found = words_of(part)
                starts, keys = window_keys(found.digests, found.bounds, length)
                digests, second = (windows(found.digests, length, base) for base in (0, 1))
                cut = np.searchsorted(starts, found.bounds)
                for i in range(stop - start):
                    here = slice(cut[i], cut[i + 1])
                    at = starts[here][np.isin(_signed(keys[here]), batch.column(3)[start + i].values.to_numpy())]
                    n = len(at)
                    yield pa.record_batch([
                        *(pa.array(np.full(n, batch.column(c)[start + i].as_py()), pa.int64()) for c in (1, 2)),
                        pa.array(at - found.bounds[i], pa.int32()), pa.array(_signed(digests[at]), pa.int64()), pa.array(_signed(second[at]), pa.int64())],
                        names=["doc_id", "text_key", "start", "window", "second"])

    found = texts.select("text", "doc_id", "text_key", "keys").mapInArrow(run, "doc_id bigint, text_key bigint, start int, window bigint, second bigint")
    found = written(found, steps)
    least = found.groupBy("window", "second").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "second", "first")
    again = found.join(least.hint("merge"), ["window", "second"]).where("doc_id > first").select("doc_id", "text_key", "start")
    removed = written(again.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("start")).alias("starts")))
    rows = written(rows.drop("keys"))
    discard(docs.sparkSession, steps)
    return rows, removed


def covered(starts: np.ndarray, length: int, words: int) -> np.ndarray:
    """Which of a text's words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def cut(docs: DataFrame, removed: DataFrame, length: int, finish: Callable, columns: str, carried: list[str]) -> DataFrame:
    """``finish(text, starts, stops, gone)`` of every row with repeats: text in UTF-8, its words' byte places, and which words go.

    docs: text, doc_id, text_key and the carried columns.
    """
    texts = _joined_texts(docs, removed).select("text", "starts", *carried)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, part in blocks(batch.column(0)):
                found, made = words_of(part), []
                for i in range(stop - start):
                    own = found.text(i)
                    gone = covered(batch.column(1)[start + i].values.to_numpy(), length, own.stop - own.start)
                    made.append(finish(found.data, found.starts[own], found.stops[own], gone))
                kept = [batch.column(2 + k).slice(start, stop - start) for k in range(len(carried))]
                yield pa.record_batch([*(pa.array([m[k] for m in made]) for k in range(len(names))), *kept], names=[*names, *carried])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carried).schema)
    return texts.mapInArrow(run, f"{columns}, {kinds}")


def _kept_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, gone: np.ndarray) -> tuple[int, str]:
    words = [data[a:b].tobytes() for a, b in zip(starts[~gone].tolist(), stops[~gone].tolist(), strict=True)]
    return int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest()


def _kept_text(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, gone: np.ndarray) -> tuple[int, str]:
    """The text without the removed words and the blanks after them (before them, at the text's end)."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    parts, last = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        if a > last:
            parts.append(data[starts[last]:starts[a] if b < len(starts) else stops[a - 1]].tobytes())
        last = b
    if last < len(starts):
        parts.append(data[starts[last]:stops[-1]].tobytes())
    return int(gone.sum()), b"".join(parts).decode()


def _source(docs: DataFrame, doc_id: str, text: str, *rest) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(whole.alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("text_key"), *rest)


def word_digests(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    ship(docs.sparkSession)
    source = _source(docs, doc_id, text)
    rows, removed = repeated_words(source, length)
    changed = cut(source, removed, length, _kept_words, "n_removed bigint, cut_sha256 string", ["doc_id", "text_key"])
    # One row a text, as rows that repeat an id and a text have one answer.
    changed = changed.groupBy("doc_id", "text_key").agg(F.first("n_removed").alias("n_removed"), F.first("cut_sha256").alias("cut_sha256"))
    out = rows.join(changed.hint("merge"), ["doc_id", "text_key"], "left")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
    sha = F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha256", "kept_sha256"))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), sha.alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of the text; a row of which no word is left goes.

    Rows without repeats keep their text as it is, null included.
    """
    ship(docs.sparkSession)
    source = _source(docs, doc_id, text, F.struct(*docs.columns).alias("_row"))
    rows, removed = repeated_words(source.drop("_row"), length)
    copies = rows.where("copy").select("doc_id", "text_key").distinct()
    names = docs.columns
    touched = copies.unionAll(removed.select("doc_id", "text_key"))
    few = touched.count() <= BROADCAST_DOCS
    rest = source.join(F.broadcast(touched) if few else touched, ["doc_id", "text_key"], "left_anti").select("_row.*")
    changed = cut(source, removed, length, _kept_text, "n_removed bigint, cut_text string", ["_row"]).where("cut_text != ''")
    changed = changed.select(*((F.col("cut_text") if c == text else F.col("_row")[c]).alias(c) for c in names))
    return rest.select(*names).unionByName(changed)
