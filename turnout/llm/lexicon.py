"""BPE encoding and decoding with a lexicon of frequent words.

The corpus's words are counted, and the most frequent are compiled into a minimal acyclic automaton: words share prefixes and
suffixes, and each transition carries how many words sort before those it leads to, so the sum along a word's path is the word's
number, which leads to its ids.  The automaton is one file in the shared folder; Spark hands it to every executor, and its
workers memory-map it.  Words that it does not know are merged exactly, so the ids never depend on the lexicon.

Defined cases: a null or empty text has no ids and decodes to empty bytes; repeated rows are encoded row by row; an empty table
gives an empty result (and an empty lexicon).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import wordbpe
from turnout.llm.files import Output, attempt_file, discard, run_folder, ship, written

#: Words in the lexicon: it bounds the file that every worker maps.
LEXICON_WORDS = 1 << 16
#: Longest word in the lexicon, in bytes: with the number of words it bounds what the driver collects and builds (4 MB of words).
LEXICON_BYTES = 64
MAGIC = np.array([0x4C455831], np.int64)


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text", flush_words: int = 1 << 18) -> DataFrame:
    """(word, n) over all texts; each task adds up what it can hold before its counts are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for _, _, texts in wordbpe.text_blocks(batch.column(0)):
                words, _, marks = bpe.split_block(texts)
                if len(words):
                    part = pc.value_counts(words.filter(pa.array(~marks)) if marks.any() else words)
                    held.append(pa.table({"word": part.field(0), "n": part.field(1)}))
                if sum(map(len, held)) > flush_words and len(held) > 8:
                    held = [merged()]
                    if len(held[0]) > flush_words:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            yield pa.record_batch({"word": batch.column("word").cast(pa.binary()), "n": batch.column("n")})

    ship(docs.sparkSession)
    return docs.select(text).mapInArrow(plain, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS, longest: int = LEXICON_BYTES) -> list[bytes]:
    """The most frequent words, at most ``most`` of them: all whose count reaches a bound that so many words reach.

    Words of more than ``longest`` bytes are left out in Spark, before anything is collected; they are merged exactly.
    The bound is read off the number of words per count, by leading digits: a few hundred rows however many words there are.
    """
    counts = counts.where(F.octet_length("word") <= longest)
    edge = F.expr("n - n % greatest(1, shiftleft(1L, length(bin(n)) - 9))").alias("edge")
    sizes = {r["edge"]: r["words"] for r in counts.groupBy(edge).agg(F.count(F.lit(1)).alias("words")).collect()}
    bound, total = None, 0
    for value in sorted(sizes, reverse=True):
        total += sizes[value]
        if total > most:
            break
        bound = value
    return [] if bound is None else [bytes(r["word"]) for r in counts.where(F.col("n") >= bound).select("word").collect()]


class Automaton:
    """Minimal acyclic automaton whose paths number the words; arrays only, so a file can be mapped."""

    FIELDS = ("edge_key", "edge_target", "edge_skip", "final", "id_start", "ids")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: Iterable[bytes], ids_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> Automaton:
        """From distinct words; ``ids_of`` gives all their ids in a row, and the count for each word."""
        ordered = sorted(set(words) - {b""})
        ids, counts = ids_of(ordered)
        # States on the path of the last word stay open; behind the common prefix they are closed, equal ones becoming one.
        edges: list[list[tuple[int, int]]] = []
        final: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}

        def close(state: list) -> int:
            key = (state[1], *state[0])
            if key not in known:
                known[key] = len(edges)
                edges.append(state[0])
                final.append(state[1])
                size.append(state[1] + sum(size[t] for _, t in state[0]))
            return known[key]

        path: list[list] = [[[], False]]
        last = b""
        for word in ordered:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            while len(path) > common + 1:
                state = close(path.pop())
                path[-1][0].append((last[len(path) - 1], state))
            for _ in word[common:]:
                path.append([[], False])
            path[-1][1], last = True, word
        while len(path) > 1:
            state = close(path.pop())
            path[-1][0].append((last[len(path) - 1], state))
        edges.append(path[0][0])  # the root is the last state
        final.append(False)
        keys, targets, skips = [], [], []
        for state, out in enumerate(edges):
            before = int(final[state])
            for byte, target in out:
                keys.append(state << 8 | byte)
                targets.append(target)
                skips.append(before)
                before += size[target]
        return cls(edge_key=np.array(keys, np.int64), edge_target=np.array(targets, np.int64), edge_skip=np.array(skips, np.int64),
                   final=np.array(final, np.int64), id_start=np.r_[0, np.cumsum(counts)].astype(np.int64), ids=ids.astype(np.int64))

    def to_bytes(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, f), np.int64) for f in self.FIELDS]
        return b"".join(a.tobytes() for a in (MAGIC, np.array([len(a) for a in arrays], np.int64), *arrays))

    @classmethod
    def mapped(cls, path: str) -> Automaton:
        data = np.memmap(path, np.int64, "r")
        if data[0] != MAGIC[0]:
            raise ValueError(f"not a lexicon: {path}")
        stops = len(cls.FIELDS) + 1 + np.cumsum(data[1:len(cls.FIELDS) + 1])
        return cls(**{f: data[stop - n:stop] for f, stop, n in zip(cls.FIELDS, stops, data[1:len(cls.FIELDS) + 1], strict=True)})

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 if it is not in the lexicon; all words take a step at once."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.edge_key):
            return out
        live = np.flatnonzero(sizes > 0)
        state, number, step = np.full(len(live), len(self.final) - 1, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            on = self.edge_key[at] == key
            live, at, number = live[on], at[on], number[on]
            state, number, step = self.edge_target[at], number + self.edge_skip[at], step + 1
            ended = sizes[live] == step
            right = ended & (self.final[state] > 0)
            out[live[right]] = number[right]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out

    def lookup(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known words, all their ids in a row, and the count for each of them."""
        number = self.numbers(data, starts, sizes)
        known = np.flatnonzero(number >= 0)
        first = self.id_start[number[known]]
        counts = self.id_start[number[known] + 1] - first
        ends = np.cumsum(counts)
        return known, self.ids[np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts


@lru_cache(maxsize=2)
def _mapped(name: str) -> Automaton:
    return Automaton.mapped(SparkFiles.get(name))


def compile_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts, compiles the most frequent, and hands the file to the executors; gives its name there."""
    spark = docs.sparkSession
    bpe = wordbpe.load(tokenizer)

    def ids_of(ordered: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in ordered], np.int64)
        return bpe.merge(np.frombuffer(b"".join(ordered), np.uint8), np.cumsum(sizes) - sizes, sizes)

    steps: list[str] = []
    automaton = Automaton.build(frequent_words(written(word_counts(docs, tokenizer, text), steps), words), ids_of)
    discard(spark, steps)
    uri = attempt_file(run_folder(spark, "lexicon"), "words", ".bin")
    out = Output(uri)
    out.write(automaton.to_bytes())
    out.close()
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def encode(docs: DataFrame, finish: Callable, columns: dict[str, pa.DataType], tokenizer: str, lexicon: str | None = None,
           keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row a document: its keys, and the columns that ``finish(bpe, ids)`` makes of its ids (a uint32 array).

    ``finish`` runs in the task, so ids need not be shipped where only counts or digests are wanted.  ``token_ids`` is the
    ready-made one that returns the ids.
    """
    names = [f"k{i}" for i in range(len(keys))]
    source = docs.select(F.col(text).alias("text"), *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    key_types = [docs.schema[k].dataType for k in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        lookup = _mapped(lexicon).lookup if lexicon else None
        for batch in batches:
            for start, stop, texts in wordbpe.text_blocks(batch.column(0)):
                ids, counts = bpe.encode_block(texts, lookup)
                ends = np.cumsum(counts)
                made = [finish(bpe, ids[e - n:e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                kept = [batch.column(1 + i).slice(start, stop - start) for i in range(len(keys))]
                new = [pa.array([m[c] for m in made], kind) for c, kind in columns.items()]
                yield pa.record_batch([*kept, *new], names=[*names, *columns])

    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*(StructField(n, t) for n, t in zip(names, key_types, strict=True)),
                         *(StructField(c, from_arrow_type(kind)) for c, kind in columns.items())])
    ship(docs.sparkSession)
    made = source.mapInArrow(run, schema)
    return made.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *columns)


def token_ids(bpe: wordbpe.WordBpe, ids: np.ndarray) -> dict:
    return {"ids": ids.astype(np.int32)}


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (text) to rows with a column of ids; null ids decode to the empty text."""
    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        bpe = wordbpe.load(tokenizer)
        return column.map(lambda x: "" if x is None else bpe.decode(np.asarray(x, np.int64)).decode())

    ship(encoded.sparkSession)
    return encoded.withColumn("decoded", text_of(F.col(ids)))
