"""Exact top-k by inner product: exhaustive, one term at a time.

Candidates are written once to the shared folder as slices of postings: for each term (a vector component) the rows with a weight
other than zero.  Queries are written as blocks.  A task takes one block and some slices and reads both by name, so that no vector is
shuffled.  For each slice a dense array of scores, rows by queries, starts at zero; each term's postings are scattered into it, weighted by
the queries' weights for that term; then the k best of each query are selected from its column and merged with those of the task's earlier
slices.  The k best of all tasks are merged by a ranking that Spark cuts to k rows before its shuffle.

A task holds one block of queries, one slice and ``rows x QUERY_STEP`` scores.  Names are shuffled, and ``k`` rows a query for each group of
``SLICES_A_TASK`` slices; the scores computed grow with queries times candidates, as the exact search has it.

Scores are exact as long as they fit in 64 bits.  Defined cases: vectors that are null or hold null or non-finite components take
no part; an empty vector scores 0 with every other; of vectors of different lengths the missing components count as zero;
a null id takes no part; every row is a candidate, also repeated ones, except rows with the query's own id; of
query rows that repeat an id the smallest vector is the query; an empty table on either side gives an empty result; only the two
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.files import dealt, load_arrays, run_folder, save_arrays, ship, written

#: Rows of a slice of candidates, queries of a block, queries scored at a time, and most slices that a task takes for a block.
BLOCK_ROWS, BLOCK_QUERIES, QUERY_STEP, SLICES_A_TASK = 8192, 2048, 256, 16
_VECTORS = pa.list_(pa.int64())
_SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_weights(rows: DataFrame, vector: str, scale: int = 64) -> DataFrame:
    """Keeps the rows with sound vectors and turns each component x into floor(scale * x)."""
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn(vector, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


class Postings:
    """Rows with a weight other than zero, and these weights, for each term of a set of vectors."""

    def __init__(self, rows: np.ndarray, weights: np.ndarray, terms: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.rows, self.weights, self.terms, self.first, self.size = rows, weights, terms, first, size
        self.count, self.most_terms = (int(v) for v in size)
        self.largest = max((abs(int(w)) for w in (weights.min(initial=0), weights.max(initial=0))), default=0)
        self.bounds = dict(zip(terms.tolist(), zip(first.tolist(), [*first.tolist()[1:], len(rows)], strict=True), strict=True))

    @classmethod
    def of_vectors(cls, vectors: pa.ListArray) -> Postings:
        values, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        some = values != 0
        order = np.argsort(term[some], kind="stable")
        terms, first = np.unique(term[some][order], return_index=True)
        return cls(row[some][order], values[some][order].astype(np.int64), terms, first, np.array([len(lengths), lengths.max(initial=0)]))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"rows": self.rows, "weights": self.weights, "terms": self.terms, "first": self.first, "size": self.size}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.bounds[term]
        return self.rows[start:stop], self.weights[start:stop]


def accumulate(candidates: Postings, queries: Postings) -> np.ndarray:
    """Scores, candidates by queries."""
    bound = candidates.largest * queries.largest * min(candidates.most_terms, queries.most_terms)
    kind = np.int32 if bound < 1 << 31 else np.int64
    scores = np.zeros((candidates.count, queries.count), kind)
    for term in queries.terms.tolist():
        if term not in candidates.bounds:
            continue
        at, weight = queries.of(term)
        across = np.zeros(queries.count, kind)
        across[at] = weight
        rows, weights = candidates.of(term)
        scores[rows] += weights.astype(kind)[:, None] * across
    return scores


def select_top(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best candidates, ties to smaller ids; its own rows are left out."""
    for q, query in enumerate(query_ids.tolist()):
        column, other = scores[:, q], ids != query
        column, own_ids = column[other], ids[other]
        if len(column) > k:
            least = np.partition(column, len(column) - k)[len(column) - k]
            above = np.flatnonzero(column > least)
            ties = np.flatnonzero(column == least)
            need = k - len(above)
            if len(ties) > need:
                ties = ties[np.argpartition(own_ids[ties], need - 1)[:need]]
            keep = np.r_[above, ties]
            column, own_ids = column[keep], own_ids[keep]
        yield query, own_ids, column


def _slices(candidates: DataFrame, folder: str, size: int) -> DataFrame:
    """Writes (vec_id, vector) rows as postings of up to ``size`` rows, within each partition; returns their names, as a table."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def saved(part: pa.Table) -> pa.RecordBatch:
            postings = Postings.of_vectors(part.column("vector").combine_chunks().cast(_VECTORS))
            uri = save_arrays(folder, "slice", ids=part.column("vec_id").to_numpy(), **postings.arrays())
            return pa.record_batch([[uri]], names=["uri"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                whole = pa.Table.from_batches(held)
                while len(whole) >= size:
                    yield saved(whole.slice(0, size))
                    whole = whole.slice(size)
                held = whole.to_batches()
        if sum(map(len, held)):
            yield saved(pa.Table.from_batches(held))

    return written(candidates.select("vec_id", "vector").mapInArrow(pack, "uri string"))


def _query_blocks(queries: DataFrame, folder: str, blocks: int) -> DataFrame:
    """Writes queries as block files; returns (block, block_uri), as a table."""
    # A query's block is a hash of its id, so blocks are about equal whatever the ids are.
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    grouped = numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("r")).select(
        "block", F.col("r.vec_id").alias("ids"), F.col("r.vector").alias("vectors"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, vectors = batch.column("ids")[i].values, batch.column("vectors")[i].values
                uri = save_arrays(folder, "queries", ids=ids.to_numpy(), lengths=np.diff(vectors.offsets.to_numpy()),
                                  values=vectors.flatten().to_numpy(zero_copy_only=False))
                yield pa.record_batch([pa.array([batch.column("block")[i].as_py()], pa.int32()), pa.array([uri])], names=["block", "block_uri"])

    return written(grouped.mapInArrow(pack, "block int, block_uri string"))


def _load_queries(uri: str) -> list[tuple[np.ndarray, Postings]]:
    """The queries of a block with their postings, ``QUERY_STEP`` at a time."""
    held = load_arrays(uri)
    offsets = np.r_[0, np.cumsum(held["lengths"])].astype(np.int32)
    vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(held["values"], pa.int64()))
    out = []
    for start in range(0, len(held["ids"]), QUERY_STEP):
        out.append((held["ids"][start:start + QUERY_STEP], Postings.of_vectors(vectors.slice(start, QUERY_STEP))))
    return out


def _merged(best: dict, found: Iterable[tuple[int, np.ndarray, np.ndarray]], k: int) -> None:
    """Adds a slice's best rows to those of the slices before, k a query."""
    for query, ids, scores in found:
        if query in best:
            ids, scores = np.r_[best[query][0], ids], np.r_[best[query][1], scores]
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
        best[query] = ids, scores


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64,
          block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, slices_a_task: int = SLICES_A_TASK) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best candidates."""
    spark = candidates.sparkSession
    ship(spark)
    folder = run_folder(spark, "topk")
    plain = lambda rows: whole_weights(rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).where(
        F.col("vec_id").isNotNull()), "vector", scale)
    wanted = written(plain(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks = max(1, -(-wanted.count() // block_queries))
    named = _query_blocks(wanted, folder, blocks)
    slices = _slices(plain(candidates), folder, block_rows)
    # Small inputs take fewer slices a task, so that every task of the session has some.
    parallel = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = slices.count()
    share = max(1, min(slices_a_task, count * blocks // parallel))
    part = F.xxhash64("uri") if share == 1 else F.pmod(F.xxhash64("uri"), F.lit(-(-count // share)))
    grouped = slices.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list("uri")).alias("uris"))
    pairs = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(named, "block")
    pairs = dealt(written(pairs.select("block", "part", "block_uri", "uris")), "block", "part")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_uri, uris in zip(batch.column("block_uri").to_pylist(), batch.column("uris").to_pylist(), strict=True):
                steps, best = _load_queries(block_uri), {}
                for uri in uris:
                    held = load_arrays(uri)
                    ids, postings = held.pop("ids"), Postings(**held)
                    for query_ids, query_postings in steps:
                        _merged(best, select_top(accumulate(postings, query_postings), ids, query_ids, k), k)
                if best:
                    yield pa.record_batch([
                        pa.array(np.repeat(list(best), [len(b[0]) for b in best.values()]), pa.int64()),
                        pa.array(np.concatenate([b[0] for b in best.values()]), pa.int64()),
                        pa.array(np.concatenate([b[1] for b in best.values()]).astype(np.int64))], schema=_SCORES)

    scored = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
