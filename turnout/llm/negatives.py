"""Hard negatives by exact inner products, scored with the method of the Four Russians.

Components are whole numbers.  Candidates are kept as bit planes: of every plane, the bits of eight neighbouring dimensions make
one byte.  For each anchor and each group of eight dimensions a table holds the 256 sums of subsets of the anchor's weights, so a byte of
a plane looks up what its bits add to the score; the planes are joined by shifting and adding, the sign plane with a minus.
No product is ever formed and scores are exact as long as they fit in 64 bits.

Candidates are packed once into slice files in the shared folder, anchors into block files.  A task gets the names of one block and one
slice, so nothing but names is shuffled and both sides are dealt out.  A first pass finds each anchor's positives, a second one,
which knows the scores to stay between, its negatives; each task returns at most k rows an anchor (and positive), which a ranking
merges.  Memory of a task is one slice, the tables of one block and ``STEP`` rows of scores.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component take no part; missing components of
shorter vectors count as zero, an empty vector scores 0; of anchors that repeat an id the smallest (vector, label) is the
anchor; rows with the anchor's id are no positives; repeated rows are candidates each, ties go to the smaller id; a positive whose score is
negative has no negatives; empty tables give no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.files import Output, attempt_file, run_folder, ship, store, written
from turnout.llm.topk import whole_weights

#: Rows of a slice, anchors of a block, rows scored at a time.
SLICE_ROWS, BLOCK_ANCHORS, STEP = 8192, 1024, 1024
_MANIFEST = pa.schema([("uri", pa.string()), ("rows", pa.int64())])


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows of one table, filled up with zeros."""
    values, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Two's complement planes, lowest first and the sign last, as bytes: planes by groups of eight dimensions by rows."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    count = max(low.bit_length() if low >= 0 else (low + 1).bit_length(), high.bit_length()) + 1
    return np.stack([np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(count)])


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Groups of eight dimensions by 256 subsets by anchors: the sum of the anchor's weights in the subset."""
    count, width = anchors.shape
    groups = -(-width // 8)
    padded = np.zeros((count, groups * 8), kind)
    padded[:, :width] = anchors
    tables = np.zeros((groups, 256, count), kind)
    for bit in range(8):
        # A subset with this bit as its highest one is a smaller subset and the weight of the bit.
        tables[:, 1 << bit:2 << bit] = tables[:, :1 << bit] + padded[:, bit::8].T[:, None, :]
    return tables


def lookup_scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Scores, candidates by anchors: per plane the sum of the looked-up subset sums, shifted and added from the sign down."""
    count, groups, rows = planes.shape
    groups = min(groups, len(tables))
    scores = np.zeros((rows, tables.shape[2]), tables.dtype)
    for b in range(count - 1, -1, -1):
        scores <<= 1
        for g in range(groups):
            found = tables[g].take(planes[b, g], axis=0)
            if b == count - 1:
                scores -= found
            else:
                scores += found
    return scores


def _saved(folder: str, stem: str, **arrays: np.ndarray) -> tuple[str, int]:
    held = io.BytesIO()
    np.savez(held, **arrays)
    out = Output(attempt_file(folder, stem, ".npz"))
    out.write(held.getvalue())
    out.close()
    return out.uri, len(next(iter(arrays.values())))


def _loaded(uri: str) -> dict[str, np.ndarray]:
    system, path = store(uri)
    with system.open_input_file(path) as file, np.load(io.BytesIO(file.read())) as arrays:
        return {k: arrays[k] for k in arrays.files}


def pack_slices(candidates: DataFrame, folder: str, size: int) -> DataFrame:
    """Writes (vec_id, label, vector) rows as slices of up to ``size`` rows; returns their manifest, as a table."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def saved(part: pa.Table) -> pa.RecordBatch:
            ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
            values = matrix(part.column("vector").combine_chunks().cast(pa.list_(pa.int64())))
            uri, rows = _saved(folder, "slice", ids=ids, labels=labels, planes=bit_planes(values),
                               most=np.abs(values.astype(np.float64)).max(initial=0, keepdims=True).ravel())
            return pa.record_batch([[uri], [rows]], schema=_MANIFEST)

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

    return written(candidates.select("vec_id", "label", "vector").mapInArrow(pack, "uri string, rows bigint"))


def pack_blocks(anchors: DataFrame, folder: str, blocks: int) -> DataFrame:
    """Writes anchors (vec_id, label, vector, scores of the positives) as block files; returns (block, anchors_uri), as a table."""
    numbered = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    grouped = numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "vector", "scores"))).alias("r")).select(
        "block", *[F.col("r")[c].alias(c) for c in ("vec_id", "label", "vector", "scores")])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column("block")[i].as_py()
                ids, labels, vectors, scores = (batch.column(c)[i].values for c in ("vec_id", "label", "vector", "scores"))
                uri, _ = _saved(folder, f"block-{block}", ids=ids.to_numpy(), labels=labels.to_numpy(), vectors=matrix(vectors),
                                scores=scores.flatten().to_numpy(zero_copy_only=False), bounds=scores.offsets.to_numpy() - scores.offsets[0].as_py())
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([uri])], names=["block", "anchors_uri"])

    return written(grouped.mapInArrow(pack, "block int, anchors_uri string"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    need = k - len(above)
    if len(ties) > need:
        ties = ties[np.argpartition(ids[ties], need - 1)[:need]]
    return np.r_[above, ties]


def _scored(blocks: DataFrame, count: int, slices: DataFrame, pick, columns: str) -> DataFrame:
    """Runs ``pick(block, slice, scores of an anchor's row)`` for every block and slice, each pair in a task that reads both files."""
    slices = slices.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    pairs = slices.join(blocks, "block").select("anchors_uri", "uri", "rows")
    spark = blocks.sparkSession
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices.count() // 4)
    names = [c.split()[0] for c in columns.split(", ")]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, tables = None, {}, None
        for batch in batches:
            for uri, slice_uri in sorted(zip(batch.column("anchors_uri").to_pylist(), batch.column("uri").to_pylist(), strict=True)):
                part = _loaded(slice_uri)
                if uri != held:
                    held, block, tables = uri, _loaded(uri), None
                vectors = block["vectors"]
                # The largest sum there can be decides how wide the arithmetic is; beyond 64 bits it wraps.
                bound = float(part["most"][0]) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(vectors.shape[1], 1)
                kind = np.int32 if bound < 1 << 30 else np.int64
                if tables is None or tables.dtype != kind:
                    tables = subset_sums(vectors, kind)
                found: list[tuple] = []
                for start in range(0, len(part["ids"]), STEP):
                    step = {"ids": part["ids"][start:start + STEP], "labels": part["labels"][start:start + STEP]}
                    scores = np.ascontiguousarray(lookup_scores(part["planes"][:, :, start:start + STEP], tables).T)
                    for a in range(len(block["ids"])):
                        found += pick(block, a, step, scores[a])
                if found:
                    yield pa.record_batch([pa.array(np.concatenate([np.broadcast_to(f[c], len(f[-1])) for f in found]).astype(np.int64)) for c in range(len(names))],
                                          names=names)

    return pairs.repartition(parallel, "anchors_uri", "uri").mapInArrow(score, columns)


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, slice_rows: int = SLICE_ROWS,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Positives are an anchor's ``positives`` best other rows of its label; negatives are, for each of them, the ``negatives`` best rows of another label
    that score from ``low`` to ``high`` percent of the positive.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = run_folder(spark, "negatives")
    label = F.col(label) if isinstance(label, str) else label
    plain = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).alias("vector"), anchor.alias("anchor"))
    plain = whole_weights(plain.where("vec_id IS NOT NULL AND label IS NOT NULL"), "vector", scale)
    wanted = plain.where("anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("r")).select("vec_id", "r.label", "r.vector")
    wanted = written(wanted)
    count = max(1, -(-wanted.count() // block_anchors))
    slices = pack_slices(plain, folder, slice_rows)

    def nearest(block: dict, a: int, step: dict, scores: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((step["labels"] == block["labels"][a]) & (step["ids"] != block["ids"][a]))
        at = at[best_of(scores[at], step["ids"][at], positives)]
        return [(block["ids"][a], step["ids"][at], scores[at])] if len(at) else []

    first = pack_blocks(wanted.withColumn("scores", F.array().cast("array<bigint>")), folder, count)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = _scored(first, count, slices, nearest, "anchor_id bigint, positive_id bigint, score bigint")
    near = written(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    def between(block: dict, a: int, step: dict, scores: np.ndarray) -> list[tuple]:
        wanted = block["scores"][block["bounds"][a]:block["bounds"][a + 1]]
        if not len(wanted):
            return []
        least, most = -(-low * wanted // 100), high * wanted // 100
        other = np.flatnonzero((scores >= least.min()) & (scores <= most.max()) & (step["labels"] != block["labels"][a]))
        out, own, ids = [], scores[other], step["ids"][other]
        for positive in np.unique(wanted):
            inside = np.flatnonzero((own >= -(-low * positive // 100)) & (own <= high * positive // 100))
            inside = inside[best_of(own[inside], ids[inside], negatives)]
            if len(inside):
                out.append((block["ids"][a], positive, ids[inside], own[inside]))
        return out

    scored = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("scores"))
    second = pack_blocks(wanted.join(scored, "vec_id"), folder, count)
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = _scored(second, count, slices, between, "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = near.select("anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return pairs.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
