"""Packing by power-of-two pieces.

A document's ids and the separator after them are cut into pieces of the longest length and then, for the rest, into the powers of two that
it is the sum of, longest first.  Every piece is a sequence of its own, so no sequence crosses documents and none is padded;
``bucket``, the piece's length, groups equal lengths into batches of one shape.

Defined cases: a null or empty text is the separator alone; repeated rows are packed row by row, each with its own
sequences; an empty table gives an empty result.  ``sequence_id`` is unique in one result; it numbers the pieces by
partition and place, as ``monotonically_increasing_id`` does, so it needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import wordbpe
from turnout.llm.files import ship

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """``tokens`` as pieces of ``longest`` (a power of two), then descending powers of two."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, separator: int = 1, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids if wanted)."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest length must be a power of two")
    source = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        for batch in batches:
            for first, last, texts in wordbpe.text_blocks(batch.column(0)):
                ids, counts = bpe.encode_block(texts)
                key = batch.column(1).slice(first, last - first)
                row, start, length, crc, total, parts = [], [], [], [], [], []
                done = 0
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[done:done + n], np.uint32(separator)).astype("<u4")
                    done, at = done + n, 0
                    for size in piece_lengths(n + 1, longest):
                        piece = own[at:at + size]
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n + 1)
                        crc.append(zlib.crc32(piece.data))
                        if with_ids:
                            parts.append(piece.astype(np.int32))
                        at += size
                columns = [key.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=[*names, "ids"][:len(columns)])

    ship(docs.sparkSession)
    pieces = source.mapInArrow(cut, SCHEMA + (", ids array<int>" if with_ids else ""))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "bucket": F.col("length")})
