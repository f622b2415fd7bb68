"""Packing by power-of-two decomposition: no sequence ever holds two documents.

A document of ``n`` tokens is cut into as many full pieces of ``longest`` tokens as fit and one
piece for each set bit of the rest, longest first.  Every piece is a sequence of its own; pieces of
one length form a bucket, numbered without gaps, from which a trainer takes equal-length batches.
Nothing is padded and no attention crosses documents.

Defined cases: a null text is an empty one, and an empty text still has its end token, so every
row gives at least one piece; repeated rows give pieces of their own; ids may be null or repeated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clueweave.llm.common import texts_of
from clueweave.llm.encode import encoder
from clueweave.session import written

#: Rows of an Arrow batch of pieces, each at most ``longest`` ids.
_BATCH = 2048


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full pieces and the binary parts of the rest, in falling order."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def decompose(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int = 0, longest: int = 1024
) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)`` of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; ``longest`` is a power of two; ``ids`` are little-endian
    unsigned 32-bit integers.  The texts are encoded
    once in the scan; pieces are stored with their partition and their place among the pieces of
    the same length there.  Sequence ids (bucket after bucket, longest first) come from the counts
    per partition and length, a table of at most eleven rows per partition at ``longest`` 1024.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, "
        "part int, slot bigint"
    )
    pieces = written(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            _cutter(tokenizer, cut, end_id, longest), schema
        ),
        "pieces",
    )
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    return (
        pieces.join(F.broadcast(first), ["part", "length"])
        .withColumn("sequence_id", F.col("first") + F.col("slot"))
        .withColumn("offset", F.lit(0).cast("bigint"))
        .select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")
    )


def _cutter(tokenizer: str, cut: str, end_id: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        slots, rows = Counter(), []
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in texts_of(batch.column(1)):
                for ids in encoder(tokenizer, cut).ids(texts):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(ids), longest):
                        piece = ids[start : start + length].tobytes()
                        rows.append((keys[at], start, length, len(ids), piece, part, slots[length]))
                        slots[length] += 1
                        start += length
                        if len(rows) == _BATCH:
                            yield _batch(rows, keys.type)
                            rows = []
                    at += 1
            if rows:  # the keys of a batch must not outlive it
                yield _batch(rows, keys.type)
                rows = []

    return run


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    keys, start, length, total, ids, part, slot = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k.as_py() for k in keys], key_type),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(total, pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array(part, pa.int32()),
            pa.array(slot, pa.int64()),
        ],
        names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "slot"],
    )
