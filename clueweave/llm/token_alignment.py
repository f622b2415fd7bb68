"""Alignment of two tokenizers over the same text by diagonal run skipping.

Both token sequences of a text are reduced to the byte offsets at which their tokens end.  As long
as the sequences agree, token ``i`` of one ends where token ``i + shift`` of the other ends, so the
walk compares whole slices of the two end arrays at the current shift, doubling the slice while it
matches and halving it afterwards: a one-to-one stretch is jumped over.  Where the ends differ, the
side that lags takes single steps until both end at one offset; these tokens form one irregular
group and the shift changes to the new difference of the two places.

``alignments`` gives the ids of both sides and the sizes of the groups, ``link_report`` adds how
often linked ids meet in the whole corpus.  An id pair is counted once per document, summed per
chunk of documents in the scan, then over chunks; a chunk asks for the counts of its own pairs only,
so what is shuffled is the distinct pairs of each chunk and not the links of each document.

Defined cases: texts that are null or empty, or whose tokens of either side do not spell the blank
and the text byte for byte, have no tokens: empty arrays, zeros and an empty digest.  Repeated rows
are documents of their own; ids may be null or repeated; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clueweave.llm.common import texts_of
from clueweave.llm.encode import Encoder, _byte_letters
from clueweave.session import written

#: Documents join a chunk until it holds so many tokens of the first side (one document at least).
CHUNK_TOKENS = 1 << 20
#: Groups with more token pairs than this are paired by distinct ids, not by occurrence.
_LARGE_GROUP = 1 << 12


@dataclass
class Alignment:
    """Ids of both sides and, per group, how many tokens of either side it holds."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray


_NONE = np.zeros(0, np.int64)
NO_TOKENS = Alignment(_NONE, _NONE, _NONE, _NONE)


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (rising, of one length) of the values that both hold.

    Both rise strictly and have the same last value.
    """
    n, m = len(a), len(b)
    a_starts, b_starts, lengths = [], [], []
    i = j = 0
    while i < n and j < m:
        x, y = a[i], b[j]
        run = 1
        if x == y:
            step, left = 1, min(n - i, m - j)
            while run + step <= left and a[i + run : i + run + step] == b[j + run : j + run + step]:
                run += step
                step += step
            while step > 1:
                step >>= 1
                if run + step <= left and a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
        else:
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
        a_starts.append(i)
        b_starts.append(j)
        lengths.append(run)
        i += run
        j += run
    length = np.array(lengths, np.int64)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return (
        np.repeat(np.array(a_starts, np.int64), length) + within,
        np.repeat(np.array(b_starts, np.int64), length) + within,
    )


class Aligner:
    """Both tokenizers of a worker with the bytes that each of their ids spells."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = Encoder(byte_level, "blank")
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text here
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(map(letters.get, token)) if known else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
            for p in [self.b.id_to_piece(i)]
        ]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)

    def align(self, texts: list[str | None]) -> Iterator[Alignment]:
        given = [t or "" for t in texts]
        for text, a, b in zip(given, self.a.ids([" " + t for t in given]), self.b.encode(given, num_threads=1)):
            if not text:
                yield NO_TOKENS
                continue
            spelt = (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != spelt:
                yield NO_TOKENS
                continue
            if b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
                yield NO_TOKENS
                continue
            b = np.array(b, np.int64)
            ends = common_ends(
                np.cumsum(self.a_length[a]).tolist(), np.cumsum(self.b_length[b]).tolist()
            )
            yield Alignment(a, b, np.diff(ends[0], prepend=-1), np.diff(ends[1], prepend=-1))


@functools.cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    """The aligner of this worker process."""
    return Aligner(byte_level, pieces)


def alignments(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_sizes, b_sizes)`` of ``docs`` (``doc_id``, ``text``).

    ``a_ids`` are ids of the byte-level vocabulary file ``byte_level`` over a blank and the text,
    ``b_ids`` those of the sentence-piece model ``pieces``; group ``g`` holds the next
    ``a_sizes[g]`` and ``b_sizes[g]`` of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ("a_ids", "b_ids", "a_sizes", "b_sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _aligned(batches, byte_level, pieces):
            columns = [keys, *(_lists([getattr(f, name) for f in found]) for name in fields)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *fields])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{name} array<int>" for name in fields)
    )


def _aligned(
    batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str
) -> Iterator[tuple[pa.Array, list[Alignment]]]:
    """Ids and alignments of the documents of a task, about a million letters at a time."""
    for batch in batches:
        at = 0
        for texts in texts_of(batch.column(1), 1 << 20):
            found = list(aligner(byte_level, pieces).align(texts))
            yield batch.column(0).slice(at, len(found)), found
            at += len(found)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32), pa.int32())
    )


def group_text(found: Alignment) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the decimal ids of every group in order."""
    return _group_text(found, 1 + max(found.a_ids.max(initial=0), found.b_ids.max(initial=0)))


@functools.cache
def _decimals(size: int) -> np.ndarray:
    """Decimal texts of the numbers below ``size`` followed by each separator, padded with NULs."""
    return np.array([[b"%d%c" % (i, s) for s in b",|;"] for i in range(size)])


def _group_text(found: Alignment, size: int) -> bytes:
    if not len(found.a_sizes):
        return b""
    table = _decimals(1 << int(size - 1).bit_length())
    a_ends, b_ends = np.cumsum(found.a_sizes), np.cumsum(found.b_sizes)
    # separators: a comma inside a side, a bar after its last id of A, a semicolon after that of B
    a_mark, b_mark = np.zeros(len(found.a_ids), np.int64), np.zeros(len(found.b_ids), np.int64)
    a_mark[a_ends - 1], b_mark[b_ends - 1] = 1, 2
    # place of an id: its own place and all ids of the other side in groups before (or up to) its own
    group = np.arange(len(a_ends))
    a_place = np.arange(len(a_mark)) + (b_ends - found.b_sizes)[np.repeat(group, found.a_sizes)]
    b_place = np.arange(len(b_mark)) + a_ends[np.repeat(group, found.b_sizes)]
    out = np.empty(len(a_mark) + len(b_mark), table.dtype)
    out[a_place] = table[found.a_ids, a_mark]
    out[b_place] = table[found.b_ids, b_mark]
    return out.tobytes().translate(None, b"\0")[:-1]


def linked(found: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """Linked id pairs ``a << 32 | b`` and how often each stands in ``found``; pairs may repeat."""
    a_sizes, b_sizes = found.a_sizes, found.b_sizes
    group = np.arange(len(a_sizes))
    small = a_sizes * b_sizes <= _LARGE_GROUP
    a_group = np.repeat(group, a_sizes)
    keep = small[a_group]
    a_ids, times = found.a_ids[keep].astype(np.int64), b_sizes[a_group[keep]]
    # each id of A meets all ids of B of its group
    first = (np.cumsum(b_sizes) - b_sizes)[a_group[keep]]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pairs = np.repeat(a_ids, times) << 32 | found.b_ids[np.repeat(first, times) + within]
    counts = np.ones(len(pairs), np.int64)
    if small.all():
        return pairs, counts
    a_first, b_first = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    all_pairs, all_counts = [pairs], [counts]
    for g in np.flatnonzero(~small):
        a, n = np.unique(found.a_ids[a_first[g] : a_first[g] + a_sizes[g]], return_counts=True)
        b, m = np.unique(found.b_ids[b_first[g] : b_first[g] + b_sizes[g]], return_counts=True)
        all_pairs.append((a.astype(np.int64)[:, None] << 32 | b[None, :]).ravel())
        all_counts.append((n[:, None] * m[None, :]).ravel())
    return np.concatenate(all_pairs), np.concatenate(all_counts)


_CHUNK = (
    "chunk bigint, pairs array<bigint>, holders array<int>, "
    "docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,"
    "n_pairs:bigint,groups_sha256:string>>, link_pair binary, link_count binary"
)


def _chunks(kind: pa.DataType, byte_level: str, pieces: str):
    """Chunks of aligned documents: the distinct id pairs and, per document, which it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, pairs, counts, tokens = [], [], [], 0
        for keys, some in _aligned(batches, byte_level, pieces):
            for key, found in zip(keys.to_pylist(), some):
                text = group_text(found)
                held, times = _merged(*linked(found))
                docs.append(
                    {
                        "doc_id": key,
                        "n_a": len(found.a_ids),
                        "n_b": len(found.b_ids),
                        "n_groups": len(found.a_sizes),
                        "n_links": int((found.a_sizes * found.b_sizes).sum()),
                        "n_pairs": len(held),
                        "groups_sha256": hashlib.sha256(text).hexdigest() if text else "",
                    }
                )
                pairs.append(held)
                counts.append(times)
                tokens += len(found.a_ids)
                if tokens >= CHUNK_TOKENS:
                    yield _chunk(number, docs, pairs, counts, kind)
                    number += 1
                    docs, pairs, counts, tokens = [], [], [], 0
        if docs:
            yield _chunk(number, docs, pairs, counts, kind)

    return run


def _merged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, place = np.unique(pairs, return_inverse=True)
    return held, np.bincount(place, counts, len(held)).astype(np.int64)


def _chunk(number, docs, pairs, counts, kind) -> pa.RecordBatch:
    held, place, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    entry = pa.struct(
        [("doc_id", kind), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs"))]
        + [("groups_sha256", pa.string())]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([held], pa.list_(pa.int64())),
            pa.array([holders.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([docs], pa.list_(entry)),
            pa.array([place.astype("<u4" if len(held) >> 16 else "<u2").tobytes()], pa.binary()),
            pa.array([np.concatenate(counts).astype("<u4").tobytes()], pa.binary()),
        ],
        names=["chunk", "pairs", "holders", "docs", "link_pair", "link_count"],
    )


def link_report(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document: numbers and digest of its ``alignments``, and corpus counts of its links.

    ``n_best`` links have the highest count among the pairs of their id of A; ``count_sum`` adds
    the counts of all links.  The alignments are digested in the task that makes them.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    chunked = docs.select("doc_id", "text").mapInArrow(
        _chunks(to_arrow_type(kind), byte_level, pieces), _CHUNK.format(kind=kind.simpleString())
    )
    chunks = written(chunked, "aligned")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p"))
    asked = asked.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = written(asked.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("a")
    # one row per id of the first vocabulary, whatever the size of the corpus
    best = counts.groupBy(first).agg(F.max("n").alias("most"))
    ranked = counts.select("pair", "n", first).join(F.broadcast(best), "a")
    ranked = ranked.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # a pair stands once in a chunk and once in ``ranked``: Spark splits a frequent one by itself
    answers = asked.select("chunk", "place", "pair").join(ranked, "pair")
    answers = answers.select(F.col("chunk").alias("of_chunk"), "place", "n", "best")
    out = (
        "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
        "count_sum bigint, groups_sha256 string"
    ).format(kind.simpleString())
    # documents without any link ask for nothing, so their chunks meet no answers
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    stored = chunks.select("chunk", "docs", "link_pair", "link_count").repartition(parts, "chunk")
    return stored.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInPandas(_report, out)


def _report(stored: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if stored.empty:
        return pd.DataFrame(columns=columns)
    n = np.zeros(len(answers), np.int64)
    best = np.zeros(len(answers), bool)
    n[answers["place"].to_numpy()] = answers["n"].to_numpy()
    best[answers["place"].to_numpy()] = answers["best"].to_numpy()
    row = stored.iloc[0]
    docs = pd.DataFrame(list(row["docs"]))
    # as objects: ids next to a null would become fractions
    docs["doc_id"] = pd.Series([d["doc_id"] for d in row["docs"]], dtype=object)
    place = np.frombuffer(row["link_pair"], "<u4" if len(n) >> 16 else "<u2")
    times = np.frombuffer(row["link_count"], "<u4").astype(np.int64)
    ends = np.cumsum(docs["n_pairs"].to_numpy())
    begins = ends - docs["n_pairs"].to_numpy()

    def per_document(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[ends] - total[begins]

    docs["n_best"] = per_document(times * best[place])
    docs["count_sum"] = per_document(times * n[place])
    return docs[columns]
