"""Token-id files with Elias-Fano document boundaries, and random access to them.

A file holds the ids of some documents one after another, as 16- or 32-bit integers, and two
Elias-Fano sequences: where each document ends, and (as they ascend too) the document ids.  An
Elias-Fano sequence of ``n`` values up to ``u`` keeps the low ``log2(u / n)`` bits of each value
packed and the high parts in unary, about two bits a value; every 256th one bit has its position
sampled, so ``select`` reads a few words.  No table of 64-bit offsets exists.

Files are written by the tasks through the file system of the target folder, under names of their
own; the manifest, stored once the tasks are over, names the files that count, so a repeated or
lost task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clueweave.llm.common import texts_of
from clueweave.llm.encode import encoder
from clueweave.session import shared_dir, written

MAGIC = b"EFTOKEN1"
#: documents, null ids, bytes per token id, tokens
_HEAD = struct.Struct("<QQQQ")
#: values, low bits, words of the high part, words of the low part, smallest value
_EF_HEAD = struct.Struct("<QQQQq")
_SAMPLE = 256
#: A new file is begun after so many ids.
FILE_IDS = 1 << 24
#: Documents of a file at most: their boundaries are coded at once.
FILE_DOCUMENTS = 1 << 20
#: Files are read back by as many tasks, up to this number.
MOST_TASKS = 100_000


class EliasFano:
    """A non-falling sequence of integers in near-minimal space."""

    def __init__(self, n, low_bits, high, low, least, sampled=None):
        self.n, self.low_bits, self.high, self.low, self.least = n, low_bits, high, low, least
        self._sampled = self._samples() if sampled is None else sampled

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        least = int(values[0]) if n else 0
        rest = values.astype(np.int64).view(np.uint64) - np.uint64(least & (1 << 64) - 1)
        top = int(rest[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(ones[-1]) if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        high[ones] = 1
        flat = rest[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
        flat = np.append(flat.astype(np.uint8).ravel(), np.zeros(-(n * bits) % 64, np.uint8))
        return cls(n, bits, _words(high), _words(flat), least)

    def to_bytes(self) -> bytes:
        head = _EF_HEAD.pack(self.n, self.low_bits, len(self.high), len(self.low), self.least)
        return head + self.high.tobytes() + self.low.tobytes() + self._sampled.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``data`` and the bytes it takes."""
        n, bits, highs, lows, least = _EF_HEAD.unpack_from(data)
        at = _EF_HEAD.size
        high = np.frombuffer(data, "<u8", highs, at)
        low = np.frombuffer(data, "<u8", lows, at + 8 * highs)
        at += 8 * (highs + lows)
        samples = -(-n // _SAMPLE)
        sampled = np.frombuffer(data, "<u4", samples, at)
        return cls(n, bits, high, low, least, sampled), at + 4 * samples

    def _samples(self) -> np.ndarray:
        """Bit positions of every ``_SAMPLE``-th one of the high part."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ones[: self.n : _SAMPLE].astype("<u4")

    def select(self, i: int) -> int:
        """Value ``i``: from the sampled bit on, skip words by their number of one bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        word, skip = divmod(int(self._sampled[i // _SAMPLE]), 64)
        left, bits = i % _SAMPLE, int(self.high[word]) >> skip << skip
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        top = word * 64 + (bits & -bits).bit_length() - 1 - i
        return self.least + (top << self.low_bits | self._low(i))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        word, shift = divmod(i * self.low_bits, 64)
        value = int(self.low[word]) >> shift
        if shift + self.low_bits > 64:
            value |= int(self.low[word + 1]) << 64 - shift
        return value & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        top = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            flat = np.unpackbits(self.low.view(np.uint8), bitorder="little")
            flat = flat[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
            top |= (flat << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (top + np.uint64(self.least & (1 << 64) - 1)).view(np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view("<u8")


class TokenFile:
    """One file, opened for reading; the ids of a document are read from its own place."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        (index_at,) = struct.unpack("<Q", self._file.read_at(8, size - 8))
        index = memoryview(self._file.read_at(size - 8 - index_at, index_at))
        if bytes(index[: len(MAGIC)]) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.documents, self.nulls, self.width, self.tokens = _HEAD.unpack_from(index, len(MAGIC))
        at = len(MAGIC) + _HEAD.size
        self.ends, used = EliasFano.read(index[at:])
        self.ids, _ = EliasFano.read(index[at + used :])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.ids.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens_of(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        data = self._file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def close(self) -> None:
        self._file.close()


def write_store(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int, folder: str | None = None
) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) as token files; return the stored manifest.

    Documents stand in ascending order of ``doc_id`` (nulls first; equal ids by a hash of the
    text), a null text as an empty one, each followed by ``end_id``.  Ranges of ids, dealt by
    Spark, become one or more files.  The manifest has ``(part, file, uri, documents, tokens,
    base)``: ``base`` is the number of ids in all files before, from one row per file.
    ``folder`` is by default one of its own in the shared folder.
    """
    spark = docs.sparkSession
    if folder is None:
        app = spark.sparkContext.applicationId
        folder = f"{shared_dir(spark)}/{app}/token-files-{uuid.uuid4().hex}"
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = dealt.select("doc_id", "text").mapInArrow(
        _writer(folder, tokenizer, cut, end_id),
        "part int, file int, uri string, documents bigint, tokens bigint",
    )
    manifest = written(files, "token-manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _writer(folder: str, tokenizer: str, cut: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        encode = encoder(tokenizer, cut)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in texts_of(batch.column(1)):
                for ids in encode.ids(texts):
                    if out is None:
                        out = _Open(folder, part, number, width)
                    out.add(keys[at], np.append(ids, np.uint32(end_id)))
                    at += 1
                    if out.tokens >= FILE_IDS or len(out.ends) >= FILE_DOCUMENTS:
                        yield out.close()
                        out, number = None, number + 1
        if out is not None:
            yield out.close()

    return run


class _Open:
    """A file being written."""

    def __init__(self, folder: str, part: int, number: int, width: int):
        self.part, self.number, self.width, self.tokens = part, number, width, 0
        self.uri = f"{folder}/part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.tokens"
        self.keys, self.ends, self.nulls = [], [], 0
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(path)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        self.ends.append(self.tokens)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        self.file.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> pa.RecordBatch:
        index = MAGIC + _HEAD.pack(len(self.ends), self.nulls, self.width, self.tokens)
        for values in (self.ends, self.keys):
            index += EliasFano.of(np.array(values, dtype=np.int64)).to_bytes()
        self.file.write(index)
        self.file.write(struct.pack("<Q", self.tokens * self.width))
        self.file.close()
        row = {
            "part": self.part, "file": self.number, "uri": self.uri,
            "documents": len(self.ends), "tokens": self.tokens,
        }
        schema = pa.schema(
            [("part", pa.int32()), ("file", pa.int32()), ("uri", pa.string()),
             ("documents", pa.int64()), ("tokens", pa.int64())]
        )
        return pa.RecordBatch.from_pylist([row], schema=schema)


def read_store(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files.

    One row of the manifest is a bounded file; the rows are dealt by number, a file to a task, which
    adaptive execution does not merge.
    """
    files = min(max(manifest.count(), 1), MOST_TASKS)
    return manifest.select("uri", "base").repartition(files).mapInArrow(
        _digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, out = TokenFile(row["uri"]), []
            for i in range(file.documents):
                start, end = file.bounds(i)
                crc = zlib.crc32(file.tokens_of(i).astype("<u4").tobytes())
                out.append((file.doc_id(i), row["base"] + start, end - start, crc))
            file.close()
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*out)], names=names
            )
