"""Scans of large record files in byte ranges, every record exactly once.

JSON has no byte that surely ends a record: a brace may stand inside a string, and whether a range
begins inside one depends on all bytes before it.  So the scan has two passes.  The first, a data
source that plans byte ranges, sums up each range under both assumptions: how many braces it opens
and whether it turns text into string.  A running sum over the few rows of a file then tells each
range its true beginning, and the second pass cuts the records that begin in it, reading on into the
next ranges for the end of the last one.  Only braces outside strings count, so records are found
at any depth of surrounding arrays, as JSON lines or one behind the other.

Dump pages end with a literal tag, which Spark's own text reader can split at, compressed files of
a splittable codec (bzip2) included.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
_BLOCK = 4 << 20
_QUOTE, _ESCAPE, _OPEN, _CLOSE = b'"\\{}'
#: Endings that are read through a decoder; such a file is one range.
CODECS = {".bz2": "bz2", ".gz": "gzip"}

SUMMARY = "path string, begin bigint, until bigint, turns int, opened_outside bigint, opened_inside bigint"


def _opened(uri: str):
    found, path = pyarrow.fs.FileSystem.from_uri(uri) if ":/" in uri else (pyarrow.fs.LocalFileSystem(), uri)
    return found, path


def _codec(path: str) -> str | None:
    return next((c for ending, c in CODECS.items() if path.endswith(ending)), None)


def _blocks(uri: str, begin: int, until: int | None = None) -> Iterator[bytes]:
    """Bytes of a file from ``begin``; the block that reaches ``until`` is cut there."""
    system, path = _opened(uri)
    if _codec(path):
        with system.open_input_stream(path, compression=_codec(path)) as stream:
            while block := stream.read(_BLOCK):
                yield block
        return
    with system.open_input_file(path) as file:
        file.seek(begin)
        while until is None or begin < until:
            block = file.read(_BLOCK if until is None else min(_BLOCK, until - begin))
            if not block:
                return
            begin += len(block)
            yield block


def _escapes_before(uri: str, begin: int) -> int:
    """Number of backslashes right before ``begin``."""
    if begin == 0:
        return 0
    system, path = _opened(uri)
    back = 64
    with system.open_input_file(path) as file:
        while True:
            low = max(begin - back, 0)
            file.seek(low)
            before = file.read(begin - low)
            run = len(before) - len(before.rstrip(b"\\"))
            if run < len(before) or low == 0:
                return run
            back *= 4


class Marks:
    """Strings and braces of consecutive blocks of one text."""

    def __init__(self, escapes: int = 0):
        self.escapes = escapes  # backslashes right before the next block

    def of(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of quotes that begin or end a string, of braces, and whether those open."""
        data = np.frombuffer(block, np.uint8)
        quotes = np.flatnonzero(data == _QUOTE)
        escapes = np.flatnonzero(data == _ESCAPE)
        if len(escapes) or self.escapes:
            # length of the run of backslashes right before each quote
            first = np.ones(len(escapes), bool)
            first[1:] = np.diff(escapes) != 1
            begin = np.maximum.accumulate(np.where(first, escapes, 0)) if len(escapes) else escapes
            if len(escapes) and escapes[0] == 0:
                begin = np.where(begin == 0, -self.escapes, begin)
            at = np.searchsorted(escapes, quotes - 1)
            held = np.minimum(at, max(len(escapes) - 1, 0))
            behind = (
                (at < len(escapes)) & (escapes[held] == quotes - 1)
                if len(escapes)
                else np.zeros(len(quotes), bool)
            )
            run = np.where(behind, quotes - begin[held], 0) if len(escapes) else np.zeros(len(quotes), np.int64)
            run = np.where(quotes == 0, self.escapes, run)
            quotes = quotes[run % 2 == 0]
        tail = len(block) - len(block.rstrip(b"\\"))
        self.escapes = tail + (self.escapes if tail == len(block) else 0)
        braces = np.flatnonzero((data == _OPEN) | (data == _CLOSE))
        return quotes, braces, data[braces] == _OPEN


def summary(blocks: Iterator[bytes], escapes: int) -> tuple[int, int, int]:
    """``(turns, opened_outside, opened_inside)``: whether an odd number of quotes stands in the
    text, and the braces that it opens if it begins outside or inside a string."""
    marks, odd, opened = Marks(escapes), 0, [0, 0]
    for block in blocks:
        quotes, braces, opens = marks.of(block)
        inside = (np.searchsorted(quotes, braces) + odd) & 1
        step = np.where(opens, 1, -1)
        opened[0] += int(step[inside == 0].sum())
        opened[1] += int(step[inside == 1].sum())
        odd = (odd + len(quotes)) & 1
    return odd, opened[0], opened[1]


def cut(
    blocks: Iterator[bytes], own: int | None = None, inside: int = 0, depth: int = 0, escapes: int = 0
) -> Iterator[bytes]:
    """Records that begin within the first ``own`` bytes (all if None) of the text.

    ``inside`` and ``depth`` tell whether the text begins in a string and under how many braces.
    """
    marks, base, held = Marks(escapes), 0, []
    begun = False  # a record of this range is open
    for block in blocks:
        quotes, braces, opens = marks.of(block)
        outside = (np.searchsorted(quotes, braces) + inside) & 1 == 0
        braces, opens = braces[outside], opens[outside]
        after = depth + np.cumsum(np.where(opens, 1, -1))
        begins = braces[opens & (after == 1)].tolist()
        ends = braces[~opens & (after == 0)].tolist()
        at = 0
        if depth > 0 and ends:  # the record that was open before this block
            if begun:
                yield b"".join([*held, block[: ends[0] + 1]])
            held, begun, at = [], False, 1
        elif depth > 0 and begun:
            held.append(block)
        for place in begins:
            if own is not None and base + place >= own:
                return
            if at < len(ends):
                yield block[place : ends[at] + 1]
                at += 1
            else:
                held, begun = [block[place:]], True
        inside = (inside + len(quotes)) & 1
        depth = int(after[-1]) if len(after) else depth
        base += len(block)
        if own is not None and base >= own and not begun:
            return


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, until: int | None):
        self.path, self.begin, self.until = path, begin, until


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Names and sizes only; a compressed file is one range."""
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == pyarrow.fs.FileType.Directory:
            infos = system.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        else:
            infos = [info]
        out = []
        for f in infos:
            hidden = f.base_name.startswith(("_", "."))
            if f.type != pyarrow.fs.FileType.File or hidden or not f.size:
                continue
            name = f"{self.path.split('://')[0]}://{f.path}" if "://" in self.path else f.path
            step = f.size if _codec(f.path) else self.step
            out.extend(_Range(name, low, min(low + step, f.size)) for low in range(0, f.size, step))
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range):
        if not partition.path:
            return
        escapes = _escapes_before(partition.path, partition.begin) if partition.begin else 0
        found = summary(_blocks(partition.path, partition.begin, partition.until), escapes)
        yield (partition.path, partition.begin, partition.until, *found)


class RangeSource(DataSource):
    """``spark.read.format("json_ranges").option("rangeBytes", n).load(path)``: one row per range."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return SUMMARY

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RangeReader(self.options)


def planned(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of all files below ``path`` with the true state at their beginning.

    The windows hold the ranges of one file, a few numbers each.
    """
    spark.dataSource.register(RangeSource)
    found = spark.read.format("json_ranges").option("rangeBytes", range_bytes).load(path)
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int")
    found = found.withColumn("inside", inside)
    opened = F.when(F.col("inside") == 1, F.col("opened_inside")).otherwise(F.col("opened_outside"))
    found = found.withColumn("opened", opened)
    depth = F.coalesce(F.sum("opened").over(before), F.lit(0))
    return found.select("path", "begin", "until", "inside", depth.alias("depth"))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            path, begin = row["path"], row["begin"]
            whole = _codec(path) is not None
            found = cut(
                _blocks(path, begin),
                None if whole else row["until"] - begin,
                row["inside"],
                row["depth"],
                _escapes_before(path, begin) if begin else 0,
            )
            held, size = [], 0
            for record in found:
                held.append(record)
                size += len(record)
                if size >= _BLOCK:
                    yield _batch(path, held)
                    held, size = [], 0
            if held:
                yield _batch(path, held)


def _batch(path: str, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(records)), pa.array(records, pa.binary()).cast(pa.string())],
        names=["path", "value"],
    )


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Objects at any depth of arrays in the files below ``path``, parsed with ``schema``.

    One task per range reads and cuts; a file of many gigabytes is read by as many tasks as it has
    ranges.
    """
    ranges = planned(spark, path, range_bytes)
    count = max(ranges.count(), 1)
    # dealt by number, so that every range is a task of its own and adaptive merging keeps away
    dealt = ranges.repartition(min(count, 100_000), "path", "begin")
    records = dealt.mapInArrow(_cutter, "path string, value string")
    parsed = F.from_json("value", schema)
    return records.select(parsed.alias("r")).select("r.*")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def _element(page: Column, name: str) -> Column:
    """Text of the first ``name`` element of a page, named entities decoded; null if it has none."""
    found = F.regexp_extract(page, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    plain = functools.reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, found)
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return F.when(F.rlike(page, F.lit(rf"(?s)<{name}[\s>]")), plain)


def read_split_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of the main-namespace pages of XML dumps, split inside files.

    The page's closing tag ends a record of the text reader, which splits plain and bzip2 files at
    ``spark.sql.files.maxPartitionBytes`` and gives each record to the split that it begins in.
    """
    pages = spark.read.option("lineSep", "</page>").option("recursiveFileLookup", True).text(path)
    pages = pages.where(F.contains("value", F.lit("<page>")))
    return pages.where(F.trim(_element(F.col("value"), "ns")) == "0").select(
        _element(F.col("value"), "title").alias("title"), _element(F.col("value"), "text").alias("text")
    )
