"""Exact substring dedup with suffix arrays per shard.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed; strings
are judged on the input, never across documents, overlapping copies count.

1. Equal texts become one text with a number of copies.  A text with copies goes whole (if it is
   long enough) but still serves as the other place of its strings.
2. A window of ``length`` bytes is dealt by its smallest hashed ``GRAM``-byte gram: equal windows
   have equal smallest grams, so windows that share one stay together.  Consecutive windows with
   the same smallest gram form a piece; pieces whose gram stands nowhere else, nor
   twice in themselves, cannot repeat, and most of the corpus ends here.
3. Equal pieces are one class; a class with two or more places repeats whole.  Classes whose gram has
   other classes too go, once each, to a shard: the grams of a hash range, or a part of the classes
   of one very frequent gram.
4. A shard sorts all suffixes of its classes (Larsson-Sadakane: ranks by the first symbols are
   refined by the ranks at the doubled offset, only in groups that are not yet single), and gets
   common prefixes by Kasai's rule in the permuted form: a value follows from its left neighbour's
   unless the preceding symbols differ.  A window repeats when it shares ``length`` bytes with a
   neighbour in the order.
5. The shards of one frequent gram are merged: each hands over its distinct windows' 128-bit
   hashes, sorted and cut into ranges by binary search; a range puts the runs together in order,
   where windows that stand in more than one shard are neighbours.
6. Repeated windows are carried back to the places of their class, united, and cut out.

Texts are UTF-8 bytes, a null text is empty; rows may repeat (then they are copies), ids may be null.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.llm.common import two_hashes
from clueweave.session import written

LENGTH = 400
GRAM = 48
#: Windows of a piece at most (repetitive text keeps its smallest gram for long).
RUN = 512
#: Bytes of classes in a shard, roughly, and the most of one gram before it is split.
SHARD_BYTES = SPLIT_BYTES = 1 << 20

_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, (n - 1).bit_length()))[:n]


def grams(data: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, equal for equal runs wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _power(base, n), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _power(pow(base, -1, 1 << 64), n)[: n - size + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima towards both ends of blocks."""
    n = len(values) - width + 1
    filled = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    filled[: len(values)] = values
    blocks = filled.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces(text: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """``(gram, content hash, hits, start, bytes)`` of the pieces of a text.

    ``hits`` is 2 when the gram stands in the piece more than once, so that windows may repeat
    inside it, else 1.
    """
    if len(text) < length:
        return []
    gram = min(GRAM, length)
    hashes = grams(np.frombuffer(text, np.uint8), gram)
    least = sliding_minimum(hashes, length - gram + 1)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(least)]
    keys = least.view(np.int64)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        for start in range(a, b, RUN):
            size = min(b - start, RUN) - 1 + length
            content = xxhash.xxh3_64_intdigest(text[start : start + size])
            hits = np.count_nonzero(hashes[start : start + size - gram + 1] == least[start])
            content -= content >> 63 << 64
            out.append((int(keys[start]), content, min(hits, 2), start, size))
    return out


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the rank of each, by Larsson-Sadakane refinement.

    ``symbols`` are integers from 0 to 256; the end of the array is smaller than all of them.
    """
    n = len(symbols)
    packed = np.zeros(n + 6, dtype=np.int16)
    packed[:n] = symbols
    packed[:n] += 1
    key = packed[:n].astype(np.int64)
    for k in range(1, 7):  # seven symbols of nine bits make the first ranks
        key <<= 9
        key |= packed[k : n + k]
    del packed
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    del key
    # a suffix's rank is the place of the last member of its group
    group = np.flatnonzero(first).astype(np.int32)
    last = np.append(group[1:], np.int32(n)) - np.int32(1)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.repeat(last, last - group + 1)
    # places not yet single
    at = np.flatnonzero(np.repeat(last > group, last - group + 1)).astype(np.int32)
    del first, group, last
    step = 7
    while len(at):
        suffix = order[at]
        follow = np.full(len(at), -1, dtype=np.int32)
        inside = suffix + step < n
        follow[inside] = rank[suffix[inside] + step]
        own = rank[suffix]
        by = np.lexsort((follow, own))
        suffix, own, follow = suffix[by], own[by], follow[by]
        order[at] = suffix  # groups stay in their own places, which ascend with the rank
        last_of = np.append((own[1:] != own[:-1]) | (follow[1:] != follow[:-1]), True)
        ends = np.flatnonzero(last_of)
        sizes = np.diff(np.append(-1, ends))
        rank[suffix] = np.repeat(at[ends], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, rank


def _shared(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share; ``padded`` ends with a symbol of its own."""
    end = len(padded) - 1
    done = np.zeros(len(a), dtype=np.int64)
    index, width = np.arange(len(a)), 16
    while len(index):
        more = []
        for part in np.array_split(index, len(index) * width // (1 << 20) + 1):
            step = np.arange(width)
            x = np.minimum((a[part] + done[part])[:, None] + step, end)
            y = np.minimum((b[part] + done[part])[:, None] + step, end)
            equal = padded[x] == padded[y]
            full = equal.all(axis=1)
            done[part] += np.where(full, width, np.argmin(equal, axis=1))
            more.append(part[full])
        index, width = np.concatenate(more), min(width * 4, 1024)
    return done


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of each suffix with the one before it in the order, and that one, by position.

    Kasai's rule: where the symbols before a suffix and before its neighbour are equal, the value
    is the left position's less one; only the other positions are compared.
    """
    n = len(symbols)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    compared = np.ones(n, dtype=bool)
    inner = np.flatnonzero(before > 0)
    inner = inner[inner > 0]
    compared[inner] = symbols[inner - 1] != symbols[before[inner] - 1]
    padded = np.append(symbols.astype(np.int16), np.int16(-1))
    value = np.zeros(n, dtype=np.int32)
    at = np.flatnonzero(compared & (before >= 0))
    value[at] = _shared(padded, at, before[at])
    place = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(compared, place, np.int32(0)))
    return value[source] - (place - source), before


def repeated_windows(texts: list[bytes], length: int) -> np.ndarray:
    """For the texts joined by a separator: whether the window at each position stands twice."""
    joined = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int16), 256) for t in texts])
    order, _ = suffix_array(joined)
    shared, before = common_prefixes(joined, order)
    twice = shared >= length  # a window has no separator, so its equals have none either
    twice[before[twice]] = True
    return twice


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


@functools.cache
def _coders():
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(text: Column) -> Column:
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([_coders()[0].compress(t.as_py().encode()) for t in texts], pa.binary())

    return arrow_udf(pack, "binary").asNondeterministic()(text)


def _cutter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "copies", "gram", "content", "hits", "start", "size"]
        for batch in batches:
            rows: list[tuple] = []
            for tid, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(tid, copies, *p) for p in pieces(_coders()[1].decompress(data), length)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return cut


_PIECES = "tid bigint, copies bigint, gram bigint, content bigint, hits bigint, start bigint, size bigint"


def _slicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed classes of each text."""
    for batch in batches:
        out = []
        for data, listed in zip(*(c.to_pylist() for c in batch.columns)):
            text = _coders()[1].decompress(data)
            for p in listed:
                cut = text[p["start"] : p["start"] + p["size"]]
                out.append((p["gram"], p["content"], p["split"], p["places"], cut))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for i in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096]), kinds)],
                names=["gram", "content", "split", "places", "bytes"],
            )


def window_hashes(text: bytes, length: int) -> np.ndarray:
    """Two independent 64-bit hashes of the window at each position."""
    data = np.frombuffer(text, np.uint8)
    return np.column_stack([grams(data, length), grams(data, length, _BASE2)])


def _shard(length: int):
    """Repeated runs of a shard's classes; for a split gram also its windows for the merge."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows["bytes"].tolist()
        twice = repeated_windows(texts, length)
        split = int(rows["split"].iat[0])
        out, keys, own, begin = [], [], [], 0
        for text, gram, content, many in zip(texts, rows["gram"], rows["content"], rows["places"]):
            windows = len(text) - length + 1
            flags = twice[begin : begin + windows]
            begin += len(text) + 1
            if many < 2:
                out += [(gram, content, a, b, None) for a, b in _runs(flags)]
            if split > 1:
                keys.append(window_hashes(text, length))
                place = np.empty((windows, 3), np.int64)
                place[:, 0], place[:, 1], place[:, 2] = content, np.arange(windows), flags | (many > 1)
                own.append(place)
        frame = pd.DataFrame(out, columns=["gram", "content", "low", "high", "windows"])
        if keys:
            keys, own = np.concatenate(keys), np.concatenate(own)
            by = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, own = keys[by], own[by]
            fresh = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))  # one of equal windows
            keys, own = keys[fresh], own[fresh]
            gram = int(rows["gram"].iat[0])
            limits = np.array([(r << 64) // split for r in range(1, split)], dtype=np.uint64)
            cuts = [0, *np.searchsorted(keys[:, 0], limits).tolist(), len(keys)]
            runs = [
                (gram, r, split, -1, np.hstack([keys[a:b].view(np.int64), own[a:b]]).tobytes())
                for r, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if b > a
            ]
            frame = pd.concat([frame, pd.DataFrame(runs, columns=frame.columns)])
        return frame

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of one hash range that stand in more than one run.

    A run holds a window once, so equal neighbours in the common order come from different runs.
    """
    runs = np.concatenate([np.frombuffer(w, dtype=np.int64).reshape(-1, 5) for w in rows["windows"]])
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    same = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    found = np.append(False, same) | np.append(same, False)
    own = runs[found & (runs[:, 4] == 0)]  # others are known already
    content, low = own[:, 2], own[:, 3]
    return pd.DataFrame({"gram": rows["gram"].iat[0], "content": content, "low": low, "high": low + 1})


def _removal(length: int):
    names = ["tid", "n_removed", "spans", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tid, data, runs in zip(*(c.to_pylist() for c in batch.columns)):
                spans = removed_spans(sorted((r["low"], r["high"]) for r in runs), length)
                text, kept, at = _coders()[1].decompress(data), hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((tid, sum(b - a for a, b in spans), list(map(list, spans)), kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
                )

    return cut


def removed_spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the repeated windows that start in ``[low, high)``, united."""
    spans: list[tuple[int, int]] = []
    for low, high in runs:
        if spans and low <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], high - 1 + length)
        else:
            spans.append((low, high - 1 + length))
    return spans


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text)`` of every row.

    ``spans`` lists the removed runs of bytes as ``[begin, end]``; ``text`` is what remains, with a
    replacement character where a cut went through a character.
    """
    text = F.coalesce("text", F.lit(""))
    k1, k2 = two_hashes(text)
    rows = docs.select("doc_id", text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    texts = (
        rows.select(
            "k1", "k2",
            F.struct(
                F.octet_length("text").cast("bigint").alias("n_bytes"),
                F.sha2("text", 256).alias("sha"), _packed(F.col("text")).alias("data"),
            ).alias("text"),
        )
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
        .select("k1", "k2", "copies", "text.*")
    )
    # a number without collisions; stored, so that it stays the same
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    long = texts.where(F.col("n_bytes") >= length)
    cut = long.select("tid", "copies", "data").mapInArrow(_cutter(length), _PIECES)
    grams_ = cut.groupBy("gram").agg(F.sum(F.col("copies") * F.col("hits")).alias("n"))
    shared = written(grams_.where("n > 1").select("gram"), "shared-grams")
    places = written(cut.join(shared, "gram"), "shared-pieces")

    classes = written(
        places.groupBy("gram", "content").agg(
            F.sum("copies").alias("places"), F.max("hits").alias("hits"), F.min(F.struct("tid", "start", "size")).alias("one")
        ),
        "piece-classes",
    )
    several = classes.groupBy("gram").agg(F.sum("hits").alias("n"), F.sum("one.size").alias("size"))
    several = several.where("n > 1").select(
        "gram", F.ceil(F.col("size") / split_bytes).cast("int").alias("split"), "size"
    )
    total = several.agg(F.sum("size")).first()[0] or 0
    listed = classes.join(several.select("gram", "split"), "gram").groupBy("one.tid").agg(
        F.collect_list(F.struct("gram", "content", "split", "places", "one.start", "one.size")).alias("listed")
    )
    sliced = long.select("tid", "data").join(listed, "tid").select("data", "listed").mapInArrow(
        _slicer, "gram bigint, content bigint, split int, places bigint, bytes binary"
    )
    shards = int(total // shard_bytes) + 1
    whole = F.col("split") > 1
    sliced = sliced.withColumn(
        "shard", F.when(whole, F.col("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
    ).withColumn("part", F.when(whole, F.pmod(F.xxhash64("content"), F.col("split"))).otherwise(-1))
    # dealt by number: sorting suffixes takes long for few bytes, so tasks must not be merged by bytes
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 4 + 1)
    found = written(
        sliced.repartition(tasks, "shard", "part").groupBy("shard", "part").applyInPandas(
            _shard(length), "gram bigint, content bigint, low bigint, high bigint, windows binary"
        ),
        "repeats",
    )
    merged = found.where("windows IS NOT NULL").groupBy("gram", F.col("content").alias("range")).applyInPandas(
        _merge, "gram bigint, content bigint, low bigint, high bigint"
    )
    windows = (F.col("one.size") - length + 1).alias("high")
    runs = (
        classes.where("places > 1")
        .select("gram", "content", F.lit(0).cast("bigint").alias("low"), windows)
        .unionByName(found.where("windows IS NULL").select("gram", "content", "low", "high"))
        .unionByName(merged)
    )
    # texts with copies go whole; the runs of the others are brought to their places
    spans = (
        places.where("copies = 1")
        .select("tid", "gram", "content", "start")
        .join(runs, ["gram", "content"])
        .groupBy("tid")
        .agg(
            F.collect_list(
                F.struct(
                    (F.col("start") + F.col("low")).alias("low"),
                    (F.col("start") + F.col("high")).alias("high"),
                )
            ).alias("runs")
        )
    )
    cleaned = (
        long.where("copies = 1").select("tid", "data").join(spans, "tid").select("tid", "data", "runs")
        .mapInArrow(_removal(length), "tid bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string")
    )
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<array<bigint>>")
    results = texts.select("k1", "k2", "tid", "copies", "n_bytes", "sha").join(cleaned, "tid", "left")
    results = results.select(
        "k1", "k2", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.array(F.lit(0).cast("bigint"), "n_bytes")))
        .otherwise(F.coalesce("spans", none)).alias("spans"),
    )
    return rows.join(results, ["k1", "k2"]).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans",
        _remaining(F.col("text"), F.col("spans")).alias("text"),
    )


def _remaining(text: Column, spans: Column) -> Column:
    """``text`` without the bytes of ``spans`` (rising, apart)."""
    data = text.cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s[1]))
    ends = F.concat(F.transform(spans, lambda s: s[0]), F.array(F.octet_length(text).cast("bigint")))
    kept = F.zip_with(begins, ends, lambda a, b: F.hex(F.substring(data, a.cast("int") + 1, (b - a).cast("int"))))
    joined = F.unhex(F.array_join(kept, ""))
    return F.when(F.size(spans) == 0, text).otherwise(F.make_valid_utf8(joined.cast("string")))
