"""Sums and extremes of weighted pairs, and the largest sum of every source, with one small shuffle.

Pairs are summed chunk by chunk before the shuffle and travel as one row per source and chunk with
its targets, which are one text and the sizes of its parts; the rows of a source come one after the
other to the task that adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of rows that a task sums up at once.
CHUNK = 64 << 20
#: Pairs are several times as large as the rows of two lists they come from.
CROSS_CHUNK = 16 << 20


def pair_totals(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(src, dst, w)`` -> ``(src, dst, w, m)``: summed ``w`` and its maximum per ``src``.

    Nulls are keys like others; null weights are left out, as in SQL.
    """
    return _totals(pairs.select("src", "dst", "w"), chunk, chunk, crossed=False)


def cross_totals(rows: DataFrame, chunk: int = CROSS_CHUNK) -> DataFrame:
    """``pair_totals`` of every ``srcs`` element with every ``dsts`` element of a row, at its ``w``."""
    return _totals(rows.select("srcs", "dsts", "w"), chunk, 4 * chunk, crossed=True)


def cross_sums(rows: DataFrame, chunk: int = CROSS_CHUNK) -> DataFrame:
    """``(src, dst, w)`` of :func:`cross_totals`; sources of any simple type."""
    lists, totals = _steps(chunk, 4 * chunk, True, ("sum",), best=False)
    src = rows.schema["srcs"].dataType.elementType.simpleString()
    return _dealt(rows.select("srcs", "dsts", "w"), lists, 1, src).mapInArrow(totals, f"src {src}, dst string, w bigint")


def cross_extremes(rows: DataFrame, chunk: int = CROSS_CHUNK) -> DataFrame:
    """``(src, dst, strongest, weakest)``: largest and smallest ``w`` of the pairs of :func:`cross_totals`."""
    lists, totals = _steps(chunk, 4 * chunk, True, ("max", "min"))
    dealt = _dealt(rows.select("srcs", "dsts", "w"), lists, 2)
    return dealt.mapInArrow(totals, "src string, dst string, strongest bigint, weakest bigint")


def _totals(rows: DataFrame, before: int, after: int, crossed: bool) -> DataFrame:
    lists, totals = _steps(before, after, crossed, ("sum",))
    return _dealt(rows, lists, 1).mapInArrow(totals, "src string, dst string, w bigint, m bigint")


def _dealt(rows: DataFrame, lists: Callable, kinds: int, src: str = "string") -> DataFrame:
    weights = "".join(f", low{n} binary, high{n} binary" for n in range(kinds))
    listed = rows.mapInArrow(lists, f"src {src}, text binary, size_low binary, size_high binary{weights}")
    return listed.repartition("src").sortWithinPartitions("src")


def _steps(before: int, after: int, crossed: bool, kinds: tuple[str, ...], best: bool = True) -> tuple[Callable, Callable]:
    """The two passes around the shuffle, as functions that a worker needs no module for; ``kinds``
    are the aggregates of a pair's weights, ``best`` adds the largest sum of its source."""

    missing = np.iinfo(np.int64).min

    def codes_of(column: pa.ChunkedArray) -> pa.DictionaryArray:
        return column.combine_chunks().dictionary_encode("encode")

    def places(srcs: pa.ChunkedArray, dsts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the flat ``srcs`` and place in the flat ``dsts`` of every pair."""
        row = pc.list_parent_indices(srcs).to_numpy()
        length = pc.fill_null(pc.list_value_length(dsts), 0).to_numpy().astype(np.int64)
        times = length[row]
        first = (np.cumsum(length) - length)[row] - (np.cumsum(times) - times)
        return np.repeat(row, times), np.repeat(np.arange(len(row)), times), (
            np.arange(times.sum()) + np.repeat(first, times)
        )

    def parts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all values of a text column, and where they begin and end."""
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)

    def numbers(values: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        """Lists of numbers: their last bytes, and the rest of them for lists that have any."""
        rest = values >> 8
        wide = np.add.reduceat(rest != 0, ends[:-1]) > 0 if len(values) else np.zeros(0, bool)
        count = np.diff(ends)
        high = rest[np.repeat(wide, count)]
        return [
            binary((values & 255).astype(np.uint8), ends),
            binary(high.view(np.uint8), np.concatenate([[0], np.cumsum(8 * count * wide)])),
        ]

    def plain(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that ``numbers`` was given, and the ends of their lists."""
        last, ends = parts_of(low)
        rest, at = parts_of(high)
        values = last.astype(np.int64)
        wide = np.repeat(np.diff(at) > 0, np.diff(ends))
        values[wide] += rest.copy().view(np.int64) << 8
        return values, ends

    def packed(targets: pa.Array, ends: np.ndarray) -> list[pa.Array]:
        """Lists of targets as texts and the sizes of their parts; a missing target has the size -1."""
        data, offsets = parts_of(targets.cast(pa.string()))
        size = np.where(pc.is_valid(targets).to_numpy(zero_copy_only=False), np.diff(offsets), -1)
        return [binary(data, offsets[ends]), *numbers(size.astype(np.int64), ends)]

    def unpacked(text: pa.Array, low: pa.Array, high: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Place of the list and target, for all targets of lists made by ``packed``."""
        data, _ = parts_of(text)
        size, ends = plain(low, high)
        offsets = np.concatenate([[0], np.cumsum(np.maximum(size, 0))]).astype(np.int32)
        valid = pa.py_buffer(np.packbits(size >= 0, bitorder="little"))
        buffers = [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        return np.repeat(np.arange(len(low)), np.diff(ends)), pa.Array.from_buffers(pa.string(), len(size), buffers)

    def weights(low: pa.Array, high: pa.Array) -> pa.Array:
        values, _ = plain(low, high)
        return pa.array(values, mask=values == missing)

    def listed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """One row per source of a chunk with its targets and their sums."""
        srcs, dsts, w = rows.columns
        if crossed:
            row, a, b = places(srcs, dsts)
            srcs, dsts = codes_of(pc.list_flatten(srcs)), codes_of(pc.list_flatten(dsts))
            w = w.take(pa.array(row))
            a, b = srcs.indices.to_numpy()[a], dsts.indices.to_numpy()[b]
        else:
            srcs, dsts = codes_of(srcs), codes_of(dsts)
            a, b = srcs.indices.to_numpy(), dsts.indices.to_numpy()
        width = max(len(dsts.dictionary), 1)
        pairs = pa.table([pa.array(a.astype(np.int64) * width + b), w], ["pair", "w"])
        summed = pairs.group_by("pair", use_threads=False).aggregate([("w", kind) for kind in kinds]).sort_by("pair")
        pair = summed["pair"].to_numpy()
        src = pair // width
        begins = np.flatnonzero(np.diff(src, prepend=-1))
        ends = np.append(begins, len(src))
        columns = [srcs.dictionary.take(pa.array(src[begins])), *packed(dsts.dictionary.take(pa.array(pair % width)), ends)]
        for kind in kinds:
            columns += numbers(summed[f"w_{kind}"].fill_null(missing).to_numpy(), ends)
        names = ["src", "text", "size_low", "size_high"] + [f"{part}{n}" for n in range(len(kinds)) for part in ("low", "high")]
        yield pa.record_batch(columns, names)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= before:
                yield from listed(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from listed(pa.Table.from_batches(held))

    def added(pairs: list[pa.Table]) -> pa.Table:
        grouped = pa.concat_tables(pairs).group_by(["src", "dst"], use_threads=False)
        summed = grouped.aggregate([(kind, kind) for kind in kinds])
        return summed.rename_columns({f"{kind}_{kind}": kind for kind in kinds}).select(["src", "dst", *kinds]).combine_chunks()

    def finished(pairs: pa.Table) -> Iterator[pa.RecordBatch]:
        if kinds != ("sum",):
            yield from pairs.rename_columns(["src", "dst", "strongest", "weakest"]).to_batches()
            return
        pairs = pairs.rename_columns(["src", "dst", "w"])
        if not best:
            yield from pairs.to_batches()
            return
        codes = codes_of(pairs["src"]).indices
        # groups come in the order of their first rows, as the codes do
        grouped = pa.table([codes, pairs["w"]], ["code", "w"]).group_by("code", use_threads=False)
        row_max = grouped.aggregate([("w", "max")])["w_max"]
        yield from pairs.append_column("m", row_max.take(codes)).to_batches()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A full chunk is handed over but for its last source, which may go on, so a task holds
        a chunk or the distinct targets of one source."""
        held, size, limit = [], 0, after
        for batch in batches:
            row, dst = unpacked(batch["text"], batch["size_low"], batch["size_high"])
            src = batch["src"].take(pa.array(row))
            ws = (weights(batch[f"low{n}"], batch[f"high{n}"]) for n in range(len(kinds)))
            held.append(pa.table([src, dst, *ws], ["src", "dst", *kinds]))
            size += held[-1].nbytes
            if size >= limit:
                summed, last = added(held), src[-1]
                same = pc.equal(summed["src"], last) if last.is_valid else pc.is_null(summed["src"])
                same = pc.fill_null(same, False)
                yield from finished(summed.filter(pc.invert(same)).combine_chunks())
                held = [summed.filter(same).combine_chunks()]
                size = held[0].nbytes
                limit = max(after, 2 * size)
        if held:
            yield from finished(added(held))

    return lists, totals
