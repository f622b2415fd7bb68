"""Benchmark decontamination by SimHash over windows as long as the benchmark items.

A document is contaminated by an item if one of its windows with as many words as the item has a
weighted-shingle similarity of at least ``threshold``: the sum of the smaller counts of each word
shingle over the sum of the larger ones.  A document shorter than the item is one window.

1. A window without any of the item's shingles has similarity zero, and moving a window's start to
   its first shared shingle loses none of them, so windows begin at a shared shingle or end with
   the document.  Nothing else is left out.
2. Windows and items get SimHash fingerprints of 64 bits from their shingles.
3. Fingerprints are cut into blocks.  ``radius`` differing bits cannot all exceed
   ``radius // blocks`` in every block, so looking up each block with that tolerance guarantees to
   find every item within ``radius`` bits.
4. Candidates with as many words are verified by the exact similarity.
5. A document shorter than an item is verified as a whole, without fingerprints, if enough of its
   shingles stand in the item: their number is never below the sum of the smaller counts.

Windows of the threshold's similarity differ in about ten of 64 bits; 20 is more than three
deviations beyond.  Items are a query set: they come in blocks of at most ``ITEMS`` to all tasks
with the code, one pass over the documents per block, so memory is bounded for any benchmark.

Words are runs of letters and digits after lower-casing; other ASCII, Latin-1 signs, general
punctuation and ideographic spaces separate them.  An item shorter than a shingle is one shingle;
items and documents without words (null or empty too) match nothing.  Repeated rows are judged one
by one; all columns of ``docs`` are kept by ``remove``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.llm.common import texts_of

SHINGLE = 5
THRESHOLD = 0.8
RADIUS, BLOCKS = 20, 7
#: Items of one pass over the documents.
ITEMS = 2_000
MATCHES = "array<struct<item:int, similarity:double, start:bigint, words:bigint>>"

_LETTERS = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0 for c in range(256)
)
_SIGNS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80[\x80-\x83]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` and where each text's words end."""
    parts = [_SIGNS.sub(b"   ", (t or "").lower().encode()).translate(_LETTERS) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", dtype=np.uint8)
    letter = data != 0
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    # a word's polynomial from prefix sums, brought to its own start
    sums = np.cumsum(data * _powers(_BASE, len(data)), dtype=np.uint64)
    own = (sums[ends - 1] - sums[starts - 1]) * _powers(_INVERSE, len(data))[starts]
    return _mixed(own), np.searchsorted(starts, np.cumsum(sizes))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * _STEPS[k]
    return _mixed(out)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: bits set in more than half of the row."""
    rows, width = shingles.shape
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(rows, width, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int32)
    return np.packbits(ones * 2 > width, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts of each shingle over the sum of the larger ones."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / (len(a) + len(b) - common)


@dataclass
class Index:
    """Items of one pass: shingles, fingerprints and block tables."""

    sizes: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, texts: list[str | None]) -> Index:
        words, ends = word_hashes(texts)
        out, begin = cls(), 0
        for end in ends:
            own = words[begin:end]
            begin = end
            out.sizes.append(len(own))
            out.shingles.append(shingle_hashes(own, min(SHINGLE, len(own))) if len(own) else own)
        return out

    def prepare(self) -> None:
        """Tables made once per worker."""
        self.prints = np.array(
            [fingerprints(s[None, :])[0] if len(s) else 0 for s in self.shingles], dtype=np.uint64
        )
        # shingle width -> sorted hashes with the items that hold each
        self.tables = {}
        for width in {min(SHINGLE, n) for n in self.sizes if n}:
            pairs = sorted(
                {(int(h), i) for i, s in enumerate(self.shingles) if min(SHINGLE, self.sizes[i]) == width for h in s}
            )
            hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.tables[width] = hashes, np.array([i for _, i in pairs]), seen
        cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            values = np.arange(1 << b - a, dtype=np.uint64)
            own = self.prints >> np.uint64(a) & np.uint64((1 << b - a) - 1)
            close = np.bitwise_count(values[:, None] ^ own[None, :]) <= RADIUS // BLOCKS
            self.blocks.append((np.uint64(a), np.uint64((1 << b - a) - 1), close))

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
        """``(item, similarity, start, words)`` of the best window of each matching item."""
        best: dict[int, tuple[float, int]] = {}
        for width, (hashes, items, seen) in self.tables.items():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            maybe = np.flatnonzero(seen[(shingles >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(hashes, shingles[maybe], "left")
            many = np.searchsorted(hashes, shingles[maybe], "right") - low
            if not many.any():
                continue
            at = np.repeat(maybe, many)
            item = items[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            sizes = np.array(self.sizes)[item]
            self._compare_whole(shingles, item[sizes > len(words)], threshold, best)
            # a window past the end is replaced by the last one of its size
            start = np.minimum(at, len(words) - sizes)
            windows = np.unique(np.column_stack([sizes, start])[start >= 0], axis=0)
            for size in np.unique(windows[:, 0]):
                starts = windows[windows[:, 0] == size, 1]
                for i in range(0, len(starts), 2048):
                    self._compare(shingles, width, int(size), starts[i : i + 2048], threshold, best)
        return [(i, s, at, min(self.sizes[i], len(words))) for i, (s, at) in sorted(best.items())]

    def _compare(self, shingles, width, size, starts, threshold, best) -> None:
        rows = shingles[starts[:, None] + np.arange(size - width + 1)]
        prints = fingerprints(rows)
        near = np.zeros((len(rows), len(self.prints)), dtype=bool)
        for shift, mask, close in self.blocks:
            near |= close[(prints >> shift & mask).astype(np.int64)]
        near &= (np.array(self.sizes) == size)[None, :]
        w, i = np.nonzero(near)
        within = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        for row, item in zip(w[within].tolist(), i[within].tolist()):
            found = similarity(rows[row], self.shingles[item])
            if found >= threshold and found > best.get(item, (0.0, 0))[0]:
                best[item] = found, int(starts[row])


    def _compare_whole(self, shingles, longer, threshold, best) -> None:
        """The whole document against the longer items of its shingles, one entry per shingle."""
        items, shared = np.unique(longer, return_counts=True)
        for item, most in zip(items.tolist(), shared.tolist()):
            # rounding must not leave out a similarity of exactly the threshold
            if most < threshold * len(self.shingles[item]) - 1e-6:
                continue
            found = similarity(shingles, self.shingles[item])
            if found >= threshold:
                best[item] = found, 0


def _matcher(index: Index, threshold: float):
    def run(texts: pa.Array) -> pa.Array:
        if not hasattr(index, "blocks"):
            index.prepare()
        out = []
        for run_ in texts_of(texts, 1 << 19):
            words, ends = word_hashes(run_)
            begin = 0
            for end in ends:
                found = index.matches(words[begin:end], threshold)
                out.append([dict(zip(("item", "similarity", "start", "words"), m)) for m in found])
                begin = end
        kind = pa.struct([("item", pa.int32()), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return arrow_udf(run, MATCHES).asNondeterministic()


def _passes(items: DataFrame, size: int):
    """The items in blocks: ids and index of each."""
    spark = items.sparkSession
    ids, texts = [], []
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        if len(ids) == size:
            yield spark, ids, Index.of(texts)
            ids, texts = [], []
    if ids:
        yield spark, ids, Index.of(texts)


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = ITEMS
) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)``: the best window of each matching pair."""
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for spark, ids, index in _passes(items, size):
        names = F.array(*[F.lit(i).cast(kind) for i in ids])
        found = docs.select("doc_id", _matcher(index, threshold)("text").alias("found"))
        rows = found.select("doc_id", F.inline_outer("found")).where("item IS NOT NULL")
        rows = rows.select(
            "doc_id", F.get(names, F.col("item")).alias("item_id"), "similarity",
            F.col("start").alias("start_word"), F.col("words").alias("n_words"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        own = docs.schema["doc_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame(
            [], f"doc_id {own}, item_id {kind}, similarity double, start_word bigint, n_words bigint"
        )
    return out


def remove(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = ITEMS
) -> DataFrame:
    """``docs`` without the contaminated ones, in one narrow pass per block of items."""
    for _, _, index in _passes(items, size):
        docs = docs.where(F.size(_matcher(index, threshold)("text")) == 0)
    return docs
