"""Spelling variants of a vocabulary by reduced-alphabet generation.

Letters are hashed to a few symbols, which makes the words short strings over a small alphabet.  For
each distinct reduced word its full neighbourhood is generated: the word itself and everything one
inserted, deleted or replaced symbol away.  Two words one edit apart have reduced words at most one
edit apart, so joining the neighbourhoods with the reduced vocabulary loses no pair; the candidates
are then verified on the original strings.  The alphabet grows slowly with the vocabulary, so that a
reduced word stands for few words at any size.

Reduced words are compared by 64-bit codes, sums of a value per symbol times a power per place.
Every neighbour's code follows from prefix sums in one step, so a word of a hundred thousand letters
costs as many rows and not their strings; equal codes of different strings only add candidates.

Defined cases: null and empty texts hold no words, a null id counts as an empty one, repeated rows
count again, further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueweave.operators.unnest import each
from clueweave.session import written

#: Letters of a word; only A to Z have another case here.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word takes the form of a near word that is at least so many times as frequent.
TIMES = 5
#: Rows that a block of generated neighbours holds at most (or one place of one word).
_BLOCK = 1 << 19
_BASE, _MIX, _SIZE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_FIRST = ord("A")


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, run)``: the lower-cased runs of letters of ``docs`` (``doc_id``, ``text``)."""
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]+)"), F.lit(1))
    found = each(docs, found, "run", "doc_id")
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one letter wherever ``every`` divides the CRC32 of ``<doc_id>:<run>``."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    code = F.crc32(F.encode(F.concat_ws(":", name, run), "UTF-8"))
    at = (code % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(code % every == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, least_size: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)`` of the column ``word``: words long and frequent enough."""
    counts = words.where(F.length("word") >= least_size).groupBy("word")
    return counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def symbols_for(n_words: int) -> int:
    """Size of the reduced alphabet; words of seven letters then share a code with few others."""
    return min(max(4, math.ceil(n_words ** (1 / 7))), 60)


def reduce_word(word: Column, symbols: int) -> Column:
    """``word`` with each letter replaced by its symbol (``A`` on); neighbours in the alphabet and
    letters with and without accent fall apart."""
    letters = LOWER + "".join(map(chr, range(0xC0, 0x100)))
    hashed = "".join(chr(_FIRST + ((ord(c) * _BASE & (1 << 64) - 1) >> 40) % symbols) for c in letters)
    return F.translate(word, letters, hashed)


def _mixed(code: np.ndarray, size: int) -> np.ndarray:
    code = (code ^ np.uint64(size * _SIZE & (1 << 64) - 1)) * np.uint64(_MIX)
    return (code ^ code >> np.uint64(32)).view(np.int64)


class Neighbours:
    """Codes of reduced words and of their neighbours."""

    def __init__(self, symbols: int):
        # uint64 arithmetic wraps around, which is what the codes mean
        self.values = np.random.default_rng(7).integers(1, 1 << 63, symbols, np.uint64)
        self.base = np.uint64(_BASE)
        self.inverse = np.uint64(pow(_BASE, -1, 1 << 64))

    def _sums(self, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers, terms and prefix sums of words of one size (rows)."""
        size = digits.shape[1]
        powers = np.full(size + 1, self.base)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = self.values[digits] * powers[:size]
        sums = np.zeros((len(digits), size + 1), np.uint64)
        np.cumsum(terms, axis=1, out=sums[:, 1:])
        return powers, terms, sums

    def own(self, digits: np.ndarray) -> np.ndarray:
        return _mixed(self._sums(digits)[2][:, -1], digits.shape[1])

    def of(self, digits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (row, code): every string within one edit once."""
        n, size = digits.shape
        powers, terms, sums = self._sums(digits)
        total = sums[:, -1:]
        rows = np.arange(n)
        yield rows, _mixed(total[:, 0], size)
        width = max(_BLOCK // (n * len(self.values)), 1)
        for low in range(0, size + 1, width):
            inner, outer = slice(low, min(low + width, size)), slice(low, min(low + width, size + 1))
            at = np.arange(outer.start, outer.stop)
            # inserting a symbol before an equal one is inserting it behind that one
            added = self.values[None, None, :] * powers[outer][None, :, None]
            codes = (sums[:, outer] + (total - sums[:, outer]) * self.base)[:, :, None] + added
            following = np.full((n, len(at)), -1)
            following[:, : inner.stop - inner.start] = digits[:, inner]
            new = following[:, :, None] != np.arange(len(self.values))
            yield np.nonzero(new)[0], _mixed(codes[new], size + 1)
            if inner.start >= inner.stop:
                continue
            here = digits[:, inner]
            codes = (total - terms[:, inner])[:, :, None] + added[:, : here.shape[1]]
            new = here[:, :, None] != np.arange(len(self.values))
            yield np.nonzero(new)[0], _mixed(codes[new], size)
            # of a run of equal symbols the first stands for all
            codes = sums[:, inner] + (total - sums[:, inner.start + 1 : inner.stop + 1]) * self.inverse
            new = np.ones(here.shape, bool)
            begin = max(inner.start, 1)
            new[:, begin - inner.start :] = digits[:, begin : inner.stop] != digits[:, begin - 1 : inner.stop - 1]
            yield np.nonzero(new)[0], _mixed(codes[new], size - 1)


def _blocks(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, digits) of words of one size, few enough for a block."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(_BLOCK // (int(size + 1) * symbols), 1)
        for low in range(0, len(places), step):
            some = places[low : low + step]
            text = "".join(words.take(pa.array(some)).to_pylist()).encode()
            yield some, np.frombuffer(text, np.uint8).reshape(len(some), size).astype(np.int64) - _FIRST


def _own(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Neighbours(symbols)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for places, digits in _blocks(batch.column(2), symbols):
                out[places] = codes.own(digits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out)], names=["word", "n", "reduced", "code"]
            )

    return run


def _around(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Neighbours(symbols)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for places, digits in _blocks(batch.column(1), symbols):
                for rows, code in codes.of(digits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[places[rows]]), pa.array(code)], names=["own", "code"]
                    )

    return run


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``(word, n, other, other_n)``: both directions of every pair of ``words`` one edit apart.

    ``words`` holds distinct words (``word``, of letters as ``runs`` gives them) with ``n``.
    """
    words = written(words.select("word", "n"), "vocabulary")
    symbols = symbols or symbols_for(words.count())
    reduced = words.withColumn("reduced", reduce_word(F.col("word"), symbols))
    coded = written(
        reduced.mapInArrow(_own(symbols), "word string, n bigint, reduced string, code bigint"), "coded"
    )
    # equal codes of different reduced words would each bring all words of the code
    distinct = coded.groupBy("code", "reduced").agg(F.lit(0))
    around = distinct.select("code", "reduced").mapInArrow(_around(symbols), "own bigint, code bigint")
    known = coded.select("code").distinct()
    met = written(around.join(known, "code").distinct(), "reduced-pairs")
    mine = coded.select(F.col("code").alias("own"), "word", "n")
    others = coded.select("code", F.col("word").alias("other"), F.col("n").alias("other_n"))
    candidates = met.join(mine, "own").join(others, "code")
    # the threshold ends the comparison early; the length test spares most of them
    alike = F.abs(F.length("word") - F.length("other")) <= 1
    candidates = candidates.where(alike & (F.col("word") != F.col("other")))
    return candidates.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last word that forms lead to.

    Each round follows the way found so far twice; the counts along a way grow ``TIMES``-fold, so
    there are at most five rounds.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        found = written(found, "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(words: DataFrame, symbols: int | None = None, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a vocabulary ``(word, n)``.

    The form of a word is its most frequent near word (first in code-point order among equals) if
    that is at least ``times`` as frequent; the root is where forms end.
    """
    words = written(words, "words")
    near = near_pairs(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"),
    )
    near = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"),
    )
    near = written(near.select("word", "n", "n_near", "best.form", (-F.col("best.n")).alias("form_n")), "forms")
    last = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The rows of the registered query by deletion neighbourhoods and a CRC32 from its bits.
SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
spelt AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
         count(*) AS n
  FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295,
           flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                       ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))),
           lambda s, b: xor(s >> 8, entries[1 + (xor(s, b) & 255)]))) AS h
  FROM spelt, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form,
         CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON f.word = w.word AND w.next IS NULL
"""
