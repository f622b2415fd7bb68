"""Quality classifier from compressed sizes.

One zstandard dictionary is built from labelled good texts and one from bad texts.  A text that
resembles the good ones compresses better with the good dictionary, so the normalised difference
``(bad size - good size) / larger size``, averaged over the pieces of the whole text, tells the
classes apart.  Its scale depends on how compressible the text is by itself (repetitions shrink
with any dictionary), so a logistic curve over the difference, the plain compressed ratio and
their squares and product turns it into a calibrated score.

The fit uses at most ``per_class`` labelled texts of each class, none longer than ``longest_text``
bytes: half of them for the dictionaries, half for the curve, whose constant is then corrected to
the class shares among all labelled rows.  The choice is by hash, so it does not depend on how
the tables are stored.  Scoring reads every whole text, in the scan, and shuffles nothing.

Defined cases: null and empty texts are scored like any other (no bytes); without labels of both
classes every score is 0.5; rows of ``labels`` that contradict each other count as bad.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.session import written

#: Bounds of the training sample.
PER_CLASS = 2500
LONGEST_TEXT = 50_000
DICTIONARY_BYTES = 32_768
#: A text is compressed in pieces of so many bytes, short enough for a dictionary to matter.
PIECE = 1000
LEVEL = 3
#: Texts with at least this score are predicted to be good.
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: list[float]
    scale: list[float]
    weights: list[float]


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: a fifth, by the CRC32 of the id's text (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


class Sizes:
    """``of(text)``: the size difference and the plain ratio of a text."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(words: bytes | None):
            kept = zstandard.ZstdCompressionDict(words) if words else None
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False
            )

        self.good, self.bad, self.plain = compressor(good), compressor(bad), compressor(None)

    def of(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode()
        difference = ratio = weight = 0.0
        for piece in _pieces(data):
            good, bad = len(self.good.compress(piece)), len(self.bad.compress(piece))
            share = len(piece) + 1
            difference += share * (bad - good) / max(bad, good)
            ratio += share * len(self.plain.compress(piece)) / share
            weight += share
        return difference / weight, ratio / weight


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in _pieces(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their own bytes serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _terms(features: np.ndarray) -> np.ndarray:
    a, b = features.T
    return np.column_stack([np.ones(len(a)), a, b, a * a, a * b, b * b])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps with step halving on the penalised likelihood (the constant is free)."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest_text: int = LONGEST_TEXT
) -> Model | None:
    """Fit on the labelled rows of ``docs`` that are not held out; None without both classes."""
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # ids and lengths decide which rows are taken; only the chosen texts move, to the driver
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    rows = written(rows.join(marked.where(F.col("quality").isin(0, 1)), "doc_id"), "labelled")
    counts = dict(rows.groupBy("quality").count().collect())
    if len(counts) < 2:
        return None
    chosen = {
        q: [
            r.doc_id
            for r in rows.where((F.col("quality") == q) & (F.col("size") <= longest_text))
            .select("doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
            .collect()
        ]
        for q in (0, 1)
    }
    ids = docs.sparkSession.createDataFrame(
        [(i,) for q in (0, 1) for i in chosen[q]], docs.select("doc_id").schema
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text IS NOT NULL")
    found = dict(found.groupBy("doc_id").agg(F.min("text")).collect())
    texts = {q: [found[i] for i in chosen[q]] for q in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    first = {q: t[::2] for q, t in texts.items()}
    second = {q: t[1::2] or t for q, t in texts.items()}
    good, bad = _dictionary(first[1]), _dictionary(first[0])
    sizes = Sizes(good, bad)
    found = np.array([sizes.of(t) for q in (0, 1) for t in second[q]])
    y = np.repeat([0.0, 1.0], [len(second[0]), len(second[1])])
    centre, scale = found.mean(axis=0), found.std(axis=0) + 1e-9
    weights = _logistic(_terms((found - centre) / scale), y)
    # the sample may hold the classes in other shares than the corpus
    weights[0] += math.log(counts[1] / counts[0]) - math.log(len(second[1]) / len(second[0]))
    return Model(good, bad, centre.tolist(), scale.tolist(), weights.tolist())


def score(model: Model | None, text: Column) -> Column:
    """Probability that the whole text is good."""
    if model is None:
        return F.lit(0.5)
    kept: list[Sizes] = []

    def scored(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Sizes(model.good, model.bad))
        found = np.array([kept[0].of(t.as_py()) for t in texts]).reshape(-1, 2)
        z = _terms((found - np.array(model.centre)) / np.array(model.scale)) @ np.array(model.weights)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())

    # marked so that a filter on the score does not evaluate it a second time
    return arrow_udf(scored, "double").asNondeterministic()(text)
