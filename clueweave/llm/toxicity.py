"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Two words are alike if they share subsequences of a few letters; a subsequence that is stretched
over gaps counts less, by a factor per letter it spans.  A misspelt or padded insult therefore stays
close to the plain one.  The kernel is evaluated against a few landmark words only, whose own kernel
matrix maps it to ordinary coordinates, in which a linear support vector machine is trained.

Sentences of labelled texts are what is learnt from.  A label belongs to a whole text, so a toxic
text says only that some word of some sentence is an insult (a bag): the machine starts from how
often words stand in texts of either class and then, round after round, keeps as toxic examples only
the words of toxic texts that it finds toxic itself, against all words of clean texts.  A text's
score is a logistic curve over its most toxic sentence and the number and share of toxic sentences,
calibrated on texts that the machine behind their features was not trained on.

Words are lower-cased pieces between white space.  Signs inside a word are taken out (``i.d-i*ot``),
and the word's parts are looked at as well; three or more single letters in a row form a word.  Long
words are looked at in overlapping windows.  Nothing is left out of a text.

Defined cases: null and empty texts have no sentence and get the score of a text without a toxic
one; without labels of both classes every score is 0; contradicting labels count as toxic; null
labels and ids are not learnt from; repeated rows are scored one by one.
"""

from __future__ import annotations

import copy
import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.llm.common import texts_of
from clueweave.llm.quality import _logistic, held_out
from clueweave.session import written

#: Bounds of the training sample: texts of each class, and bytes of a text.
PER_CLASS = 700
LONGEST_TEXT = 50_000
#: Texts with at least this score are predicted to be toxic.
THRESHOLD = 0.5
LANDMARKS = 128
#: Letters of a shared subsequence, and the factor per letter that it spans.
ORDER, DECAY = 3, 0.7
#: Words are looked at in windows of so many letters.
WINDOW = 24
#: A worker forgets its words when there are so many; only speed depends on it.
KEPT_WORDS = 1_000_000
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_SIGNS = re.compile(r"[\W_]+")
_NO_MARGIN = -2.0


def sentences(text: str | None) -> list[list[str]]:
    """The pieces between white space of every sentence, lower-cased; single letters in a row are
    added as one piece."""
    out = []
    for sentence in _SENTENCE_END.split((text or "").lower()):
        pieces = sentence.split()
        if not pieces:
            continue
        single = [i for i, p in enumerate(pieces) if len(p) == 1]
        if len(single) > 2:
            for _, run in itertools.groupby(enumerate(single), lambda e: e[1] - e[0]):
                places = [i for _, i in run]
                if len(places) > 2:
                    pieces.append("".join(pieces[i] for i in places))
        out.append(pieces)
    return out


def words_of(piece: str) -> list[str]:
    """What a piece is looked at as: without its signs, and its parts; long ones in windows."""
    if piece.isalnum():
        found = [piece]
    else:
        parts = [p for p in _SIGNS.split(piece) if p]
        found = list(dict.fromkeys(["".join(parts), *parts])) if parts else []
    out = []
    for word in found:
        if len(word) <= WINDOW:
            out.append(word)
        else:
            step = WINDOW // 2
            out.extend(word[i : i + WINDOW] for i in range(0, len(word) - step, step))
    return out


def _marked(word: str) -> str:
    """A word between marks; the begin counts twice, as it tells words apart best."""
    return f"\x02\x02{word}\x03"


@functools.cache
def _subsequences(size: int, order: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of every subsequence of ``order`` letters of a string, and its weight by its span."""
    places = np.array(list(itertools.combinations(range(size), order)), np.int64).reshape(-1, order).T
    return places, (decay ** (places[-1] - places[0] + 1)).astype(np.float32)


def _norms(s: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Root of the kernel of every row (one size) with itself.

    ``reach[i, k]`` weighs the pairs of equal subsequences of ``i`` letters whose second one ends
    before place ``k``.
    """
    n, width = s.shape
    reach = np.zeros((order, width + 1, n), np.float32)
    reach[0] = 1
    total = np.zeros(n, np.float32)
    square, decay = np.float32(decay * decay), np.float32(decay)
    columns = np.ascontiguousarray(s.T)
    for x in columns:
        met = np.where(columns == x, square, np.float32(0))
        total += (met * reach[order - 1, :width]).sum(axis=0)
        # from the longest down: a letter must not be used twice
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)
            reach[i] *= decay
            for k in range(width):
                run = run * decay + met[k] * reach[i - 1, k]
                reach[i, k + 1] += run
    return np.sqrt(total)


class Subsequences:
    """A linear function of the subsequences of words, divided by a word's own norm.

    The kernel of a word with a landmark is the product of their weighted subsequences, so a sum
    over landmarks is one table over the subsequences that landmarks hold.
    """

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY):
        self.order, self.decay = order, decay
        letters = sorted(set("".join(map(_marked, landmarks))))
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        self.base = len(letters) + 1  # 0 stands for letters that no landmark holds
        found = []
        for word in landmarks:
            codes = self._codes([word])
            places, weights = _subsequences(codes.shape[1], order, decay)
            norm = max(_norms(codes, order, decay)[0], 1e-9) if len(weights) else 1.0
            found.append((self._index(codes, places)[0], weights / norm))
        # row 0 of the table is for subsequences that no landmark holds
        known = np.unique(np.concatenate([index for index, _ in found]))
        self.row = np.zeros(self.base**order, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        for j, (index, weights) in enumerate(found):
            np.add.at(self.table[:, j], self.row[index], weights)

    def combined(self, weights: np.ndarray) -> Subsequences:
        """The weighted sum of the functions."""
        out = copy.copy(self)
        out.table = (self.table @ np.asarray(weights, np.float32))[:, None]
        return out

    def _codes(self, words: list[str]) -> np.ndarray:
        """Code points of words of one size."""
        marked = "".join(map(_marked, words))
        return np.frombuffer(marked.encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    def _index(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        known, place = np.unique(codes, return_inverse=True)
        small = np.array([self.letters.get(chr(c), 0) for c in known.tolist()], np.int64)
        small = small[place].reshape(codes.shape)
        index = np.zeros((len(codes), places.shape[1]), np.int64)
        for at in places:
            index = index * self.base + small[:, at]
        # a subsequence with an unknown letter is in no landmark; letters start at 1
        for at in places:
            index[small[:, at] == 0] = 0
        return index

    def of(self, words: list[str]) -> np.ndarray:
        """One row per word; words too short for a subsequence are like nothing."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        for size, rows in by_size.items():
            places, weights = _subsequences(size + 3, self.order, self.decay)
            if not len(weights):
                continue
            one = self.table.shape[1] == 1
            step = max((1 << 21) // (len(weights) if one else len(self.table)), 1)
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                codes = self._codes([words[i] for i in some])
                index = self.row[self._index(codes, places)].astype(np.int64)
                if one:
                    found = self.table[:, 0][index] @ weights[:, None]
                else:
                    index += np.arange(len(some), dtype=np.int64)[:, None] * len(self.table)
                    held = np.bincount(index.ravel(), np.tile(weights, len(some)), len(some) * len(self.table))
                    found = held.reshape(len(some), -1).astype(np.float32) @ self.table
                out[some] = found / _norms(codes, self.order, self.decay)[:, None]
        return out


@dataclass
class Model:
    landmarks: list[str]
    #: Weights of the landmarks and the constant of the machine.
    weights: list[float]
    constant: float
    #: Centre, scale and weights of the logistic curve over a text's features.
    centre: list[float]
    scale: list[float]
    curve: list[float]


class Margins:
    """Margins of pieces, kept per worker."""

    def __init__(self, landmarks: list[str], weights, constant: float, kept: int = KEPT_WORDS):
        self.machine = Subsequences(landmarks).combined(weights)
        self.constant, self.kept = constant, kept
        self.words: dict[str, float] = {}
        self.pieces: dict[str, float] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Evaluate the pieces that are not known yet."""
        if len(self.pieces) > self.kept:
            self.pieces, self.words = {}, {}
        new = {p: words_of(p) for p in pieces if p not in self.pieces}
        words = list({w for found in new.values() for w in found if w not in self.words})
        self.words.update(zip(words, (self.machine.of(words)[:, 0] + self.constant).tolist()))
        for piece, found in new.items():
            self.pieces[piece] = max((self.words[w] for w in found), default=_NO_MARGIN)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: margin of its most toxic sentence, and toxic sentences and words by number and
        share."""
        cut = [sentences(t) for t in texts]
        self.learn(set(itertools.chain.from_iterable(itertools.chain.from_iterable(cut))))
        get = self.pieces.__getitem__
        out = np.zeros((len(texts), 4))
        for row, found in enumerate(cut):
            tops = [max(map(get, s)) for s in found]
            top = max(tops, default=_NO_MARGIN)
            toxic = sum(t > 0 for t in tops)
            words = sum(m > 0 for s, t in zip(found, tops) if t > 0 for m in map(get, s))
            size = sum(map(len, found))
            out[row] = (np.clip(top, -2, 2), np.log1p(toxic), np.log1p(words), 100 * words / (size + 10))
        return out


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (last: the constant), by Newton steps
    from ``w``."""
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v):
        return (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + penalty @ (v * v)

    for _ in range(30):
        left = 1 - y * (x @ w)
        inside = left > 0
        xi, ci = x[inside], c[inside]
        slope = -2 * xi.T @ (ci * y[inside] * left[inside]) + 2 * penalty * w
        step = np.linalg.solve(2 * (xi * ci[:, None]).T @ xi + 2 * np.diag(penalty), slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-4:
            break
    return w


def _landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, n: int, n_docs) -> list[str]:
    """Unlike words that speak most for toxic texts, words of clean texts that look like those, and
    the most common words of clean texts."""
    p1, p0 = (toxic + 0.5) / (n_docs[1] + 1), (clean + 0.5) / (n_docs[0] + 1)
    gain = toxic * np.log(p1 / p0)
    order = np.lexsort((np.arange(len(words)), -gain))[: 8 * n]
    first = _unlike([words[i] for i in order if toxic[i] > 0], n // 2)
    rest = [i for i in np.argsort(-clean, kind="stable").tolist() if clean[i] > 0]
    common = [words[i] for i in rest[: n // 4]]
    pool = [words[i] for i in rest[: 20 * n]]
    like = Subsequences(first).of(pool).max(axis=1) if pool and first else np.zeros(len(pool))
    chosen = dict.fromkeys(first + common)
    for i in np.argsort(-like, kind="stable").tolist():
        if len(chosen) >= n:
            break
        chosen.setdefault(pool[i])
    return list(chosen)


def _unlike(words: list[str], n: int, most: float = 0.75) -> list[str]:
    """The first ``n`` words of which no two are more alike than ``most``."""
    if not words:
        return []
    alike = Subsequences(words).of(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < n and (not chosen or alike[i, chosen].max() <= most):
            chosen.append(i)
    return [words[i] for i in chosen]


def _train(bags: list[list[str]], y: np.ndarray, n_landmarks: int, rounds: int = 4):
    """``(landmarks, weights, constant)`` from the words of texts of both classes."""
    docs = [(int(y.size - y.sum())), int(y.sum())]
    counts = [Counter(), Counter()]
    for bag, label in zip(bags, y):
        counts[int(label)].update(bag)
    words = sorted(set(counts[0]) | set(counts[1]))
    toxic = np.array([counts[1][w] for w in words], float)
    clean = np.array([counts[0][w] for w in words], float)
    landmarks = _landmarks(words, toxic, clean, n_landmarks, docs)
    similarity = Subsequences(landmarks)
    values, vectors = np.linalg.eigh(similarity.of(landmarks).astype(float))
    keep = values > 1e-4 * values.max()
    to_space = vectors[:, keep] / np.sqrt(values[keep])
    x = np.column_stack([similarity.of(words) @ to_space, np.ones(len(words))])
    place = {w: i for i, w in enumerate(words)}
    toxic_bags = [np.array([place[w] for w in bag]) for bag, label in zip(bags, y) if label and bag]
    # to begin with: what toxic texts hold clearly more often
    weight = np.maximum(toxic / max(docs[1], 1) - 2 * (clean + 2) / max(docs[0], 1), 0)
    w = np.zeros(x.shape[1])
    for _ in range(rounds + 1):
        c = np.concatenate([weight, clean / max(docs[0], 1)])
        used = np.flatnonzero(c)
        sign = np.where(used < len(words), 1.0, -1.0)
        w = _machine(x[used % len(words)], sign, c[used], w)
        margin = x @ w
        weight = np.zeros(len(words))
        found = 0
        for bag in toxic_bags:
            positive = bag[margin[bag] > 0]
            found += len(positive) > 0
            weight[positive] += 1 / max(docs[1], 1)
        if not found:  # nothing stands out yet: the top word of every bag
            for bag in toxic_bags:
                weight[bag[margin[bag].argmax()]] += 1 / max(docs[1], 1)
    return landmarks, to_space @ w[:-1], float(w[-1])


def train(texts: list[str | None], y: np.ndarray, n_landmarks: int = LANDMARKS) -> Model:
    """Fit on texts with labels (1 toxic); the curve sees each text through the machine of the
    other half."""
    bags = [
        sorted({w for s in sentences(t) for p in s for w in words_of(p)}) for t in texts
    ]
    fold = np.zeros(len(texts), int)
    for label in (0, 1):  # halves of either class, in the given order
        fold[np.flatnonzero(y == label)[1::2]] = 1
    features = np.zeros((len(texts), 4))
    for k in (0, 1):
        mine, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(set(y[other])) < 2:
            other = np.arange(len(texts))
        half = Margins(*_train([bags[i] for i in other], y[other], n_landmarks))
        features[mine] = half.features([texts[i] for i in mine])
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    design = np.column_stack([np.ones(len(texts)), (features - centre) / scale])
    curve = _logistic(design, y.astype(float), ridge=0.1)
    landmarks, weights, constant = _train(bags, y, n_landmarks)
    return Model(landmarks, weights.tolist(), constant, centre.tolist(), scale.tolist(), curve.tolist())


class Scorer:
    def __init__(self, model: Model):
        self.margins = Margins(model.landmarks, model.weights, model.constant)
        self.centre, self.scale = np.array(model.centre), np.array(model.scale)
        self.curve = np.array(model.curve)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        features = (self.margins.features(texts) - self.centre) / self.scale
        z = np.column_stack([np.ones(len(texts)), features]) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest_text: int = LONGEST_TEXT
) -> Model | None:
    """Fit on labelled rows of ``docs`` that are not held out; None without both classes.

    At most ``per_class`` texts of each class of at most ``longest_text`` bytes go to the driver,
    chosen by a hash of their id and independent of how the tables are stored.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    rows = written(rows.join(marked, "doc_id"), "labelled")
    counts = dict(rows.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    short = rows.where(F.col("size") <= longest_text)
    chosen = {
        label: [
            r.doc_id
            for r in short.where(F.col("toxic") == label)
            .select("doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
            .collect()
        ]
        for label in (0, 1)
    }
    if not chosen[0] or not chosen[1]:
        return None
    ids = docs.sparkSession.createDataFrame(
        [(i,) for label in (0, 1) for i in chosen[label]], docs.select("doc_id").schema
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text IS NOT NULL")
    found = dict(found.groupBy("doc_id").agg(F.min("text")).collect())
    texts = [found[i] for label in (0, 1) for i in chosen[label]]
    model = train(texts, np.repeat([0, 1], [len(chosen[0]), len(chosen[1])]))
    # the sample may hold the classes in other shares than the corpus
    model.curve[0] += math.log(counts[1] / counts[0]) - math.log(len(chosen[1]) / len(chosen[0]))
    return model


def score(model: Model | None, text: Column) -> Column:
    """Probability that the whole text is toxic."""
    if model is None:
        return F.lit(0.0)
    kept: list[Scorer] = []

    def scored(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Scorer(model))
        found = [kept[0].scores(some) for some in texts_of(texts, 1 << 18)]
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    # marked so that a filter on the score does not evaluate it a second time
    return arrow_udf(scored, "double").asNondeterministic()(text)
