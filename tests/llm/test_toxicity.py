"""Toxicity: the kernel against all subsequences, and held-out accuracy with misspelt insults."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clueweave.llm import toxicity as T
from clueweave.session import get_session

DOCS = "doc_id bigint, text string, score string, toxic int, words int"
LABELS = "doc_id bigint, toxic int, quality int, text string"


@pytest.fixture(scope="module")
def spark():
    yield get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")


def weights(word, order, decay):
    found = defaultdict(float)
    word = T._marked(word)
    for places in itertools.combinations(range(len(word)), order):
        found["".join(word[i] for i in places)] += decay ** (places[-1] - places[0] + 1)
    return found


def kernel(a, b, order, decay):
    x, y = weights(a, order, decay), weights(b, order, decay)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


@pytest.mark.parametrize("order,decay", [(3, 0.7), (2, 0.5), (4, 0.9)])
def test_kernel_is_that_of_all_subsequences(order, decay):
    rng = random.Random(order)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["banana", "日本語日本"]
    landmarks = words[:7] + ["ban"]
    exact = np.array([[kernel(w, m, order, decay) for m in landmarks] for w in words])
    found = T.Subsequences(landmarks, order, decay)
    assert np.allclose(found.of(words), exact, atol=1e-4)
    some = np.linspace(-1, 1, len(landmarks))
    assert np.allclose(found.combined(some).of(words)[:, 0], exact @ some, atol=1e-4)


def test_pieces_and_words():
    assert T.sentences(None) == [] and T.sentences(" \n ") == []
    assert T.sentences("You are. a i d i o t\nX") == [["you", "are."], ["a", "i", "d", "i", "o", "t", "aidiot"], ["x"]]
    assert T.words_of("id.i-ot!") == ["idiot", "id", "i", "ot"] and T.words_of("...") == []
    long = "".join(chr(97 + i % 26) for i in range(100))
    windows = T.words_of(long)
    assert all(long[i : i + 12] in "|".join(windows) for i in range(89))


INSULTS = ("blockhead", "nitwit", "dunderling", "wretch")


def sample():
    rng = random.Random(8)
    syllables = ("tor", "el", "ba", "ni", "qua", "ser", "lo", "mi", "ga", "est")
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = sample()
    docs = [(i, t, "x", 0, 1) for i, t, _ in rows]
    docs += [docs[0], docs[0], (None, "nitwit", None, None, None), (9001, None, "", 1, 1), (9002, "", "", 1, 1), (9003, "tor " * 60000 + "wretch", "", 1, 1)]
    labels = [(i, y, 1, "t") for i, _, y in rows] + [(0, 0, 1, None), (None, 1, 1, None), (9001, 1, 0, ""), (3, None, None, None)]
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_disguised_insults(frames):
    docs, labels = frames
    model = T.fit(docs, labels)
    out = docs.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), T.score(model, F.col("text")).alias("p"))
    out = out.collect()
    assert len(out) == 606 and all(0 <= r.p <= 1 for r in out)
    truth = {i: y for i, _, y in sample()}
    judged = [(r.p >= T.THRESHOLD) == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert np.mean(judged) > 0.97
    odd = {r.doc_id: r.p for r in out}
    assert odd[9001] == odd[9002] < T.THRESHOLD <= odd[9003] and odd[None] >= T.THRESHOLD
    clean = "torel banitor quaser elmi gaest "
    disguised = ["n i t w i t", "nit.wit", "n-i-t-w-i-t", "nitxwit", "NITWIT", "dunderrling", "blo_ckhead", "blockxhead", "nitwit"]
    scores = T.Scorer(model).scores([clean] + [clean + d for d in disguised])
    assert scores[0] < T.THRESHOLD and (scores[1:] >= T.THRESHOLD).mean() >= 0.8
    # the same rows dealt in another way give the same model
    again = T.fit(docs.repartition(5), labels.repartition(2))
    assert again.landmarks == model.landmarks and np.allclose(again.curve, model.curve)


def test_without_labels(spark, frames):
    docs, labels = frames
    assert T.fit(docs, labels.where("toxic = 1")) is None
    assert T.fit(docs.limit(0), labels) is None and T.fit(docs, labels.limit(0)) is None
    assert {r.p for r in docs.select(T.score(None, F.col("text")).alias("p")).collect()} == {0.0}
    model = T.fit(docs, labels)
    assert docs.limit(0).select(T.score(model, F.col("text"))).count() == 0
