"""Spelling variants against a plain search over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clueweave.llm import spelling_variants as S
from clueweave.session import get_session

SCHEMA = "doc_id bigint, text string, word int, n string, run double, code string"
AZ = str.maketrans(S.UPPER, S.LOWER)


@pytest.fixture(scope="module")
def spark():
    yield get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")


def rows():
    rng = random.Random(3)
    base = ["kettle", "Kettles", "marmot", "ÉCLAIR", "éclairs", "aaaaaa", "aaaaaaa", "banana", "banane", "straße", "kettlé"]
    base += ["a" * 3000, "a" * 3001, "ab" * 1500]
    texts = [None, "", "123 ... ", "kettle" * 1]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 60)):
            w = rng.choice(base[:11]) if rng.random() < 0.97 else rng.choice(base)
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(("", "x", w[i] + "e", w[i] * 2)) + w[i + 1 :]
            words.append(w)
        texts.append(rng.choice((" ", ", ", "\n", "1")).join(words))
    made = [(i, t, 1, "x", 0.5, "c") for i, t in enumerate(texts)]
    return made + [made[10], made[10], (None, texts[11], None, None, None, None)]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(given, every=199):
    counts = Counter()
    for doc_id, text, *_ in given:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("every,symbols", [(199, None), (3, 4), (3, 9)])
def test_variants_equal_all_pairs(spark, every, symbols):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    runs = S.runs(docs)
    words = S.vocabulary(runs.select(S.misspelt(runs.doc_id, runs.run, every).alias("word")))
    mine = S.variants(words, symbols).collect()
    expected = brute(rows(), every)
    assert len(mine) == len(expected) and set(map(tuple, mine)) == expected
    assert any(r.form for r in mine)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.variants(S.vocabulary(S.runs(docs).select("run").withColumnRenamed("run", "word"))).count() == 0


def test_chains_end_at_their_last_word(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(26)]
    found = dict(map(tuple, S.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert found == {w: "w26" for w, _ in chain}


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_neighbourhoods_hold_every_edit_once(monkeypatch, block):
    monkeypatch.setattr(S, "_BLOCK", block)
    codes, rng = S.Neighbours(3), random.Random(4)
    for size in (1, 2, 5, 9):
        words = [[rng.randrange(3) for _ in range(size)] for _ in range(4)]
        found = [[] for _ in words]
        for some, code in codes.of(np.array(words)):
            for r, c in zip(some.tolist(), code.tolist()):
                found[r].append(c)
        for word, got in zip(words, found):
            edits = {tuple(word)} | {(*word[:i], c, *word[i + k :]) for i in range(size + 1) for c in range(3) for k in (0, 1) if i + k <= size}
            edits |= {(*word[:i], *word[i + 1 :]) for i in range(size)}
            expected = sorted(int(codes.own(np.array([e], dtype=int).reshape(1, -1))[0]) for e in edits)
            assert sorted(got) == expected
