"""Hierarchies with several parents, senses and similarities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clueweave.operators import taxonomy as T
from clueweave.session import written

EDGES = [
    ("animal", "entity"), ("pet", "entity"), ("cat", "animal"), ("dog", "animal"), ("cat", "pet"),
    ("kitten", "cat"), ("toy", "thing"),
]


def edges(spark):
    return spark.createDataFrame([(c, p, "hypernym") for c, p in EDGES], "child string, parent string, rel string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_relations_in_both_directions(spark):
    got = rows(T.related(spark.createDataFrame([("a", "b", "antonym"), ("w", "c", "part_holonym"), ("x", "y", "odd")], "child string, parent string, rel string")))
    assert got == [
        ("a", "antonym", "b"), ("b", "antonym", "a"), ("c", "part_meronym", "w"), ("w", "part_holonym", "c"), ("x", "odd", "y"),
    ]


def test_closure_depth_and_roots(spark):
    paths = T.closure(edges(spark))
    assert ("kitten", "entity", 3) in rows(paths) and ("kitten", "pet", 2) in rows(paths)
    depth = {r.node: (r.depth_min, r.depth_max) for r in T.depth(paths).collect()}
    assert depth["kitten"] == (3, 3) and depth["entity"] == (0, 0) and depth["toy"] == (1, 1)
    assert {r.node: r.root for r in T.roots(paths).collect()}["toy"] == "thing"


def test_uneven_paths(spark):
    short = spark.createDataFrame([("c", "b", ""), ("b", "a", ""), ("c", "a", "")], "child string, parent string, rel string")
    got = {r.node: (r.depth_min, r.depth_max) for r in T.depth(T.closure(short)).collect()}
    assert got["c"] == (1, 2)


def test_cycle_is_reported(spark):
    loop = spark.createDataFrame([("a", "b", ""), ("b", "a", "")], "child string, parent string, rel string")
    with pytest.raises(ValueError, match="cycle"):
        T.closure(loop)


def test_common_ancestors(spark):
    up = T.with_self(T.closure(edges(spark)))
    pairs = spark.createDataFrame([("kitten", "dog"), ("cat", "cat"), ("cat", "toy"), ("cat", "kitten"), ("cat", None)], "a string, b string")
    got = {(r.a, r.b): (r.lca, r.da, r.db) for r in T.common_ancestor(pairs, up).collect()}
    assert got == {
        ("kitten", "dog"): ("animal", 2, 1), ("cat", "cat"): ("cat", 0, 0), ("cat", "toy"): (None, None, None),
        ("cat", "kitten"): ("cat", 0, 1), ("cat", None): (None, None, None),
    }


SENSES = [
    ("moggy", "noun", 1, "cat"), ("moggy", "verb", 1, "toy"), ("hound", "noun", 1, "dog"), ("hound", "noun", 2, "toy"),
    ("run", "verb", 1, "toy"),
]


def test_word_similarity(spark):
    senses = spark.createDataFrame(SENSES, "lemma string, kind string, sense int, node string")
    pairs = spark.createDataFrame([("moggy", "hound"), ("hound", "run"), ("moggy", "nope"), ("moggy", "run")], "lemma_a string, lemma_b string")
    kinds = {(r.lemma_a, r.lemma_b): r.kind for r in T.common_kind(pairs, senses).collect()}
    assert kinds == {("moggy", "hound"): "noun", ("hound", "run"): None, ("moggy", "nope"): None, ("moggy", "run"): "verb"}
    got = {(r.lemma_a, r.lemma_b): r.similarity for r in T.word_similarity(pairs, senses, T.with_self(T.closure(edges(spark)))).collect()}
    assert got == {("moggy", "hound"): 1 / 3, ("hound", "run"): 0.0, ("moggy", "nope"): 0.0, ("moggy", "run"): 1.0}
    glosses = spark.createDataFrame([("cat", 'a small animal; "the cat sat"; kept at home')], "node string, gloss string")
    only = T.senses_with_gloss(senses, glosses).first()
    assert (only.definition, only.examples) == ("a small animal; kept at home", ["the cat sat"])


def test_published_measures(spark):
    paths = T.closure(edges(spark))
    up = T.with_self(paths)
    lca = T.common_ancestor(spark.createDataFrame([("kitten", "dog")], "a string, b string"), up)
    deep = T.depth_similarities(lca, T.depth(paths)).first()
    assert deep.wup == 2 * 1 / (3 + 2) and abs(deep.lch + math.log(4 / 6)) < 1e-12
    counts = spark.createDataFrame([("kitten", 1), ("dog", 2), ("animal", 1), ("toy", 4)], "node string, n int")
    info = T.information(counts, up)
    ic = {r.node: r.ic for r in info.collect()}
    assert ic["animal"] == -math.log(4 / 8) and ic["cat"] == ic["kitten"] == -math.log(1 / 8)
    got = T.content_similarities(lca, info).first()
    assert abs(got.lin - 2 * ic["animal"] / (ic["kitten"] + ic["dog"])) < 1e-12
    assert abs(got.jcn - 1 / (ic["kitten"] + ic["dog"] - 2 * ic["animal"])) < 1e-12


def test_closure_of_a_deep_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(T, "written", lambda df, label: stored.append(label) or written(df, label))
    chain = spark.range(1000).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    paths = T.closure(chain)
    assert len(stored) <= 12
    assert paths.count() == 1000 * 1001 // 2 and paths.where("anc - node <> dist").isEmpty()


def test_closure_keeps_every_path_length(spark):
    rng = random.Random(3)
    edges = {(a, rng.randrange(a + 1, 24)) for a in range(23) for _ in range(3)}
    exact, frontier = set(), {(a, b, 1) for a, b in edges}
    while frontier:
        exact |= frontier
        frontier = {(a, d, n + 1) for a, b, n in frontier for c, d in edges if b == c}
    found = T.closure(spark.createDataFrame(list(edges), "child int, parent int"))
    assert sorted(map(tuple, found.collect())) == sorted(exact)


def test_pairs_meet_the_hierarchy_twice(spark, monkeypatch):
    """Values come along with the nodes of a pair: the pairs are not dealt again for every look-up."""
    paths = T.closure(edges(spark))
    up = T.with_self(paths)
    info = T.information(spark.createDataFrame([("kitten", 1), ("dog", 2), ("toy", 4)], "node string, n int"), up)
    pairs = spark.createDataFrame([("kitten", "dog"), ("cat", "cat"), ("kitten", "cat"), ("cat", "toy"), ("dog", "gone")], "a string, b string")
    both = T.common_ancestor(pairs, up, info.select("node", F.col("ic").alias("value")))
    looked_up = []
    real = T.salted_join
    monkeypatch.setattr(T, "salted_join", lambda *a, **k: looked_up.append(a[2]) or real(*a, **k))
    got = {(r.a, r.b): (r.res, r.lin, r.jcn) for r in T.content_similarities(both, info).collect()}
    assert looked_up == []
    plain = T.common_ancestor(pairs, up)
    assert got == {(r.a, r.b): (r.res, r.lin, r.jcn) for r in T.content_similarities(plain, info).collect()}
    assert set(got) == {("kitten", "dog"), ("cat", "cat"), ("kitten", "cat")}
    assert both.select("a", "b", "lca", "da", "db").exceptAll(plain).isEmpty()
