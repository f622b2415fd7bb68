"""TF-IDF, classifiers and components against direct computations."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clueweave.operators import classify as C
from clueweave.operators import pca as A
from clueweave.operators import retrieval as I

DOCS = {1: "a b b c", 2: "a c d", 3: "a", 4: "d d e", 5: ""}


def docs(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in DOCS.items()], "doc_id bigint, toks array<string>")


def expected_tfidf():
    counts = {i: Counter(t.split()) for i, t in DOCS.items()}
    df = Counter(w for c in counts.values() for w in c)
    weight = {w: math.log((len(DOCS) + 1) / (n + 1)) for w, n in df.items()}
    return {(i, w): n * weight[w] for i, c in counts.items() for w, n in c.items()}, weight


def test_tfidf_and_retrieval(spark):
    source = docs(spark)
    tf = I.term_counts(source)
    weights = I.idf(tf, source)
    values, weight = expected_tfidf()
    got = {(r.doc_id, r.term): r.tfidf for r in I.tfidf(tf, weights).collect()}
    assert got.keys() == values.keys() and all(abs(got[k] - v) < 1e-12 for k, v in values.items())
    unit = I.normalised(I.tfidf(tf, weights)).groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in unit.collect())
    query = Counter("b d d zzz".split())
    q = {w: n * weight[w] for w, n in query.items() if w in weight}
    expected = {}
    for i in DOCS:
        length = math.sqrt(sum(v * v for (d, _), v in values.items() if d == i))
        dot = sum(v * q.get(w, 0) for (d, w), v in values.items() if d == i)
        if dot:
            expected[i] = round(dot / length / math.sqrt(sum(x * x for x in q.values())), 6)
    asked = spark.createDataFrame([(7, w, n) for w, n in query.items()], "qid int, term string, n int")
    best = I.retrieve(tf, weights, asked, 2).orderBy("rank").collect()
    order = sorted(expected.items(), key=lambda kv: (-kv[1], kv[0]))[:2]
    assert [(r.doc_id, r.similarity) for r in best] == order


def test_feature_reduction_keeps_ties(spark):
    values = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (2, "c", 2.0), (2, "d", 1.0)], "doc_id int, term string, tfidf double")
    assert {r.term for r in I.reduce_features(values, 2).collect()} == {"a", "b", "c"}
    assert [r.term for r in I.strongest(values, 2).collect()] == ["a", "b"]


def test_hashed_tfidf_has_unit_length(spark):
    hashed = I.hashed_tfidf(docs(spark), 64).select(vector_to_array("features").alias("v")).collect()
    lengths = [math.sqrt(sum(x * x for x in r.v)) for r in hashed]
    assert all(abs(x - 1) < 1e-9 or x == 0 for x in lengths)


def test_sparse_vectors(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (2, "y", 4.0)], "doc_id int, term string, v double")
    b = spark.createDataFrame([("x", 3.0), ("z", 9.0)], "term string, v double")
    assert [tuple(r) for r in I.sparse_dot(a, b, "doc_id").collect()] == [(1, 6.0)]
    summed = {(r.doc_id, r.term): r.v for r in I.sparse_add(a, I.sparse_scale(a, 2.0), "doc_id").collect()}
    assert summed == {(1, "x"): 6.0, (1, "y"): 3.0, (2, "y"): 12.0}
    assert {r.doc_id: r.norm for r in I.sparse_norm(a, "doc_id").collect()} == {1: math.sqrt(5), 2: 4.0}


def letter_rows(spark):
    rng = random.Random(2)
    pools = {0: "AAABBC", 1: "CCDDDE", 2: "EEFAAZ"}
    rows = [(i, i % 3, "".join(rng.choice(pools[i % 3]) for _ in range(12)) + " É?") for i in range(90)]
    return spark.createDataFrame(rows, "doc_id bigint, label bigint, t string")


def test_letter_counts(spark):
    wide = C.letter_features(spark.createDataFrame([(1, "ABBA Z-É")], "doc_id int, t string"), "t").first()
    assert (wide.f_a, wide.f_b, wide.f_z, wide.f_e) == (2, 2, 1, 0)


def test_naive_bayes_equals_mllib(spark):
    rows = letter_rows(spark)
    examples = rows.withColumn("counts", C.letter_array(F.col("t")))
    model = C.naive_bayes(examples)
    predicted = C.predict(model, examples)
    mine = {r.doc_id: r.predicted for r in predicted.collect()}
    fitted_labels = model.first().model
    used = [c for c, v in zip(C.LETTERS, fitted_labels[0]["values"]) if v is not None]
    assert used == list("ABCDEFZ")
    vectors = C.labelled_vectors(C.letter_features(rows, "t"), [f"f_{c.lower()}" for c in used], "label")
    fitted = C.train_naive_bayes(vectors)
    theirs = {r.doc_id: int(r.prediction) for r in fitted.transform(vectors).collect()}
    assert mine == theirs
    assert np.allclose([one.prior for one in fitted_labels], fitted.pi.toArray())
    shown = [[v for v in one["values"] if v is not None] for one in fitted_labels]
    assert np.allclose(shown, fitted.theta.toArray())
    report = C.accuracy(predicted).first()
    assert report.n_test == 90 and report.accuracy > 0.9


def test_naive_bayes_without_known_features(spark):
    examples = letter_rows(spark).withColumn("counts", C.letter_array(F.col("t")))
    strange = spark.createDataFrame([(1, 0, "QQ"), (2, 0, ""), (3, None, "AAAB")], "doc_id long, label long, t string")
    strange = strange.withColumn("counts", C.letter_array(F.col("t")))
    got = {r.doc_id: r.predicted for r in C.predict(C.naive_bayes(examples), strange).collect()}
    assert got == {1: None, 2: None, 3: 0}
    empty = C.naive_bayes(strange.where("doc_id = 3"))
    assert empty.first().model == [] and C.predict(empty, strange).where("predicted IS NOT NULL").count() == 0


def test_tree_and_vectors(spark):
    rows = letter_rows(spark)
    vectors = C.labelled_vectors(C.letter_features(rows, "t"), [f"f_{c.lower()}" for c in C.LETTERS], "label")
    tree = C.train_tree(vectors)
    right = tree.transform(vectors).where("prediction = label").count()
    assert right > 80 and tree.depth <= 20
    tall = spark.createDataFrame([(5, 0, 1.5), (5, 2, 2.5), (6, 1, 1.0)], "label int, index bigint, v double")
    dense = {r.label: list(r.features.toArray()) for r in C.tall_to_vectors(tall, 3).collect()}
    assert dense == {5: [1.5, 0.0, 2.5], 6: [0.0, 1.0, 0.0]}


def test_splits(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    share = ids.where(C.hash_split(ids, "doc_id", "cc")).count() / 1000
    assert 0.75 < share < 0.85
    train, test = C.random_split(ids, [0.8, 0.2])
    assert train.count() + test.count() == 1000


def low_rank(missing):
    rng = np.random.default_rng(1)
    y = rng.standard_normal((120, 2)) @ np.diag([3.0, 1.5]) @ rng.standard_normal((2, 6)) + 5
    y += 0.05 * rng.standard_normal(y.shape)
    holes = rng.random(y.shape) < missing
    return y, holes


def test_column_stats(spark):
    df = spark.createDataFrame([([1.0, None],), ([3.0, 2.0],)], "y array<double>")
    got = {r.pos: r for r in A.percent_variance(A.column_stats(df, "y")).collect()}
    assert (got[0].n, got[0].mean, got[0].variance, got[0].percent) == (2, 2.0, 2.0, 100.0)
    assert (got[1].n, got[1].mean, got[1].variance) == (1, 2.0, None)


def test_ppca_complete_rows_match_pca(spark):
    y, _ = low_rank(0.0)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(y)], "id bigint, y array<double>").repartition(4)
    fitted = A.ppca(df, "id", "y", k=2)
    values, vectors = np.linalg.eigh(np.cov(y.T))
    top = vectors[:, np.argsort(values)[::-1][:2]]
    assert np.allclose(np.abs(np.sum(top * fitted.loadings, axis=0)), 1, atol=1e-2)
    assert np.allclose(fitted.eigenvalues, np.sort(values)[::-1][:2], rtol=1e-2)
    _, loadings, shares = A.pca(df, "y", 2)
    assert np.allclose(np.abs(np.sum(loadings * top, axis=0)), 1, atol=1e-6) and shares.sum() > 0.99
    assert abs(fitted.percent.sum() - 100 * shares.sum()) < 1


def plain_rounds(y, holes, rounds, k=2, seed=11):
    """The original rounds: rows remember their scores, hidden cells follow them one round behind."""
    hidden_mean = np.nanmean(np.where(holes, np.nan, y), axis=0)
    y = np.where(holes, 0.0, y - hidden_mean)
    (n, d), missing = y.shape, holes.sum()
    c = np.random.default_rng(seed).standard_normal((d, k))
    x = y @ c @ np.linalg.inv(c.T @ c)
    noise = (np.where(holes, 0.0, x @ c.T - y) ** 2).sum() / (n * d - missing)
    for _ in range(rounds):
        sx = np.linalg.inv(np.eye(k) + c.T @ c / noise)
        filled = np.where(holes, x @ c.T, y)
        x = filled @ c @ sx / noise
        c = filled.T @ x @ np.linalg.inv(x.T @ x + n * sx)
        noise = (((filled - x @ c.T) ** 2).sum() + n * np.sum(c.T @ c * sx) + missing * noise) / (n * d)
    return c, noise


def test_extrapolation_reaches_the_fixed_point_of_a_slow_map():
    slow = np.array([0.999, 0.99, 0.5])
    point, faster = np.array([5.0, -3.0, 2.0]), A.Extrapolation()
    for _ in range(12):
        point = faster.after(point, slow * point + 1 - slow, float(((point - 1) ** 2).sum()))
    assert np.allclose(point, 1, atol=1e-5)


def test_ppca_fills_missing_cells(spark):
    y, holes = low_rank(0.1)
    rows = [(i, [None if h else float(v) for v, h in zip(row, hole)]) for i, (row, hole) in enumerate(zip(y, holes))]
    fitted = A.ppca(spark.createDataFrame(rows, "id bigint, y array<double>"), "id", "y", k=2, threshold=1e-7)
    assert fitted.rounds <= 60
    loadings, noise = plain_rounds(y, holes, 4000)
    basis = np.linalg.qr(loadings)[0]
    assert np.allclose(basis @ basis.T, fitted.loadings @ fitted.loadings.T, atol=1e-4)
    assert np.isclose(noise, fitted.noise, rtol=1e-4)
    filled = np.array([r.y for r in fitted.completed.orderBy("id").collect()])
    assert np.allclose(filled[~holes], y[~holes])
    assert np.abs(filled - y)[holes].mean() < 0.3 * np.abs(y - y.mean(0))[holes].mean()


def test_hashed_counts_and_collisions(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 4), (2, "a", 1)], "doc_id int, term string, n bigint")
    sizes = spark.createDataFrame([(1,), (1 << 20,)], "buckets bigint")
    place = lambda t, m: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % m
    got = {(r.doc_id, r.buckets, r.bucket): r.n for r in I.hashed_counts(tf, sizes).collect()}
    big = 1 << 20
    assert got == {(1, 1, 0): 7, (2, 1, 0): 1, (2, big, place("a", big)): 1, **{(1, big, place(t, big)): n for t, n in (("a", 2), ("b", 1), ("c", 4))}}
    lost = {r.buckets: (r.n_terms, r.n_used, r.n_sharing) for r in I.collisions(tf, sizes).collect()}
    assert lost == {1: (3, 1, 3), big: (3, 3, 0)}


def test_hashed_counts_meet_once_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "HASHED_PER_TASK", 7)
    rows = [(d, f"t{i}", i) for d in (*range(20), None) for i in range(1, 6)]
    tf = spark.createDataFrame(rows, "doc_id int, term string, n bigint")
    got = I.hashed_counts(tf, spark.createDataFrame([(1,), (26,)], "buckets bigint"))
    assert got.rdd.getNumPartitions() == 15  # 105 counts, 7 to a task, and no second exchange
    assert sorted(r.n for r in got.where("buckets = 1").collect()) == [15] * 21


def test_split_gains_equal_a_direct_search(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 200)
    x = rng.integers(0, 40, (200, 4)) + 20 * (y[:, None] == [0, 1, 2, 9])
    rows = [(str(c), [None if v == 0 else int(v) for v in row]) for c, row in zip(y, x)] + [(None, [1, 1, 1, 1])]
    counted = C.histograms(spark.createDataFrame(rows, "label string, counts array<bigint>"), "counts", 8)
    assert counted.count() <= 4 * 8 * 3 and counted.agg(F.sum("n")).first()[0] == 800
    gini = lambda part: 1 - sum((np.mean(part == c)) ** 2 for c in range(3))
    expected = {}
    for f in range(4):
        bins = x[:, f] * 8 // (x[:, f].max() + 1)
        for cut in range(7):
            left, right = y[bins <= cut], y[bins > cut]
            if len(left) and len(right):
                gain = gini(y) - len(left) / 200 * gini(left) - len(right) / 200 * gini(right)
                expected[f, cut] = (len(left), len(right), gain)
    got = {(r.feature, r.cut): r for r in C.split_gains(counted, 8).collect()}
    assert set(got) == set(expected)
    assert all((got[k].n_left, got[k].n_right) == e[:2] and abs(got[k].gain - e[2]) < 1e-8 for k, e in expected.items())
    best = [k for k, r in got.items() if r.best]
    assert best == [min(expected, key=lambda k: (-round(expected[k][2], 9), k))]
