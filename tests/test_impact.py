"""Top-k of summed weights against full sums."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clueweave.operators import impact
from clueweave.operators import retrieval as I
from clueweave.operators import search as Q
from clueweave.session import written


def full(entries, queries, k):
    lists = defaultdict(dict)
    for key, item, w in entries:
        lists[key][item] = w
    out = {}
    for qid, keys in queries.items():
        score = defaultdict(int)
        for key, q in keys.items():
            for item, w in lists[key].items():
                score[item] += q * w
        best = sorted(score.items(), key=lambda e: (-e[1], e[0]))[:k]
        if best:
            out[qid] = best
    return out


@pytest.mark.parametrize("block,flat", [(4, False), (4, True), (64, False)])
def test_top_sums_are_those_of_all_lists(spark, block, flat):
    rng = random.Random(block + flat)
    sizes = {f"k{i}": rng.choice((1, 3, 40, 150)) for i in range(25)}
    entries = [
        (key, f"i{item:03d}", rng.choice((5, 10)) if flat else rng.randrange(1, 60))
        for key, n in sizes.items() for item in rng.sample(range(200), n)
    ]
    queries = {q: {k: rng.choice((1, 2)) for k in rng.sample(sorted(sizes) + ["none"], rng.randrange(1, 6))} for q in range(30)}
    rows = written(spark.createDataFrame(entries, "key string, item string, w bigint").repartition(3), "t")
    asked = spark.createDataFrame([(q, k, f) for q, ks in queries.items() for k, f in ks.items()], "qid int, key string, q int")
    found, read = impact.top_sums(impact.index(rows, block), rows, asked, 4)
    got = defaultdict(list)
    for r in found.orderBy("qid", "rank").collect():
        got[r.qid].append((r.item, r.score))
    assert dict(got) == full(entries, queries, 4)
    assert read.where("entries_read > entries").isEmpty()


def test_a_hub_is_not_expanded(spark):
    """A word that 100,000 others point to costs a block, not its list."""
    hub = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("src"), F.lit("HUB").alias("dst"), F.lit(10).alias("w"))
    rare = spark.createDataFrame([(f"w{i}", "RARE", 100 + i) for i in range(20)], "src string, dst string, w int")
    edges = written(hub.unionByName(rare), "edges")
    entries = edges.select(F.col("dst").alias("key"), F.col("src").alias("item"), "w")
    asked = spark.createDataFrame([(q, k, 1) for q in range(5) for k in ("HUB", "RARE")], "qid int, key string, q int")
    found, read = impact.top_sums(impact.index(entries), entries, asked, 10)
    assert {(r.qid, r.item, r.score) for r in found.collect()} == {(q, f"w{i}", 110 + i) for q in range(5) for i in range(10, 20)}
    assert all(r.entries == 100_020 and r.entries_read <= 2 * impact.BLOCK + 20 for r in read.collect())
    words = spark.createDataFrame([(1, "HUB"), (1, "HUB"), (2, "?")], "qid int, word string")
    assert Q.expanded_rows(edges, words) == 100_000
    for expand in (10**9, 1):
        one = Q.batch_top_k(edges, words, "w", 3, expand)
        assert [(r.word, r.score) for r in one.orderBy("rank").collect()] == [("w0", 10), ("w1", 10), ("w10", 10)]


def test_retrieval_reads_a_part_of_the_postings(spark):
    rng = random.Random(4)
    terms = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(d, rng.choices(terms, weights, k=rng.randrange(3, 40))) for d in range(3000)]
    docs += [(9000 + d, docs[7][1]) for d in range(5)]
    frame = spark.createDataFrame(docs, "doc_id int, toks array<string>")
    tf = written(I.term_counts(frame), "tf")
    idf = written(I.idf(tf, frame), "idf")
    queries = spark.createDataFrame([(q, t, 1) for q in range(12) for t in {"t0", "t1", f"t{50 + q}", f"t{100 + q}"}], "qid int, term string, n int")
    entries = I.impact_entries(tf, idf)
    found, read = I.retrieve_indexed(impact.index(entries, 32), entries, idf, queries, 5)
    values = I.normalised(I.tfidf(tf, idf))
    q = queries.join(idf, "term").select("qid", "term", (F.col("n") * F.col("idf")).alias("q"))
    size = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size"))
    exact = values.join(q, "term").join(size, "qid").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("tfidf") * F.col("q") / F.col("size")), 6).alias("similarity"))
    expected = Q.top_k(exact, ["qid"], [F.desc("similarity"), F.col("doc_id")], 5)
    shape = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.similarity) for r in df.collect())
    assert shape(found) == shape(expected)
    total = read.agg(F.sum("entries").alias("all"), F.sum("entries_read").alias("read")).first()
    assert total.read < total.all / 2


def test_sums_keep_few_rows_of_each_group(spark, monkeypatch):
    """Items are scored in groups and in parts of the queries; nothing but the best of each leaves them."""
    monkeypatch.setattr(impact, "ENTRIES", 50)
    monkeypatch.setattr(impact, "ASKED", 7)
    monkeypatch.setattr(impact, "CELLS", 20)
    rng = random.Random(5)
    entries = [(f"k{k}", f"i{i:03d}", rng.randrange(1, 5)) for k in range(8) for i in rng.sample(range(90), 60)]
    queries = {q: {k: 1 for k in rng.sample([f"k{i}" for i in range(9)], 4)} for q in range(12)}
    rows = written(spark.createDataFrame(entries + [("k1", None, 9)], "key string, item string, w bigint"), "t")
    asked = written(spark.createDataFrame([(q, k, f) for q, ks in queries.items() for k, f in ks.items()], "qid int, key string, q int"), "q")
    got = defaultdict(list)
    for r in impact.top_of_sums(rows, asked, 3).orderBy("qid", "rank").collect():
        got[r.qid].append((r.item, r.score))
    assert dict(got) == full(entries, queries, 3)
    scored = impact.sums(rows, asked.withColumn("need", F.lit(None).cast("double")), 3).where("item IS NOT NULL")
    # ten groups of items, tables of at least one item: far fewer rows than queries times items
    assert scored.groupBy("qid").count().agg(F.max("count")).first()[0] < 90


def test_paths_are_found_once_for_each_word(spark):
    graph = spark.createDataFrame(
        [("A", "X", 10), ("B", "A", 6), ("B", "X", 1), ("C", "X", 4)], "src string, dst string, tenths bigint"
    )
    asked = spark.createDataFrame([(q, w) for q in range(50) for w in ("X", "X", "?")], "qid int, word string")
    paths = Q.distance_two_paths(graph, asked, "tenths", 10)
    assert sorted(map(tuple, paths.collect())) == [("X", "A", 20), ("X", "B", 6), ("X", "C", 8)]
    for expand in (10**9, 1):
        best = Q.batch_top_k(paths.select("src", F.col("origin").alias("dst"), "w2"), asked, "w2", 2, expand)
        assert sorted((r.word, r.score, r["rank"]) for r in best.where("qid = 7").collect()) == [("A", 20, 1), ("C", 8, 2)]


def test_stored_blocks_are_not_dealt_again(spark):
    """The first block of a list is found from the lists asked for; the items of all others stay where they are."""
    rows = spark.createDataFrame([(f"k{i % 3}", i, 100 - i) for i in range(50)], "key string, item long, w long")
    blocks = impact.index(rows, 4)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    asked = spark.createDataFrame([(1, "k0", 2), (1, "k1", 1)], "qid long, key string, q long")
    found, _ = impact.top_sums(blocks, rows, asked, 3)
    assert [(r.item, r.score) for r in found.orderBy("rank").collect()] == [(0, 200), (3, 194), (6, 188)]


def test_blocks_are_cut_where_they_are_sorted(spark):
    """Entries are dealt once for the index; a block goes on over the batches of its task (F8)."""
    rng = random.Random(6)
    entries = [(rng.choice([None, "a", "b", "c"]), f"i{i:04d}", float(rng.randrange(1, 30))) for i in range(900)]
    rows = written(spark.createDataFrame(entries, "key string, item string, w double").repartition(3), "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = impact.index(rows, 16).orderBy("slot").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in {e[0] for e in entries}:
        own = [b for b in blocks if b.key == key]
        found = [(e.item, e.w) for b in own for e in b["items"]]
        assert found == [e[1:] for e in sorted((e for e in entries if e[0] == key), key=lambda e: (-e[2], e[1]))]
        assert all(b.n == len(b["items"]) and b.top == b["items"][0].w for b in own)
        # short blocks stand at the end of a key's rows in a task
        assert max(b.n for b in own) == 16 and sum(b.n < 16 for b in own) <= 8


def test_terms_are_shuffled_as_lists(spark):
    """Counts, and vectors of length one, take one shuffle each (F8, F9)."""
    table = [(1, ["A", "B", "A", None]), (1, ["A"]), (2, []), (3, None), (None, ["A", "C"]), (None, ["C"])]
    docs = spark.createDataFrame(table, "doc_id int, toks array<string>")
    tf = I.term_counts(docs)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and tf.schema.simpleString() == "struct<doc_id:int,term:string,n:bigint>"
    assert sorted(map(str, map(tuple, tf.collect()))) == sorted(map(str, [(1, "A", 3), (1, "B", 1), (None, "A", 1), (None, "C", 2)]))
    values = spark.createDataFrame([(1, "A", 3.0), (1, "B", 4.0), (2, "A", 0.0), (None, "A", 1.0)], "doc_id int, term string, tfidf double")
    unit = I.normalised(values)
    plan = unit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, unit.collect())) == [(1, "A", 0.6), (1, "B", 0.8)]


def test_kept_terms_are_stored_before_pairs_meet_them(spark, tmp_path, monkeypatch):
    """Stored terms have a real size: where they are few, the pairs are not dealt (F9)."""
    from clueweave.plans import ml_plans

    docs = [(i, f"word{i % 3} again thing{i} other{i} more{i % 2} text", "en") for i in range(12)] + [(1, "word1 again", "fr"), (20, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    real = ml_plans.written

    def noted(df, label):
        seen[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(ml_plans, "written", noted)
    found = ml_plans.feature_rows(spark, str(tmp_path))
    assert [*seen] == ["tf", "idf", "kept", "edges"]
    assert "BroadcastHashJoin" in seen["edges"] and "SortMergeJoin" not in seen["edges"]
    assert found.count() > 0 and found.columns == ["label", "feature", "value"]
