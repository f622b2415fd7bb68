"""Golden graphs, dictionary properties and skew handling."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import graph as G
from clueweave.operators import search as Q
from clueweave.operators import skew
from clueweave.operators import stems as S
from clueweave.operators.sums import cross_extremes, cross_totals, pair_totals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WORDS = [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E"), (6, "F")]
NEIGHBORS = [
    (1, 2, 5), (1, 3, 2), (2, 1, 5), (3, 1, 2), (3, 4, 4), (3, 5, 9), (4, 3, 4), (5, 3, 9), (5, 6, 9), (6, 5, 9),
]


def six_nodes(spark):
    words = spark.createDataFrame(WORDS, "wid bigint, word string")
    return words, spark.createDataFrame(NEIGHBORS, "wid_from bigint, wid_to bigint, tenths bigint")


def test_association_over_stored_tables(spark):
    words, neighbors = six_nodes(spark)

    def ask(*query):
        found = Q.associate_indexed(words, neighbors, list(query), "tenths")
        return [tuple(r) for r in found.select("word", "score").collect()]

    assert ask("A", "E") == [("C", 11), ("F", 9), ("B", 5)]
    assert ask("A") == [("B", 5), ("C", 2)]
    assert ask("Z") == []


def test_association_of_older_graph(spark):
    names = {1: "rock", 2: "head", 3: "come", 4: "justforadjacency"}
    edges = [(1, 2, 1), (1, 4, 2), (2, 1, 3), (2, 3, 7), (2, 4, 4)]
    graph = spark.createDataFrame([(names[a], names[b], w) for a, b, w in edges], "src string, dst string, w bigint")
    found = Q.associate(graph, ["come", "justforadjacency"], "w", 10).collect()
    assert [tuple(r) for r in found] == [("head", 11), ("rock", 2)]


def test_two_hop_keeps_paths_over_the_threshold(spark):
    _, neighbors = six_nodes(spark)
    edges = neighbors.select(F.col("wid_from").alias("src"), F.col("wid_to").alias("dst"), "tenths")
    found = {(r.src, r.dst): r.w for r in G.two_hop(edges, "tenths", 10).collect()}
    assert found[(1, 5)] == 18 and (1, 4) not in found
    best = {}
    for a, b, w in NEIGHBORS:
        best[(a, b)] = max(best.get((a, b), 0), 10 * w)
    for (a, m, v), (n, c, w) in itertools.product(NEIGHBORS, NEIGHBORS):
        if m == n:
            best[(a, c)] = max(best.get((a, c), 0), v * w)
    assert found == {k: w for k, w in best.items() if w >= 10}


def test_searches_are_the_same_when_every_key_is_salted(spark, monkeypatch):
    """All joins of the two-hop graph and the batched searches, with and without pieces."""
    rng = random.Random(8)
    triples = {(rng.choice("ABCDE"), rng.choice("ABCDE")): rng.choice([1, 4, 6, 10]) for _ in range(40)}
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in triples.items()], "src string, dst string, tenths bigint")
    asked = spark.createDataFrame([(q, rng.choice("ABCDE")) for q in range(6) for _ in range(2)], "qid int, word string")

    def answers():
        return (
            rows(G.two_hop(graph, "tenths", 10)),
            rows(Q.batch_scores(graph, asked, "tenths")),
            rows(Q.distance_two_scores(graph, asked, "tenths", 10)),
        )

    plain = answers()
    real = skew.heavy_keys
    monkeypatch.setattr(skew, "heavy_keys", lambda rows_, key, share, floor: real(rows_, key, 50, 1))
    assert answers() == plain


def test_salted_join_is_the_plain_join(spark):
    rng = random.Random(5)
    big = [(rng.choice([7] * 20 + list(range(6))), i) for i in range(300)]
    other = [(k, f"v{k}-{i}") for k in range(9) for i in range(2)]
    left = spark.createDataFrame(big, "k int, id int")
    right = spark.createDataFrame(other, "k int, v string")
    hot = {r.k: r.salts for r in skew.heavy_keys(left, "k", share=10, floor=1)}
    assert 7 in hot and hot[7] > 1 and len(hot) < 10
    for how in ("inner", "left"):
        salted = skew.salted_join(left, right, ["k"], "k", F.col("id"), how=how, share=10, floor=1)
        assert rows(salted.select("k", "id", "v")) == rows(left.join(right, "k", how).select("k", "id", "v"))


def test_dictionary_is_dense_and_sorted(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    built = D.build(spark.createDataFrame([(w,) for w in words], "word string").repartition(8))
    assert rows(built) == list(enumerate(sorted(set(words))))
    back = D.get_word(D.get_id(spark.createDataFrame([("A",), ("A",), ("nope",)], "word string"), built).select("wid"), built)
    assert [r.word for r in back.collect()] == ["A", "A"]


def test_dictionary_of_nothing(spark):
    assert D.build(spark.createDataFrame([], "word string")).count() == 0
    assert D.max_id(spark.createDataFrame([], "wid bigint"), "wid").first().max_id == -1


def test_combine_versions(spark):
    edges = spark.createDataFrame(
        [("X", "A", 10), ("X", "A", 6), ("X", "B", 1), ("X", "X", 4), ("Y", "A", 1)],
        "src string, dst string, tenths bigint",
    )
    assert rows(G.combine_norm(edges)) == [("X", "A", 1000000), ("X", "X", 250000), ("Y", "A", 1000000)]
    assert ("X", "B", 62500) in rows(G.combine_norm(edges, keep_weak=True))
    assert rows(G.combine_max(edges)) == [("X", "A", 10), ("X", "B", 1), ("Y", "A", 1)]


def test_normalised_row_maximum_is_one(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame(
        [(rng.choice("PQR"), rng.choice("STUV"), rng.choice([1, 4, 6, 10])) for _ in range(200)],
        "src string, dst string, tenths bigint",
    )
    tops = G.combine_norm(edges).groupBy("src").agg(F.max("micro").alias("m")).collect()
    assert {r.m for r in tops} == {1000000}


def test_distance_two_search(spark):
    graph = spark.createDataFrame(
        [("P", "Q", 10), ("R", "P", 6), ("R", "Q", 2), ("S", "T", 10)], "src string, dst string, tenths bigint"
    )
    query = spark.createDataFrame([(1, "Q"), (1, "Q"), (1, "unknown")], "qid int, word string")
    best = Q.distance_two_top_k(graph, query, "tenths", 10).orderBy("rank").collect()
    assert [(r.word, r.score2 / 20) for r in best] == [("P", 1.0), ("R", 0.3)]


def test_distance_two_keeps_every_query_word(spark):
    """A relay tied to two query words passes both on."""
    graph = spark.createDataFrame([("P", "Q", 10), ("P", "U", 10), ("R", "P", 6)], "src string, dst string, tenths bigint")
    query = spark.createDataFrame([(1, "Q"), (1, "U")], "qid int, word string")
    found = {r.word: r.score2 for r in Q.distance_two_scores(graph, query, "tenths", 10).collect()}
    assert found == {"P": 40, "R": 12}


def test_hit_rate_counts_unanswered_queries(spark):
    answers = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "qid int, word string")
    expected = spark.createDataFrame([(1, "B"), (2, "D"), (3, "E")], "qid int, word string")
    got = Q.hit_rate(answers, expected).first()
    assert (got.n_queries, got.n_hits, got.precision) == (3, 1, 1 / 3)


def test_stems(spark):
    vocabulary = spark.createDataFrame(
        [(w,) for w in ("CAT", "CATS", "WALK", "WALKED", "WALKER", "IS", "XYZ", "S")], "form string"
    )
    stems = S.derive_stems(vocabulary)
    assert rows(stems.select("form", "stem")) == [("CATS", "CAT"), ("WALKED", "WALK"), ("WALKER", "WALK")]
    table = spark.createDataFrame(
        [("CATS", "CAT"), ("CATS", "CATS"), ("IS", "IS"), ("IS", "BE")], "form string, stem string"
    )
    forms = spark.createDataFrame([("CATS",), ("IS",), ("XYZ",)], "form string")
    assert rows(S.reduce_forms(forms, table)) == [("CATS", "CAT"), ("IS", "BE"), ("XYZ", "XYZ")]
    assert rows(S.reduce_forms_web(forms, table)) == [("CATS", "CAT"), ("IS", "BE")]


def test_second_graph_version_families(spark):
    bag = spark.createDataFrame(
        [("clues", ["CATS", "EYE"], ["CAT", "EYE"], ["BIG"], ["BIG"])],
        "category string, words array<string>, words_stem array<string>, defs array<string>, defs_stem array<string>",
    )
    found = rows(G.combine_max(G.all_edges_v2(bag)))
    assert found == sorted(
        [
            ("CATS", "CAT", 10), ("CAT", "CATS", 10), ("CAT", "EYE", 6), ("EYE", "CAT", 6),
            ("CAT", "CATS EYE", 6), ("CATS EYE", "CAT", 6), ("EYE", "CATS EYE", 6), ("CATS EYE", "EYE", 6),
            ("BIG", "CATS EYE", 1), ("CATS EYE", "BIG", 4),
        ]
    )


def test_unequal_lengths_pair_up_to_the_shorter(spark):
    bag = spark.createDataFrame(
        [(["A", "B"], ["A1"], [], [])],
        "words array<string>, words_stem array<string>, defs array<string>, defs_stem array<string>",
    )
    assert rows(G.norm_stem_edges(bag).select("src", "dst")) == [("A", "A1"), ("A1", "A")]


def test_bags_of_records(spark):
    puzzles = spark.createDataFrame(
        [([("CAT", "pet"), ("DOG", "other pet")],), ([],)], "words array<struct<word: string, clue: string>>"
    )
    entries = spark.createDataFrame(
        [("cat", ["feline"], None, ["puss"], ["dog"], ["dog"]), ("void", None, None, None, None, None)],
        "word string, definitions array<string>, examples array<string>, equivalents array<string>,"
        " associated array<string>, other array<string>",
    )
    assert rows(B.entry_bags(puzzles, entries)) == sorted(
        [
            ("clues", "CAT", "pet"), ("clues", "DOG", "other pet"), ("definitions", "cat", "feline"),
            ("equivalents", "cat", "puss"), ("associated", "cat", "dog"), ("associated", "cat", "dog"),
        ]
    )
    cleaned = B.clean(spark.createDataFrame([("cat's", "A  pet!"), ("--", "x"), ("y", "…")], "word string, text string"))
    assert [(r.words, r.defs) for r in cleaned.collect()] == [(["CAT"], ["A", "PET"])]
    weighed = B.weigh(spark.createDataFrame([("clues",), ("nothing",)], "category string"))
    assert rows(weighed) == [("clues", 10), ("nothing", 0)]


def test_chat_source_holds_whole_pages(spark, tmp_path):
    from clueweave.plans import standins as V

    html = '<html lang="fr"><title>Cats</title><script>x()</script><p>purr &amp; sleep</p></html>'
    tables = {
        "conversations": ([(1, 0, "user", "ask"), (1, 1, "assistant", "say"), (1, 3, "assistant", None)], "conv_id bigint, turn bigint, role string, text string"),
        "benchmark": ([(7, "item")], "item_id bigint, text string"),
        "pages": ([(3, "u", html), (4, "v", None)], "page_id bigint, url string, html string"),
    }
    for name, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    source = V.token_rows(V.chat_page_text(spark, str(tmp_path)))
    got = {(r.category, r.src_id): r.toks for r in source.where("toks IS NOT NULL").collect()}
    assert got[("associated", "3")] == ["CATS", "PURR", "SLEEP"]
    assert got[("definitions", "1:1")] == ["SAY"] and got[("clues", "1:0")] == ["ASK"] and got[("equivalents", "7")] == ["ITEM"]


def test_queries_on_chats_hold_the_words_of_whole_pages():
    """The rows of a page's body, not only of its title, show in every result."""
    import duckdb

    from clueweave.plans import ORACLES

    names = """edges_v2_all graph_combine_max graph_two_hop stem_reduce stem_reduce_web text_clean graph_search_dist1
        graph_search_dist2 search_batch_topk solver_batch eval_hits_at_5 bag_text_v1 bag_text_v2 crossing_counts
        integrity_fk edges_norm_stem stem_index_file""".split()
    title = "<html><title>zebra yak the idiot</title></html>"
    # entries of eight tokens after the title's four: the benchmark's first word stands beside its others
    pairs = "".join(f"<p>cat {w} {'zebra ' * 6}</p>" for w in ("purr", "sleeps", "the", "idiot"))
    body = title.replace("</html>", f"<p>cat dogs the idiot</p><p>purr sleeps sleep dog cat dogs purr the</p>{pairs}</html>")
    found = {}
    for kind, html in (("title", title), ("body", body)):
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations AS SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, 'ask me now' AS text")
        con.execute("CREATE TABLE benchmark AS SELECT 7 AS item_id, 'cat dogs purr sleeps the idiot' AS text")
        con.execute("CREATE TABLE pages AS SELECT 3 AS page_id, 'u' AS url, ? AS html", [html])
        con.execute("CREATE TABLE lineitem AS SELECT 1 AS l_partkey, 1 AS l_orderkey")
        con.execute("CREATE TABLE part AS SELECT 1 AS p_partkey")
        con.execute("CREATE TABLE orders AS SELECT 1 AS o_orderkey")
        con.execute("CREATE TABLE labels AS SELECT 1 AS doc_id")
        con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id")
        found[kind] = {name: sorted(map(str, con.execute(ORACLES[name]).fetchall())) for name in names}
    assert [n for n in names if found["title"][n] == found["body"][n]] == []


def test_totals_of_chunks_of_any_size(spark):
    rng = random.Random(5)
    words = [None, "", "A", "A B", "É", *"CDEFG"]
    table = [
        (rng.choice(words), rng.choice(words), rng.choice([None, 1, 4, 6, 10])) for _ in range(400)
    ] + [("long", str(n % 300), 1) for n in range(600)] + [("void", "A", None)]
    pairs = spark.createDataFrame(table, "src string, dst string, w bigint").repartition(5)
    sums = pairs.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    tops = sums.groupBy("src").agg(F.max("w").alias("m")).withColumnRenamed("src", "of")
    wanted = sums.join(tops, F.col("src").eqNullSafe(F.col("of"))).select("src", "dst", "w", "m")
    wanted = Counter(map(tuple, wanted.collect()))
    for chunk in (1, 900, 1 << 20):
        assert Counter(map(tuple, pair_totals(pairs, chunk).collect())) == wanted


def test_totals_of_lists_of_words(spark):
    bags = spark.createDataFrame(
        [
            (["A", "A"], ["X", None], 10), (["B", None], ["X"], 6), (["A"], [], 4), ([], ["X"], 4),
            (None, ["X"], 4), (["A"], None, 4), (["A"], ["Y"], 0), (["A"], ["Y"], None), (["A"], ["X"], 1),
        ],
        "words array<string>, defs array<string>, tenths bigint",
    )
    wanted = Counter(map(tuple, G.combine_totals(G.word_def_edges(bags)).collect()))
    assert wanted[("A", "X", 21, 21)] == 1 and wanted[("A", None, 20, 21)] == 1 and len(wanted) == 4
    assert Counter(map(tuple, G.word_def_totals(bags).collect())) == wanted
    lists = bags.select(F.col("words").alias("srcs"), F.col("defs").alias("dsts"), F.col("tenths").alias("w"))
    assert Counter(map(tuple, cross_totals(lists.where("w <> 0"), 1).collect())) == wanted
    none = bags.where("tenths > 99")
    assert G.word_def_totals(none).count() == 0 and G.combine_norm(G.word_def_edges(none)).count() == 0


def test_pairs_are_shuffled_once_as_lists(spark):
    """Summed pairs are neither computed twice nor dealt again to meet the largest sum (F31, F33)."""
    bags = spark.createDataFrame([(["A"], ["X"], 10)], "words array<string>, defs array<string>, tenths bigint")
    for graph in (G.normalise(G.word_def_totals(bags)), G.combine_norm(G.word_def_edges(bags))):
        plan = graph._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_extremes_of_the_second_graph(spark):
    """Pairs are compared where they are made and shuffled once as lists (F2, F3, F4, F5)."""
    bags = spark.createDataFrame(
        [
            ("clues", ["CATS", "EYE"], ["CAT", "EYE"], ["BIG", "BIGS", "A"], ["BIG", "BIG", "A"]),
            ("associated", ["CAT"], ["CAT"], ["EYE"], ["EYE"]), ("equivalents", ["A", "B"], ["A1"], [], []),
            (None, ["CAT", None], ["CAT", None], ["EYE", None], [None, "EYE"]), ("clues", None, ["X"], ["Y"], ["Z"]),
            ("clues", ["V"], None, ["W"], ["W"]), ("examples", ["É" * 300], ["É" * 300], ["long"] * 300, ["long"] * 300),
        ],
        "category string, words array<string>, words_stem array<string>, defs array<string>, defs_stem array<string>",
    ).repartition(3)
    edges = G.all_edges_v2(bags)
    wanted = edges.groupBy("src", "dst").agg(F.max("tenths"), F.min("tenths"))
    found = G.extremes_v2(bags)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))
    assert rows(G.combine_max_v2(bags)) == rows(G.combine_max(edges))


def test_extremes_of_chunks_of_any_size(spark):
    rng = random.Random(7)
    words = [None, "", "A", "É", *"BCDEFG"]
    weights = [None, -300, -1, 0, 1, 255, 256, 1 << 40]
    table = [([rng.choice(words[1:]) for _ in range(3)], [rng.choice(words) for _ in range(rng.randint(0, 5))], rng.choice(weights)) for _ in range(300)]
    lists = spark.createDataFrame(table, "srcs array<string>, dsts array<string>, w bigint").repartition(4)
    pairs = lists.select(F.explode("srcs").alias("src"), "dsts", "w").select("src", F.explode("dsts").alias("dst"), "w")
    wanted = Counter(map(tuple, pairs.groupBy("src", "dst").agg(F.max("w"), F.min("w")).collect()))
    for chunk in (1, 700, 1 << 20):
        assert Counter(map(tuple, cross_extremes(lists, chunk).collect())) == wanted


def test_stems_meet_rows_dealt_once(spark):
    """Tokens are not taken apart for the shuffle; rows of one key are put together by place (F2 to F5)."""
    table = [
        ("a", 1, ["CATS", "IS"], ["DOGS"]), ("a", 1, ["CAT"], []), ("a", 2, ["CATS"], None), ("a", 3, [], []),
        (None, 1, None, ["DOGS", "CATS"]), (None, 1, ["X"], ["DOG"]), (None, None, ["CAT"], ["CATS"]), ("b", None, None, None),
    ]
    source = spark.createDataFrame(table, "k string, n int, words array<string>, defs array<string>")
    stems = {"CATS": "CAT", "DOGS": "DOG"}
    pairs = spark.createDataFrame([*stems.items(), ("IS", "IS")], "form string, stem string")
    wanted = {}
    for k, n, *lists in table:
        for c, tokens in enumerate(lists):
            for pos, form in enumerate(tokens or ()):
                wanted.setdefault((k, n), ([], []))[c].append((pos, form, stems.get(form, form)))
    found = S.stem_arrays(source, ["k", "n"], ["words", "defs"], pairs)
    got = {(r.k, r.n): (list(zip(r.words, r.words_stem)), list(zip(r.defs, r.defs_stem))) for r in found.collect()}
    assert found.columns == ["k", "n", "words", "defs", "words_stem", "defs_stem"]
    assert got == {key: tuple([t[1:] for t in sorted(tokens)] for tokens in both) for key, both in wanted.items()}
    again = S.stem_arrays(source, ["k", "n"], ["words", "defs"], pairs, group=1)
    assert Counter(map(str, again.collect())) == Counter(map(str, found.collect()))
    assert S.stem_arrays(source.where("n > 9"), ["k", "n"], ["words", "defs"], pairs).count() == 0
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
