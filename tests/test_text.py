"""Text, pattern, date, vector and direction expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clueweave.functions import directions, text, vectors, wildcards
from clueweave.operators import patterns as M
from clueweave.operators import puzzles as Z


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Don't stop — it’s Æon!", "DO NOT STOP IT AEON"),
        ("I can't, he'll", "I CAN NOT HE WILL"),
        ("a_b  c", "A B C"),
        ("Élan", "ELAN"),
        ("Straße\nnaïve", "STRASSE NAIVE"),
        ("—", ""),
    ],
)
def test_normalize(spark, raw, expected):
    assert one(spark, raw, text.normalize) == expected
    assert one(spark, raw, lambda c: text.normalize(c, full_unicode=True)) == expected


def test_full_unicode_decomposes_ligatures(spark):
    assert one(spark, "①ﬀ ２", lambda c: text.normalize(c, full_unicode=True)) == "1FF 2"


def test_variants(spark):
    assert one(spark, "a_b  é!", text.normalize_web) == "A_B  E "
    assert one(spark, "a_b  cé d", text.to_ascii) == "A B C D"
    assert one(spark, "Ex: a/b?", text.safe_name) == "Ex ab"
    assert one(spark, "co-op", text.puzzle_word) == "COOP"
    assert one(spark, "a;b", text.sanitize_clue) == "a b"


@pytest.mark.parametrize(
    "raw, expected",
    [("xx<a>yy<b>zz", "<a>yy"), ("yy<b>zz", "yy"), ("xx<a>yy", "<a>yy"), ("yy", "yy"), ("<b><a>y<b>", "<a>y")],
)
def test_bound(spark, raw, expected):
    assert one(spark, raw, lambda c: text.bound(c, "<a>", "<b>")) == expected


def test_dates(spark):
    assert one(spark, "Wednesday 6 May 2015 00.01 BST", text.clue_date) == "2015-05-05"
    assert one(spark, "Monday 12 January 2015 09.30 GMT", text.clue_date) == "2015-01-12"
    assert one(spark, "no date", text.clue_date) is None
    assert one(spark, "20150506", text.compact_date) == "2015-05-06"
    assert one(spark, "2015", text.compact_date) is None


def test_categories(spark):
    assert one(spark, "Quiptic 33", text.category_from_title) == "cryptic"
    assert one(spark, "Quick 33", text.category_from_title) is None
    got = [one(spark, p, text.category_from_part) for p in ("2s_straight", "2s_cryptic", "quizword")]
    assert got == ["straight", "cryptic", "quizword"]


def test_directions(spark):
    got = [one(spark, d, directions.parse_direction) for d in (" Across", "SOUTH", "down", "west", "up?")]
    assert got == ["East", "South", "South", "West", None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [])], "a array<double>, b array<double>, c array<double>")
    got = df.select(
        vectors.dot(F.col("a"), F.col("b")),
        vectors.norm(F.col("b")),
        vectors.argmax(F.col("b")),
        vectors.argmax(F.col("c")),
        vectors.scale(F.col("a"), 2.0),
    ).first()
    assert tuple(got) == (11.0, 5.0, 1, -1, [2.0, 4.0])


@pytest.mark.parametrize(
    "raw, regex, like", [("c?t", "C.T", "C_T"), ("ca*", "CA.*", "CA%"), ("c-a?t", "CA.T", "CA_T")]
)
def test_wildcards(spark, raw, regex, like):
    assert one(spark, raw, wildcards.to_regex) == regex == wildcards.regex_literal(raw)
    assert one(spark, raw, wildcards.to_like) == like == wildcards.like_literal(raw)


VOCABULARY = ["CAT", "COT", "DOG", "CATCH", "A", "TACT", "C", "CC", "ABBA", "X1Y", "TAT", "DOGGED"]
PATTERNS = ["C?T", "c*t", "*", "?", "??", "*A*", "C*", "*T", "?A*T?", "D?G*", "**", "A?B*", "CAT", "*?*?*?*?*", "T*T", "zz*", "-", "TAT*TAT"]


def fits(word, pattern):
    tidy = re.sub(r"[^A-Z*?]", "", pattern.upper())
    return bool(tidy) and bool(re.fullmatch(tidy.replace("*", ".*").replace("?", "."), word))


def test_match_patterns_is_a_regex_scan(spark):
    words = spark.createDataFrame([(w,) for w in VOCABULARY], "word string")
    asked = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    found = {(r.pattern, r.word) for r in M.match_patterns(words, asked).collect()}
    tidy = {p: re.sub(r"[^A-Z*?]", "", p.upper()) for p in PATTERNS}
    assert found == {(tidy[p], w) for p in PATTERNS for w in VOCABULARY if fits(w, p)}


def test_row_wise_match(spark):
    pairs = [(w, p) for w in VOCABULARY for p in PATTERNS if p != "-"]
    df = spark.createDataFrame(pairs, "word string, pattern string")
    got = df.select("word", "pattern", wildcards.matches(F.col("word"), F.col("pattern")).alias("m")).collect()
    assert all(r.m == fits(r.word, r.pattern) for r in got)


def test_solver_protocol(spark):
    words = spark.createDataFrame([("CAT",), ("COT",), ("DOG",)], "word string")
    graph = spark.createDataFrame(
        [("CAT", "PET", 10), ("DOG", "PET", 30), ("COT", "BED", 10), ("DOG", "BARK", 5)], "src string, dst string, w bigint"
    )
    requests = spark.createDataFrame(
        [(1, "a1-C?T-;d2-X??-"), (2, "a1-*-a pet, bark;;a9;d3-c*-pet"), (3, "a1-Z*"), (4, "")], "rid int, request string"
    )
    got = {r.rid: r.answer for r in M.solve(requests, words, graph, "w").collect()}
    assert got == {1: "a1-CAT,COT", 2: "a1-DOG,CAT;d3-CAT"}
    two = M.associate_pattern(graph, ["PET", "BARK"], "?o?", "w").collect()
    assert [tuple(r) for r in two] == [("DOG", 35)]
    assert [r.word for r in M.pattern_search(words, "?o*", 5).collect()] == ["COT", "DOG"]


def test_solver_lists_at_most_k(spark):
    words = spark.createDataFrame([(f"W{c}",) for c in "ZYXWVUTSRQPONMLKJIHGFEDCBA"], "word string")
    graph = spark.createDataFrame([], "src string, dst string, w bigint")
    got = M.solve(spark.createDataFrame([(1, "a1-W?-")], "rid int, request string"), words, graph, "w").first()
    assert got.answer == "a1-" + ",".join(f"W{c}" for c in "ABCDEFGHIJKLMNOPQRST")


def test_store_helpers(spark):
    items = spark.createDataFrame(
        [(1, 0, 0, "CAT", "pet", "East"), (1, 0, 0, "CAT", "feline", "East"), (1, 0, 0, "COD", "fish", "South")],
        "cwid int, x int, y int, word string, clue string, dir string",
    )
    asked = spark.createDataFrame([("CAT",), ("EMU",)], "word string")
    assert {(r.word, r.clue) for r in Z.clue_for_each(asked, items).collect()} == {("CAT", "feline"), ("EMU", "No clue found")}
    record = Z.puzzle_records(items).first()
    assert [(w.word, w.clue, w.dir) for w in record.words] == [("CAT", "feline", "East"), ("COD", "fish", "South")]
    typed = Z.typed(
        spark.createDataFrame([(" x ", "7", None), (None, "z", "1.5")], "s string, i string, d string"),
        {"s": "string", "i": "int", "d": "double"},
    )
    assert [tuple(r) for r in typed.collect()] == [("x", 7, 0.0), ("", 0, 1.5)]
    many = spark.createDataFrame([(i,) for i in range(50)], "cwid int")
    first, again = (Z.shuffled(many, "cwid", 5, "11").collect() for _ in range(2))
    assert first == again and len(Z.shuffled(many, "cwid", 5).collect()) == 5
    assert [r.word for r in Z.letter_words(spark.createDataFrame([("ab",), ("a1",), ("",)], "word string")).collect()] == ["ab"]


def test_first_matches_are_the_head_of_a_regex_scan(spark):
    rng = random.Random(6)
    vocabulary = sorted({"".join(rng.choice("ABCE") for _ in range(rng.randrange(0, 7))) for _ in range(400)} - {""})
    patterns = ["*", "??", "???*", "?", "*E", "E*", "?E*", "*E?", "*E*", "?*E*?", "??C??", "A", "AB*", "*BA", "A*B", "A?*B*C", "A??B", "*A?B*", "AB*AB", "Z*"]
    patterns += ["".join(rng.choice("AB?*") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    exact = {p: [w for w in vocabulary if re.fullmatch(p.replace("*", ".*").replace("?", "."), w)] for p in patterns}
    got = {}
    for r in M.first_matches(words, asked, 5).orderBy("rank").collect():
        got.setdefault(r.pattern, []).append(r.word)
    assert got == {p: found[:5] for p, found in exact.items() if found}
    every = {(r.pattern, r.word) for r in M.match_patterns(words, asked).collect()}
    assert every == {(p, w) for p, found in exact.items() for w in found}


def test_letterless_and_one_letter_patterns_join_no_more_than_k_words(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}E",) for a in "ABCDEFGH" for b in "ABCDEFGH" for c in "ABCDEFGH"], "word string")
    asked = spark.createDataFrame([("*",), ("???*",), ("????",), ("*E",), ("??E*",), ("*A*",)], "pattern string")
    assert M.first_matches(words, asked, 7).count() == 6 * 7
    # the pattern only meets the finished lists
    plan = M.first_matches(words, asked, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_vectors_and_quarter_turns(spark):
    row = spark.createDataFrame([(2, -3, 1, 4)], "ax int, ay int, bx int, by int")
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    turns = [c for t in (0, 1, 2, 3, -1) for c in directions.turned(*a, t)]
    got = row.select(directions.dot(*a, *b), directions.det(*a, *b), directions.taxicab(*a), *turns).first()
    assert tuple(got) == (-10, 11, 5, 2, -3, 3, 2, -2, 3, -3, -2, -3, -2)
    assert one(spark, "a-b", lambda c: text.puzzle_word(c)) == "AB"
