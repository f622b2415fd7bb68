"""Grid jobs on small puzzles."""

import random

from clueweave.operators import grid as R
from clueweave.operators import integrity as K

SCHEMA = "cwid int, x int, y int, word string, clue string, dir string"
SMALL = [
    (1, 0, 0, "CAT", "pet", "East"),
    (1, 0, 0, "COD", "fish", "South"),
    (1, 2, 0, "TEN", "number", "South"),
]


def grid(spark, *extra):
    return spark.createDataFrame([*SMALL, *extra], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_small_grid(spark):
    items = grid(spark)
    assert rows(R.extents(items)) == [(1, 3, 3)]
    assert rows(R.numbering(items)) == [(1, 0, 0, 1), (1, 2, 0, 2)]
    assert rows(R.clue_lists(items).select("side", "number", "word")) == [
        ("across", 1, "CAT"), ("down", 1, "COD"), ("down", 2, "TEN"),
    ]
    assert R.cells(items).count() == 7
    assert [r.line for r in R.lines(items).orderBy("y").collect()] == ["CAT", "O.E", "D.N"]
    assert R.conflicts(items).count() == 0 and R.validation(items).count() == 0


def test_conflicts(spark):
    assert R.conflicts(grid(spark, (1, 0, 2, "DXN", "", "East"))).count() == 0
    bad = grid(spark, (1, 0, 2, "AXN", "", "East"))
    assert rows(R.conflicts(bad)) == [(1, 0, 2, 2)]


def test_black_rows_are_kept(spark):
    items = spark.createDataFrame([(1, 0, 0, "AB", "", "East"), (1, 0, 2, "CD", "", "East")], SCHEMA)
    assert [r.line for r in R.lines(items).orderBy("y").collect()] == ["AB", "..", "CD"]


def test_validation_rules(spark):
    bad = grid(
        spark, (1, 0, 2, "AXN", "", "East"), (2, 0, 0, "", "", "East"), (2, 0, 0, "UP", "", "North"), (3, 0, 0, "A", "", "East")
    )
    assert rows(R.validation(bad)) == [
        (1, "overlap", 1), (2, "clue count", 1), (2, "direction", 1), (2, "empty grid", 1), (2, "empty word", 1), (3, "clue count", 1),
    ]


def test_cell_count(spark):
    sizes = spark.createDataFrame([(1, 3, 3), (2, 2, 2)], "cwid int, width int, height int")
    blanks = spark.createDataFrame([(1,), (1,)], "cwid int")
    assert rows(R.cell_count_check(sizes, blanks, R.cells(grid(spark)))) == [(2, 4)]


def apart(rng):
    """Words that neither touch nor cross, in rows two apart."""
    out, y = [], 0
    for _ in range(6):
        x = 0
        for _ in range(3):
            word = "".join(rng.choice("ABCDEF") for _ in range(rng.randint(2, 5)))
            out.append((9, x, y, word, "", "East"))
            x += len(word) + rng.randint(1, 3)
        y += 2
    return out


def test_words_come_back_from_cells(spark):
    placed = apart(random.Random(4))
    items = spark.createDataFrame(placed, SCHEMA)
    found = rows(R.words_from_cells(R.cells(items)).select("x", "y", "word", "dir"))
    assert found == sorted((x, y, w, d) for _, x, y, w, _, d in placed)
    small = rows(R.words_from_cells(R.cells(grid(spark))).select("x", "y", "word", "dir"))
    assert small == sorted((x, y, w, d) for _, x, y, w, _, d in SMALL)


def test_rebuild_from_spans(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2, 0), (1, 2, 0, 2, 2), (1, 0, 0, 0, 0)], "cwid int, x1 int, y1 int, x2 int, y2 int")
    got = {tuple(r)[1:5]: r.word for r in R.rebuild(spans, R.cells(grid(spark))).collect()}
    assert got == {(0, 0, 2, 0): "CAT", (2, 0, 2, 2): "TEN", (0, 0, 0, 0): "C"}


def test_crossings(spark):
    placed = spark.createDataFrame([(1, "CAT")], "cwid int, word string")
    following = spark.createDataFrame([(1, "TACO"), (1, "CAT"), (2, "CAT")], "cwid int, word string")
    got = rows(R.crossings(placed, following).select("next_word", "letter", "pos", "next_pos"))
    assert got == [("TACO", "A", 1, 1), ("TACO", "C", 0, 2), ("TACO", "T", 2, 0)]
    counts = R.crossing_counts(spark.createDataFrame([("TAT",), ("CAT",), ("DOG",)], "word string"))
    assert {(r.word, r.letter): r.partners for r in counts.collect()}[("CAT", "T")] == 2


def test_crossings_meet_in_the_row_of_their_puzzle(spark):
    """Words are shuffled once and letters never (F10); repeats and missing values change nothing."""
    table = [(1, "CAT"), (1, "TACO"), (1, "TAT"), (1, "CAT"), (1, None), (1, ""), (2, "CAT"), (None, "CAT"), (None, "TACO")]
    words = spark.createDataFrame(table, "cwid int, word string")
    found = R.crossings(words, words)
    assert exchanges(found) == 1 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    known = {(c, w) for c, w in table if c and w}
    wanted = sorted(
        (c, a, b, x, i, j)
        for c, a in known for d, b in known if c == d and a != b
        for i, x in enumerate(a) for j, y in enumerate(b) if x == y
    )
    assert rows(found.select("cwid", "word", "next_word", "letter", "pos", "next_pos")) == wanted
    assert rows(R.crossings(words, words.select("cwid", "word")).select("cwid", "word", "next_word", "letter", "pos", "next_pos")) == wanted


def test_generator_candidates(spark):
    pairs = spark.createDataFrame(
        [("CAT", "x" * 100), ("CAT", "a pet!"), ("A", "short"), ("C3PO", "robot"), ("DOG", "x" * 200), ("EMU", " ")],
        "word string, text string",
    )
    assert rows(R.generator_candidates(pairs, "11")) == [("CAT", "a pet ")]


def test_integrity(spark):
    items = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 9)], "cwid int, wid int")
    words = spark.createDataFrame([(1,), (2,)], "wid int")
    pk = K.primary_keys([("items", items, ["cwid", "wid"]), ("words", words, ["wid"])])
    assert rows(pk) == [("items", 2), ("words", 0)]
    assert rows(K.foreign_keys([("items.wid", items, "wid", words, "wid")])) == [("items.wid", 1)]
    assert K.cascade_delete(items, spark.createDataFrame([(1,)], "wid int"), "wid").count() == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_views_of_a_puzzle_shuffle_its_words_once(spark):
    items = grid(spark, (1, 0, 2, "AXN", "", "East"), (None, 0, 0, "UP", "", "East"), (4, None, 1, "DOG", "", "South"))
    views = (R.words_from_cells(R.grids(items)), R.lines(items), R.validation(items), R.gaps(R.cell_counts(items)))
    assert [exchanges(v) for v in views] == [1, 1, 1, 1]
    found = {tuple(r) for r in R.words_from_cells(R.grids(items)).collect()}
    assert found == {tuple(r) for r in R.words_from_cells(R.cells(items)).collect()}
    assert {(r.cwid, r.y, r.line) for r in R.lines(items).collect()} == {
        (1, 0, "CAT"), (1, 1, "O.E"), (1, 2, "AXN"), (None, 0, ".."),
    }  # fmt: skip; puzzle 4 has no width
