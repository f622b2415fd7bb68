"""Puzzle grids as tables of placed words ``(cwid, x, y, word, dir)`` and of cells.

Coordinates are 0-based, x to the right and y down; only East and South words are legal.
Duplicates are merged by cell or by entry before any window or list, so a group is never
larger than the grid it describes.

Functions named ``..._of`` work on the arrays of one puzzle, :func:`puzzles` brings its words
together.  Jobs that need several views of a puzzle shuffle its words once and find the rest
inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clueweave.functions.directions import step_x, step_y
from clueweave.functions.text import sanitize_clue
from clueweave.operators.unnest import each, each_struct, named

BLACK = "."
LEGAL = ("East", "South")
SHORTEST, LONGEST, CLUE_LIMIT = 2, 17, 100


def puzzles(items: DataFrame, *more: Column) -> DataFrame:
    """One row per puzzle: its different placed words ``(y, x, dir, word)`` as a sorted array
    ``items``, and the aggregates ``more``."""
    placed = F.sort_array(F.collect_set(F.struct("y", "x", "dir", "word")))
    return items.repartition("cwid").groupBy("cwid").agg(placed.alias("items"), *more)


#: stands for a missing coordinate within a code
_MISSING = -(1 << 31)


def code(line: Column, at: Column) -> Column:
    """Line and place on it in one number, so that neighbours on a line differ by one."""
    high, low = (F.coalesce(c, F.lit(_MISSING)).cast("bigint") for c in (line, at))
    return F.shiftleft(high, 32) + low


def _low(number: Column) -> Column:
    return F.shiftright(F.shiftleft(number, 32), 32)


def _turned(number: Column) -> Column:
    """The code with line and place exchanged."""
    return named(_low(number), lambda at: F.shiftleft(at, 32) + F.shiftright(number - at, 32))


def _place(number: Column) -> tuple[Column, Column]:
    """Line and place of a code."""
    at = _low(number)
    plain = lambda c: F.when(c != _MISSING, c).cast("int")
    return plain(F.shiftright(number - at, 32)), plain(at)


def coded(cells: Column, *keep: str) -> Column:
    """Cells ``(code, letter)`` by row of cells ``(x, y, letter)``, sorted."""
    return F.sort_array(
        F.transform(
            cells, lambda c: F.struct(code(c["y"], c["x"]).alias("code"), c["letter"].alias("letter"), *[c[k].alias(k) for k in keep])
        )
    )


def letters_of(items: Column) -> Column:
    """Letters ``(code, letter)`` of the placed words, sorted; crossings give one per word."""

    def spelled(e: Column) -> Column:
        down = F.when(e["y"].isNotNull(), step_y(e["dir"])).otherwise(0)
        along = F.when(e["x"].isNotNull(), step_x(e["dir"])).otherwise(0)
        step = F.shiftleft(down.cast("bigint"), 32) + along
        word = F.struct(code(e["y"], e["x"]).alias("code"), step.alias("step"), F.split(e["word"], "").alias("letters"))
        return named(
            word,
            lambda w: F.transform(
                w["letters"], lambda c, i: F.struct((w["code"] + i * w["step"]).alias("code"), c.alias("letter"))
            ),
        )

    return F.sort_array(F.flatten(F.transform(F.filter(items, lambda e: e["word"] != ""), spelled)))


def cells_of(letters: Column) -> Column:
    """Filled cells of sorted letters; a contested cell keeps its alphabetically first letter."""

    def merged(found: Column) -> Column:
        return F.filter(found, lambda c, i: (i == 0) | (c["code"] != F.get(found, i - 1)["code"]))

    return named(letters, merged)


def contested_of(letters: Column) -> Column:
    """Cells of sorted letters in which words disagree."""

    def split_up(found: Column) -> Column:
        of = lambda i: F.get(found, i)["code"]
        return F.filter(
            found, lambda c, i: c["code"].eqNullSafe(of(i + 1)) & ((i == 0) | (c["code"] != of(i - 1)))
        )

    return named(F.array_distinct(letters), split_up)


def size_of(items: Column) -> tuple[Column, Column]:
    """Width and height of a grid."""

    def most(place: str, direction: str) -> Column:
        def end(e: Column) -> Column:
            return e[place] + F.when(e["dir"] == direction, F.length(e["word"]) - 1).otherwise(0)

        return F.array_max(F.transform(items, end)) + 1

    return most("x", "East"), most("y", "South")


def numbered_of(items: Column, cells: Column) -> Column:
    """Cells ``(y, x, letter, number)`` in reading order with the number of the words that start
    there."""

    def with_starts(starts: Column) -> Column:
        def cell(c: Column) -> Column:
            y, x = _place(c["code"])
            n = F.array_position(starts, c["code"]).cast("int")
            number = F.when(y.isNotNull() & x.isNotNull() & (n > 0), n)
            return F.struct(y.alias("y"), x.alias("x"), c["letter"].alias("letter"), number.alias("number"))

        return F.transform(cells, cell)

    return named(_starts(items), with_starts)


def _starts(items: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(items, lambda e: code(e["y"], e["x"]))))


def clue_lists_of(entries: Column) -> Column:
    """Numbered clues ``(side, number, clue)`` of the sorted words ``(y, x, dir, word, clue)`` of a
    puzzle; of words with one start and direction the first counts."""

    def listed(parts: Column) -> Column:
        def first(e: Column, i: Column) -> Column:
            last = F.get(parts["entries"], i - 1)
            same = e["y"].eqNullSafe(last["y"]) & e["x"].eqNullSafe(last["x"]) & e["dir"].eqNullSafe(last["dir"])
            return e["y"].isNotNull() & e["x"].isNotNull() & ((i == 0) | ~same)

        def clue(e: Column) -> Column:
            side = F.when(e["dir"] == "East", "across").when(e["dir"] == "South", "down")
            number = F.array_position(parts["starts"], code(e["y"], e["x"])).cast("int")
            return F.struct(side.alias("side"), number.alias("number"), e["clue"].alias("clue"))

        return F.transform(F.filter(parts["entries"], first), clue)

    return named(F.struct(entries.alias("entries"), _starts(entries).alias("starts")), listed)


def lines_of(cells: Column, width: Column, height: Column) -> Column:
    """Rows ``(y, line)`` of a grid from its sorted cells, black cells as dots."""

    def line(y: Column) -> Column:
        begin = F.shiftleft(y.cast("bigint"), 32)

        def drawn(row: Column) -> Column:
            def gap(to: Column, i: Column) -> Column:
                before = F.coalesce(F.get(row, i)["code"], begin - 1)
                return F.repeat(F.lit(BLACK), (to - before - 1).cast("int"))

            placed = F.transform(row, lambda c, i: F.concat(gap(c["code"], i - 1), c["letter"]))
            return F.concat(F.array_join(placed, ""), gap(begin + width, F.size(row) - 1))

        row = F.filter(cells, lambda c: c["code"].between(begin, begin + width - 1))
        return F.struct(y.alias("y"), named(row, drawn).alias("line"))

    return F.transform(F.sequence(F.lit(0), height - 1), line)


def words_of(cells: Column, *keep: str) -> Column:
    """Runs of at least two neighbouring cells ``(x, y, word, dir)``, across and down, with the
    fields ``keep`` of their first cell; cells ``(code, letter)`` as by :func:`coded`."""

    def runs(ordered: Column, direction: str) -> Column:
        def cut(row: Column) -> Column:
            at = lambda i: F.get(row, i)["code"]
            places = F.transform(row, lambda c, i: i)

            def begins(i: Column) -> Column:
                return (at(i) + 1).eqNullSafe(at(i + 1)) & ((i == 0) | (at(i) - 1 != at(i - 1)))

            def ends(i: Column) -> Column:
                return (i > 0) & (at(i) - 1).eqNullSafe(at(i - 1)) & ~(at(i) + 1).eqNullSafe(at(i + 1))

            def word(first: Column, last: Column) -> Column:
                cell, run = F.get(row, first), F.slice(row, first + 1, last - first + 1)
                line, place = _place(cell["code"])
                x, y = (place, line) if direction == "East" else (line, place)
                return F.struct(
                    x.alias("x"), y.alias("y"), F.array_join(run["letter"], "").alias("word"),
                    F.lit(direction).alias("dir"), *[cell[k].alias(k) for k in keep],
                )

            return F.zip_with(F.filter(places, begins), F.filter(places, ends), word)

        return named(ordered, cut)

    def by_column(c: Column) -> Column:
        return F.struct(_turned(c["code"]).alias("code"), c["letter"].alias("letter"), *[c[k].alias(k) for k in keep])

    return F.concat(runs(cells, "East"), runs(F.sort_array(F.transform(cells, by_column)), "South"))


def shown_in(cells: Column, span: Column) -> Column:
    """Letters that sorted cells show from ``x1, y1`` to ``x2, y2``; '' if none."""
    across = span["x2"] > span["x1"]
    steps = F.greatest(span["x2"] - span["x1"], span["y2"] - span["y1"]).cast("bigint")
    begin = F.when(span["x1"].isNotNull() & span["y1"].isNotNull(), code(span["y1"], span["x1"]))
    reach = F.when(across, steps).otherwise(F.shiftleft(steps, 32))
    line = F.struct(
        (begin + F.least(F.lit(0), reach)).alias("low"), (begin + F.greatest(F.lit(0), reach)).alias("high"),
        begin.alias("begin"), across.alias("across"),
    )

    def read(line: Column) -> Column:
        def inside(c: Column) -> Column:
            return c["code"].between(line["low"], line["high"]) & (
                line["across"] | (_low(c["code"] - line["begin"]) == 0)
            )

        return F.array_join(F.filter(cells, inside)["letter"], "")

    return named(line, read)


def grids(items: DataFrame) -> DataFrame:
    """``(cwid, items, cells)``: one row per puzzle with its words and its filled cells."""
    return puzzles(items).select("cwid", "items", cells_of(letters_of(F.col("items"))).alias("cells"))


def letters(items: DataFrame, *keep: str) -> DataFrame:
    """One row per letter of every placed word (crossings give one row per word)."""
    exploded = items.where("word <> ''").select(
        "cwid", "x", "y", "dir", *keep, F.posexplode(F.split("word", "")).alias("pos", "letter")
    )
    return exploded.select(
        "cwid",
        (F.col("x") + F.col("pos") * step_x(F.col("dir"))).alias("x"),
        (F.col("y") + F.col("pos") * step_y(F.col("dir"))).alias("y"),
        *keep,
        "letter",
    )


def cells(items: DataFrame) -> DataFrame:
    """One row per filled cell; a contested cell keeps its alphabetically first letter."""
    return letters(items).groupBy("cwid", "x", "y").agg(F.min("letter").alias("letter"))


def conflicts(items: DataFrame) -> DataFrame:
    """Cells in which words disagree, with the number of different letters."""
    found = letters(items).groupBy("cwid", "x", "y").agg(F.collect_set("letter").alias("seen"))
    return found.where(F.size("seen") > 1).select("cwid", "x", "y", F.size("seen").alias("n_letters"))


def extents(items: DataFrame) -> DataFrame:
    """Width and height of every grid."""
    reach = F.length("word") - 1
    return items.groupBy("cwid").agg(
        (F.max(F.col("x") + F.when(F.col("dir") == "East", reach).otherwise(0)) + 1).alias("width"),
        (F.max(F.col("y") + F.when(F.col("dir") == "South", reach).otherwise(0)) + 1).alias("height"),
    )


def lines(items: DataFrame) -> DataFrame:
    """Text of every grid row, black cells as dots."""
    shown = named(
        F.struct("cells", *[n.alias(name) for n, name in zip(size_of(F.col("items")), ("width", "height"))]),
        # a puzzle without an id has no cells of its own
        lambda g: lines_of(F.when(F.col("cwid").isNotNull(), g["cells"]).otherwise(F.slice(g["cells"], 1, 0)), g["width"], g["height"]),
    )
    return each_struct(grids(items), shown, "line", "cwid")


def numbering(items: DataFrame) -> DataFrame:
    """1-based numbers of the cells in which a word starts, row by row."""
    starts = items.select("cwid", "x", "y").distinct()
    order = Window.partitionBy("cwid").orderBy("y", "x")
    return starts.withColumn("number", F.row_number().over(order))


def unique_entries(items: DataFrame) -> DataFrame:
    """One word and clue per (puzzle, start, direction)."""
    first = F.min(F.struct("word", "clue"))
    return items.groupBy("cwid", "x", "y", "dir").agg(first.alias("e")).select(
        "cwid", "x", "y", "dir", "e.word", "e.clue"
    )


def clue_lists(items: DataFrame) -> DataFrame:
    """Numbered across and down clues."""
    side = F.when(F.col("dir") == "East", "across").when(F.col("dir") == "South", "down")
    return (
        unique_entries(items)
        .join(numbering(items), ["cwid", "x", "y"])
        .select("cwid", side.alias("side"), "number", "word", "clue")
    )


def words_from_cells(filled: DataFrame) -> DataFrame:
    """Runs of at least two neighbouring cells, across and down: of rows ``(cwid, x, y, letter)``
    or of :func:`grids`, which hold the cells of a puzzle already."""
    if "cells" not in filled.columns:
        filled = _gathered(filled)
    return each_struct(filled, named(F.col("cells"), lambda cells: words_of(cells)), "word", "cwid")


def _gathered(filled: DataFrame) -> DataFrame:
    cells = filled.repartition("cwid").groupBy("cwid").agg(F.collect_list(F.struct("x", "y", "letter")).alias("c"))
    return cells.select("cwid", coded(F.col("c")).alias("cells"))


def rebuild(spans: DataFrame, filled: DataFrame) -> DataFrame:
    """Words of clue spans ``(cwid, x1, y1, x2, y2)`` read back from the cells."""
    ends = ("x1", "y1", "x2", "y2")
    wanted = spans.repartition("cwid").groupBy("cwid").agg(F.collect_set(F.struct(*ends)).alias("spans"))
    return rebuilt(wanted.join(_gathered(filled), "cwid"))


def rebuilt(found: DataFrame) -> DataFrame:
    """:func:`rebuild` for puzzles ``(cwid, spans, cells)`` whose parts stand in one row."""

    def read(cells: Column) -> Column:
        def word(s: Column) -> Column:
            ends = [s[n].alias(n) for n in ("x1", "y1", "x2", "y2")]
            return F.struct(*ends, F.nullif(shown_in(cells, s), F.lit("")).alias("word"))

        return F.transform("spans", word)

    return each_struct(found.where("cwid IS NOT NULL"), named(F.col("cells"), read), "word", "cwid")


def validation(items: DataFrame) -> DataFrame:
    """``(cwid, rule, n)`` for every broken rule, instead of an exception per puzzle.

    A missing word is an empty one, a missing direction none of the legal ones.
    """
    is_legal = F.coalesce(F.col("dir").isin(*LEGAL), F.lit(False))
    is_empty = F.coalesce(F.col("word") == "", F.lit(True))
    counted = puzzles(
        items,
        F.count_if(is_empty).alias("empty"),
        F.count_if(~is_legal).alias("turned"),
        F.count_if(is_legal & ~is_empty).alias("usable"),
    )

    def rule(name, n):
        return F.struct(F.lit(name).alias("rule"), n.cast("bigint").alias("n"))

    def counts(puzzle):
        entries = F.array_distinct(F.transform(puzzle["legal"], lambda e: F.struct(e["y"], e["x"], e["dir"])))
        # a puzzle without an id has no cells of its own
        found = F.when(F.col("cwid").isNull(), 0).otherwise(F.size(words_of(puzzle["cells"])))
        return F.array(
            rule("empty word", F.col("empty")),
            rule("direction", F.col("turned")),
            rule("empty grid", F.col("usable") == 0),
            rule("overlap", F.size(contested_of(puzzle["letters"]))),
            rule("clue count", F.abs(F.size(entries) - found)),
        )

    legal = F.filter("items", lambda e: F.coalesce(e["dir"].isin(*LEGAL), F.lit(False)))
    with_letters = named(legal, lambda e: F.struct(e.alias("legal"), letters_of(e).alias("letters")))
    with_cells = named(
        with_letters,
        lambda p: F.struct(p["legal"].alias("legal"), p["letters"].alias("letters"), cells_of(p["letters"]).alias("cells")),
    )
    broken = F.filter(named(with_cells, counts), lambda r: r["n"] > 0)
    return each_struct(counted, broken, "rule", "cwid")


def cell_counts(items: DataFrame) -> DataFrame:
    """``(cwid, width, height, n_blank, n_solved)``: black cells of the drawn lines and cells with
    an undisputed letter."""

    def counts(p: Column) -> Column:
        def black(row: Column) -> Column:
            return F.size(F.filter(F.split(row["line"], ""), lambda cell: cell == BLACK))

        own = F.when(F.col("cwid").isNotNull(), p["cells"]).otherwise(F.slice(p["cells"], 1, 0))
        drawn = F.coalesce(lines_of(own, p["width"], p["height"]), F.array().cast("array<struct<y:int,line:string>>"))
        shown = F.filter(drawn, lambda row: row["line"].isNotNull())
        return F.struct(
            p["width"].alias("width"), p["height"].alias("height"),
            F.aggregate(F.transform(shown, black), F.lit(0), lambda a, n: a + n).alias("n_blank"),
            (F.size(p["cells"]) - F.size(p["contested"])).alias("n_solved"),
        )

    width, height = size_of(F.col("items"))
    parts = named(
        letters_of(F.col("items")),
        lambda found: F.struct(
            cells_of(found).alias("cells"), contested_of(found).alias("contested"),
            width.alias("width"), height.alias("height"),
        ),
    )
    return puzzles(items).select("cwid", named(parts, counts).alias("c")).select("cwid", "c.*")


def cell_count_check(sizes: DataFrame, blanks: DataFrame, solved: DataFrame) -> DataFrame:
    """Puzzles for which width x height - blanks is not the number of solved cells."""
    n_blank = blanks.groupBy("cwid").agg(F.count(F.lit(1)).alias("n_blank"))
    n_solved = solved.groupBy("cwid").agg(F.count(F.lit(1)).alias("n_solved"))
    return gaps(sizes.join(n_blank, "cwid", "left").join(n_solved, "cwid", "left"))


def gaps(counted: DataFrame) -> DataFrame:
    """:func:`cell_count_check` for :func:`cell_counts`; a missing count is none."""
    zero = F.lit(0)
    filled = F.coalesce("n_blank", zero) + F.coalesce("n_solved", zero)
    missing = (F.col("width") * F.col("height") - filled).cast("bigint")
    return counted.select("cwid", missing.alias("missing")).where("missing <> 0")


def fan_out(clues: DataFrame, *arrays: str) -> DataFrame:
    """A clue shared by several words -> one row per word with its own coordinates."""
    rest = [c for c in clues.columns if c not in arrays]
    return clues.select(*rest, F.inline(F.arrays_zip(*arrays)))


def crossings(placed: DataFrame, following: DataFrame, by: str = "cwid") -> DataFrame:
    """Where a following word may cross a placed one: equal letters with both positions.

    The words of a puzzle come together in one row and meet there, so no letter is shuffled.
    """

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(by, "word").where(F.col(by).isNotNull() & F.col("word").isNotNull())
        return own.repartition(by).groupBy(by).agg(F.collect_set("word").alias(name))

    both = gathered(following, "following")
    both = both.withColumn("placed", F.col("following")) if placed is following else both.join(gathered(placed, "placed"), by)

    def spelled(word: Column) -> Column:
        return F.transform(F.split(word, ""), lambda c, i: F.struct(c.alias("letter"), i.alias("pos")))

    def meet(own: Column) -> Column:
        def with_next(word: Column) -> Column:
            def of(others: Column) -> Column:
                def at(c: Column) -> Column:
                    return F.transform(
                        F.filter(others, lambda o: o["letter"] == c["letter"]),
                        lambda o: F.struct(
                            c["letter"].alias("letter"), c["pos"].alias("pos"), word.alias("next_word"), o["pos"].alias("next_pos")
                        ),
                    )

                return F.flatten(F.transform(own, at))

            return named(spelled(word), of)

        return F.flatten(F.transform(F.filter("following", lambda word: word != F.col("word")), with_next))

    each_word = each(both, "placed", "word", by, "following")
    found = each_struct(each_word, named(spelled(F.col("word")), meet), "letter", by, "word")
    return found.select(by, "letter", "word", "pos", "next_word", "next_pos")


def crossing_counts(words: DataFrame) -> DataFrame:
    """For each letter of each word, how many letter places of other words could cross it.

    Counted from letter totals, so the pairs themselves are never formed.
    """
    spelled = words.select("word").distinct().select(
        "word", F.posexplode(F.split("word", "")).alias("pos", "letter")
    )
    own = spelled.groupBy("word", "letter").agg(
        F.count(F.lit(1)).alias("own"), F.min("pos").alias("first_pos")
    )
    totals = own.groupBy("letter").agg(F.sum("own").alias("total"))
    # at most one row per code point, about 1.1 million
    return own.join(F.broadcast(totals), "letter").select(
        "word", "letter", "first_pos", (F.col("total") - F.col("own")).alias("partners")
    )


def generator_candidates(pairs: DataFrame, seed: str) -> DataFrame:
    """Letter-only words of fitting length with one short definition, picked by md5 order."""
    fits = pairs.where(
        F.rlike("word", F.lit("^[A-Z]+$"))
        & F.length("word").between(SHORTEST, LONGEST)
        & (F.length("text") < CLUE_LIMIT)
        & (F.trim("text") != "")
    )
    place = F.md5(F.concat(F.lit(seed), "word", "text"))
    picked = fits.groupBy("word").agg(F.min(F.struct(place.alias("place"), "text")).alias("p"))
    return picked.select("word", sanitize_clue(F.col("p.text")).alias("clue"))
