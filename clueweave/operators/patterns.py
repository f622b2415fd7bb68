"""Wildcard search and the batched clue solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.functions import text as T
from clueweave.functions import wildcards as P
from clueweave.operators.search import associate_words, batch_scores, top_k
from clueweave.operators.skew import salted_join
from clueweave.operators.unnest import each, each_placed


def pattern_search(words: DataFrame, pattern: str, k: int = 20) -> DataFrame:
    """First ``k`` words, alphabetically, that match one pattern."""
    return (
        words.where(F.col("word").like(P.like_literal(pattern)))
        .where(F.rlike("word", F.lit(f"^{P.regex_literal(pattern)}$")))
        .select("word")
        .orderBy("word")
        .limit(k)
    )


def _masked(word, shape):
    """``word`` with everything outside the fixed places of ``shape`` replaced by ``?``."""
    return F.array_join(
        F.zip_with(
            F.split(word, ""), F.split(shape, ""), lambda c, s: F.when(s == "x", c).otherwise("?")
        ),
        "",
    )


def _split(patterns: DataFrame) -> DataFrame:
    """Distinct tidy patterns with their number of letters."""
    tidy = patterns.select(P.tidy(F.col("pattern")).alias("pattern")).where(F.col("pattern") != "").distinct()
    return tidy.withColumn("letters", F.length(F.regexp_replace("pattern", "[*?]", "")))


def match_patterns(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, word)`` of every match for a table of patterns.

    Patterns without any letter match every word that is long enough; ask ``first_matches`` where a
    few words per pattern are wanted.
    """
    distinct = _split(patterns)
    words = words.select("word").distinct()
    bare = distinct.where(F.col("letters") == 0).withColumn(
        "least", F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    )
    # every word once per length up to its own, so "at least so long" is an equi-join
    reach = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("least"))
    open_end = F.contains("pattern", F.lit("*")) | (F.col("least") == F.length("word"))
    long_enough = bare.join(reach, "least").where(open_end).select("pattern", "word")
    return _match_letters(words, distinct).unionByName(long_enough)


def _match_letters(words: DataFrame, distinct: DataFrame) -> DataFrame:
    """Matches of distinct patterns that have a letter, as hash joins instead of a regex scan.

    Without ``*`` a pattern fixes the length and some places.  All patterns with the same
    places share a *shape*; each word is masked once per shape of its length, and masked
    word = pattern is then an equi-join that only yields true matches.

    With ``*`` a word is looked up by its rotations (a permuterm index).  The end mark joins the end
    of a pattern to its beginning, so ``TH*ED`` is the prefix ``ED$TH`` of a rotation of
    ``word$``; the longest run of letters that a pattern has in this circle is joined with the
    rotations' prefixes of the lengths in use, and :func:`wildcards.matches` checks the rest.
    """
    distinct = distinct.where(F.col("letters") > 0)
    fixed = distinct.where(~F.contains("pattern", F.lit("*"))).withColumn(
        "shape", F.regexp_replace("pattern", "[A-Z]", "x")
    )
    shapes = fixed.select("shape", F.length("shape").alias("len")).distinct()
    # few lengths hold most words, so the lengths are salted
    sized = words.withColumn("len", F.length("word"))
    masked = salted_join(sized, shapes, ["len"], "len", F.col("word")).withColumn(
        "pattern", _masked(F.col("word"), F.col("shape"))
    )
    exact = fixed.select("pattern").join(masked, "pattern").select("pattern", "word")

    starred = distinct.where(F.contains("pattern", F.lit("*")))
    head = F.substring_index("pattern", "*", 1)
    rest = F.substring(F.col("pattern"), F.length(head) + 1, F.length("pattern"))
    runs = F.filter(F.split(F.concat(rest, F.lit("$"), head), r"[*?]+"), lambda r: F.rlike(r, F.lit("[A-Z]")))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    keyed = starred.withColumn("longest", longest).select(
        "pattern", F.col("longest.n").alias("n"), F.col("longest.run").alias("run")
    )
    # one row per run length in use: never more than the longest pattern has letters
    lengths = F.broadcast(keyed.select("n").distinct())
    circle = F.concat("word", F.lit("$"), "word")
    starts = F.sequence(F.lit(1), F.length("word") + 1)
    prefixes = F.array_distinct(F.transform(starts, lambda i: F.substring(circle, i, F.col("n"))))
    rotations = each(
        words.join(lengths, F.col("n") <= F.length("word") + 1), prefixes, "run", "word"
    )
    contained = (
        keyed.join(rotations, "run")
        .where(P.matches(F.col("word"), F.col("pattern"), is_tidy=True))
        .select("pattern", "word")
    )
    return exact.unionByName(contained)


#: What a pattern with one letter asks for: the letter, the places before and
#: behind it, and whether a ``*`` stands among those.
_SPEC = ("letter", "before", "open_before", "behind", "open_behind")


def first_matches(words: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """``(pattern, word, rank)``: the first ``k`` matches of every pattern, alphabetically.

    Patterns with at most one letter match a large part of the vocabulary.  They are answered from
    lists: the first ``k`` words per length, and per letter and place for the letters
    and places that patterns ask for.  Spark limits each partition before it shuffles, so no more
    than ``k`` words per list and partition move, and ``k`` per pattern are joined.
    """
    distinct = _split(patterns)
    words = words.select("word").distinct()
    strong = _match_letters(words, distinct.where(F.col("letters") > 1))
    strong = top_k(strong, ["pattern"], [F.col("word")], k)
    words = words.withColumn("len", F.length("word"))

    bare = distinct.where(F.col("letters") == 0).select(
        "pattern",
        F.contains("pattern", F.lit("*")).alias("open"),
        F.length(F.replace("pattern", F.lit("*"), F.lit(""))).alias("least"),
    )
    per_length = top_k(words, ["len"], [F.col("word")], k).select("word", "len")
    # lengths in use (no more than the longest pattern has places) times k words of each length
    asked = F.broadcast(bare.select("open", "least").distinct())
    reached = F.when(F.col("open"), F.col("len") >= F.col("least")).otherwise(F.col("len") == F.col("least"))
    per_bound = top_k(per_length.join(asked, reached), ["open", "least"], [F.col("word")], k)
    listed = bare.join(per_bound, ["open", "least"]).select("pattern", "word", "rank")

    single = distinct.where(F.col("letters") == 1)
    letter = F.regexp_extract("pattern", "[A-Z]", 0)
    before, behind = (F.split_part(F.col("pattern"), letter, F.lit(i)) for i in (1, 2))
    places = lambda c: F.length(F.replace(c, F.lit("*"), F.lit("")))
    single = single.select(
        "pattern", letter.alias("letter"), places(before).alias("before"),
        F.contains(before, F.lit("*")).alias("open_before"), places(behind).alias("behind"),
        F.contains(behind, F.lit("*")).alias("open_behind"),
    )
    specs = single.select(*_SPEC).distinct()
    placed = each_placed(words, F.split("word", ""), "place", "letter", "word", "len")
    placed = placed.withColumn("left", F.col("len") - 1 - F.col("place"))
    # a fixed place joins with the letter; where both sides are open a word counts at one place only
    front = placed.join(
        specs.where(~F.col("open_before")).withColumn("place", F.col("before")), ["letter", "place"]
    ).where(F.when(F.col("open_behind"), F.col("left") >= F.col("behind")).otherwise(F.col("left") == F.col("behind")))
    back = placed.join(
        specs.where(F.col("open_before") & ~F.col("open_behind")).withColumn("left", F.col("behind")), ["letter", "left"]
    ).where(F.col("place") >= F.col("before"))
    held = each(words, F.array_distinct(F.split("word", "")), "letter", "word", "len")
    inner = F.substring(F.col("word"), F.col("before") + 1, F.col("len") - F.col("before") - F.col("behind"))
    anywhere = held.join(specs.where(F.col("open_before") & F.col("open_behind")), "letter").where(
        F.contains(inner, F.col("letter"))
    )
    columns = [*_SPEC, "word"]
    met = front.select(*columns).unionByName(back.select(*columns)).unionByName(anywhere.select(*columns))
    per_spec = top_k(met, list(_SPEC), [F.col("word")], k)
    lettered = single.join(per_spec, list(_SPEC)).select("pattern", "word", "rank")
    return strong.select("pattern", "word", "rank").unionByName(listed).unionByName(lettered)


def parse_requests(requests: DataFrame) -> DataFrame:
    """``(rid, request)`` -> one row per entry ``pos-pattern[-clue]`` of ``;``-separated text.

    Entries with a place but no pattern are dropped.
    """
    entries = each_placed(requests, F.split("request", ";"), "ord", "entry", "rid")
    parts = F.split("entry", "-")
    return entries.select(
        "rid",
        "ord",
        F.get(parts, F.lit(0)).alias("pos"),
        P.tidy(F.get(parts, F.lit(1))).alias("pattern"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("clue"),
    ).where(F.col("pattern") != "")


def solve(
    requests: DataFrame, words: DataFrame, edges: DataFrame, weight: str, k: int = 20
) -> DataFrame:
    """Answer all solver requests at once: ``(rid, answer)`` with ``pos-W1,W2;..`` text.

    Entries with a clue rank the associated words that fit the pattern; entries without
    one list fitting words alphabetically.  Entries without answers are left out, and so
    is a request that has no answer at all.
    """
    entries = parse_requests(requests).withColumn("qid", F.concat_ws(":", "rid", "ord"))
    plain = entries.where("clue = ''")
    fitting = first_matches(words, plain, k)
    listed = plain.join(fitting, "pattern").select("rid", "ord", "pos", "rank", "word")

    asked = entries.where("clue <> ''")
    clue_words = each(asked, T.tokens(T.normalize(F.col("clue"))), "word", "qid", "pattern")
    scored = batch_scores(edges, clue_words, weight, P.matches(F.col("src"), F.col("pattern"), is_tidy=True))
    best = top_k(scored, ["qid"], [F.desc("score"), F.col("word")], k)
    ranked = best.join(asked.select("qid", "rid", "ord", "pos"), "qid").select(
        "rid", "ord", "pos", "rank", "word"
    )
    # at most k words per entry reach these two lists
    per_entry = (
        listed.unionByName(ranked)
        .groupBy("rid", "ord", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("found"))
        .withColumn("text", F.concat_ws("-", "pos", F.array_join("found.word", ",")))
    )
    return (
        per_entry.groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("entries"))
        .select("rid", F.array_join("entries.text", ";").alias("answer"))
    )


def associate_pattern(
    edges: DataFrame, words: list[str], pattern: str, weight: str, k: int = 20
) -> DataFrame:
    """Associated words that fit a pattern, best ``k``."""
    return (
        associate_words(edges, words, weight)
        .where(F.rlike(F.upper("word"), F.lit(f"^{P.regex_literal(pattern)}$")))
        .orderBy(F.desc("score"), "word")
        .limit(k)
    )
