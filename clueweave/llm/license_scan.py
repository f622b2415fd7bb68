"""License scan by diagonal voting over word k-gram hashes.

All rolling word bigrams of all documents are joined to the positions they have in the templates.
A hit at word ``p`` of a document and word ``t`` of a template votes for the diagonal ``p - t``;
votes are added up per document, template and diagonal.  Diagonals of one template that lie at
most ``slack`` words apart, one after the other, are chained, so a few inserted or missing words do
not break a match.  A chain may be as long as the text (license lists, repeated phrases), so its
windows are verified: from each hit on, ``slack`` more words than the template has must cover at
least ``cover`` of the template's bigrams, each once and in order.  Per last word the best window
counts, so a template that stands word for word is always found, at its own place.  Phrases of the
``base`` templates must stand word for word, on one diagonal with every vote; all such places count.

Only DataFrame functions are used.  Templates are a constant list, far below a megabyte whatever
the corpus, so they are broadcast; nothing but hits is ever shuffled.

Words are runs of digits, letters a-z and characters above ASCII, after A-Z became lower case.
Defined cases: a null or empty text has no words; repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from clueweave.operators import unnest

#: label, phrase.  Fixed values of the base labels.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Phrases of further labels, as their publishers word them.
FURTHER = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc", "licensed under a creative commons"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "dedicated to the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)
#: Neighbouring diagonals are at most so many words apart.
SLACK = 3
#: Share of a further template's bigrams that a span must hold.
COVER = 0.75


def words(text: Column) -> Column:
    """The words of a text; only A-Z are lower-cased (the one other letter that lower-cases to an
    ASCII letter, the Kelvin sign, and the dotted I are set aside first)."""
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("å")), F.lit("İ"), F.lit("å"))
    parts = F.split(F.lower(safe), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def bigrams(found: Column) -> Column:
    """Hash of each two consecutive words."""

    def of(w: Column) -> Column:
        following = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
        pairs = F.zip_with(w, following, lambda a, b: F.xxhash64(a, b))
        return F.slice(pairs, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))

    # within transform the words have a name, so they are computed once per text
    return F.get(F.transform(F.array(found), of), F.lit(0))


def templates(spark, base=BASE, further=FURTHER) -> DataFrame:
    """One row per bigram of a template: ``(template, label, base, size, at, gram)``."""
    rows = [
        Row(template=n, label=label, base=n < len(base), phrase=phrase)
        for n, (label, phrase) in enumerate([*base, *further])
    ]
    listed = spark.createDataFrame(rows).withColumn("found", F.split("phrase", " "))
    return listed.select(
        "template", "label", "base", F.size("found").alias("size"),
        F.posexplode(bigrams(F.col("found"))).alias("at", "gram"),
    )


def covers(hits: Column, size: Column, slack: int) -> Column:
    """``(start, end, votes)`` of the best window from each hit on: the most template positions in
    order, in the fewest words.  ``hits`` are structs ``(p, back)``, ``back`` the negative template
    position; sorted, hits of one word come last position first, so each word counts once."""
    reach = size + F.lit(slack - 2)

    def step(line: Column, hit: Column) -> Column:
        before = F.filter(line, lambda x: x["back"] > hit["back"])
        longest = F.array_max(F.transform(before, lambda x: x["votes"])) + 1
        return F.concat(line, F.array(F.struct(longest.alias("votes"), hit["p"].alias("p"), hit["back"].alias("back"))))

    def of(found: Column) -> Column:
        def best(hit: Column, i: Column) -> Column:
            # a word has no more hits than the template has bigrams
            near = F.slice(found, i + 2, (reach + 1) * size)
            near = F.filter(near, lambda x: (x["p"] <= hit["p"] + reach) & (x["back"] < hit["back"]))
            first = F.array(F.struct(F.lit(1).alias("votes"), hit["p"].alias("p"), hit["back"].alias("back")))
            ends = F.transform(
                F.aggregate(near, first, step), lambda x: F.struct(x["votes"].alias("votes"), (-x["p"]).alias("p"))
            )
            return F.transform(
                F.array(F.array_max(ends)),
                lambda x: F.struct(hit["p"].alias("start"), (F.lit(2) - x["p"]).alias("end"), x["votes"].alias("votes")),
            )

        return F.flatten(F.transform(found, best))

    # within transform the hits have a name, so they are sorted once per chain
    return F.get(F.transform(F.array(F.array_sort(hits)), of), F.lit(0))


def spans(
    docs: DataFrame, key: list[str], slack: int = SLACK, cover: float = COVER,
    base=BASE, further=FURTHER,
) -> DataFrame:
    """Verified spans ``(*key, template, label, base, start, end, coverage)``, ends exclusive.

    ``key`` tells the texts apart; rows with equal keys must hold equal texts.
    """
    grams = unnest.each_placed(docs, bigrams(words(F.col("text"))), "p", "gram", *key)
    hits = grams.join(F.broadcast(templates(docs.sparkSession, base, further)), "gram")
    group = [*key, "template", "label", "base", "size"]
    # votes are distinct template positions (at most the template's size), so rows with an equal
    # key, which hold the same hits, vote once
    diagonals = (
        hits.withColumn("diagonal", F.col("p") - F.col("at"))
        .groupBy(*group, "diagonal")
        .agg(F.collect_set("at").alias("voted"))
    )
    whole = diagonals.where(F.col("base") & (F.size("voted") == F.col("size") - 1)).select(
        *key, "template", "label", "base", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("coverage"),
    )
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line)
    placed = F.transform(
        "voted", lambda at: F.struct((F.col("diagonal") + at).alias("p"), (-at).alias("back"))
    )
    chains = (
        diagonals.where(~F.col("base"))
        .withColumn("new", F.when(apart.isNull() | (apart > slack), 1).otherwise(0))
        .withColumn("chain", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "chain")
        .agg(F.flatten(F.collect_list(placed)).alias("hits"))
    )
    # no window covers more than its chain
    needed = F.ceil(F.lit(cover) * (F.col("size") - 1))
    many = chains.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["back"]))) >= needed)
    windows = unnest.each_struct(many, covers(F.col("hits"), F.col("size"), slack), "votes", *group)
    verified = (
        windows.where(F.col("votes") >= needed)
        .groupBy(*group, "end")
        .agg(F.max(F.struct("votes", "start")).alias("best"))
        .select(
            *key, "template", "label", "base", F.col("best.start").alias("start"), "end",
            (F.col("best.votes") / (F.col("size") - 1)).alias("coverage"),
        )
    )
    return whole.unionByName(verified)
