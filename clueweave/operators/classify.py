"""Letter features, Naive Bayes, decision tree and reproducible splits."""

from __future__ import annotations

import string

from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = string.ascii_uppercase


def letter_count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def letter_features(rows: DataFrame, text: str) -> DataFrame:
    """Counts of the 26 letters of an upper-case text as columns ``f_a .. f_z``."""
    return rows.withColumns({f"f_{c.lower()}": letter_count(F.col(text), c) for c in LETTERS}).drop(text)


def letter_array(text: Column) -> Column:
    """Counts of the 26 letters as one array; a letter that does not occur is null."""
    return F.array(*[F.nullif(letter_count(text, c), F.lit(0)) for c in LETTERS])


def hash_split(rows: DataFrame, key: str, below: str) -> Column:
    """True for the share of keys whose md5 starts below the hex bound (``cc``: four fifths)."""
    return F.left(F.md5(F.col(key).cast("string")), F.lit(len(below))) < below


def random_split(rows: DataFrame, weights: list[float], seed: int = 11) -> list[DataFrame]:
    return rows.randomSplit(weights, seed)


def naive_bayes(
    examples: DataFrame, counts: str = "counts", size: int = len(LETTERS), smoothing: float = 1.0
) -> DataFrame:
    """Multinomial model as one row: array ``model`` of ``(label, prior, values)``.

    ``examples`` has a ``label`` and an array of ``size`` feature counts in which null means
    absent; rows without a label are left out.  A label is one row of sums, taken before anything
    is shuffled, so a dominant label is harmless; the model has size x labels numbers and is meant
    for small alphabets and class sets.  A feature no example has gets a null value.
    """
    cells = [F.sum(F.get(counts, F.lit(i))).cast("double") for i in range(size)]
    sums = examples.where("label IS NOT NULL").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*cells).alias("sums")
    )
    gathered = sums.agg(F.array_sort(F.collect_list(F.struct("label", "n", "sums"))).alias("labels"))
    add = lambda total, x: total + F.coalesce(x, F.lit(0)).cast("double")
    sizes = gathered.select(
        "labels",
        F.aggregate("labels", F.lit(0.0), lambda total, one: total + one["n"]).alias("n_rows"),
        F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda i: F.exists("labels", lambda one: F.get(one["sums"], i).isNotNull()),
        ).alias("seen"),
    )
    n_labels, n_seen = F.size("labels"), F.size(F.filter("seen", lambda s: s))

    def fitted(one):
        total = F.aggregate(one["sums"], F.lit(0.0), add) + n_seen * smoothing
        value = lambda s, i: F.when(
            F.get(F.col("seen"), i), F.log((F.coalesce(s, F.lit(0.0)) + smoothing) / total)
        )
        return F.struct(
            one["label"].alias("label"),
            F.log((one["n"] + smoothing) / (F.col("n_rows") + n_labels * smoothing)).alias("prior"),
            F.transform(one["sums"], value).alias("values"),
        )

    return sizes.select(F.transform("labels", fitted).alias("model"))


def predict(model: DataFrame, examples: DataFrame, counts: str = "counts") -> DataFrame:
    """``examples`` with the most likely label as ``predicted``, scored inside the row.

    Null when an example has none of the features of the model.
    """
    rows = examples.select("*", model.scalar().alias("nb"))

    def score(one):
        parts = F.zip_with(counts, one["values"], lambda n, value: n * value)
        likelihood = F.aggregate(parts, F.lit(0.0), lambda total, p: total + F.coalesce(p, F.lit(0.0)))
        known = F.exists(parts, lambda p: p.isNotNull())
        return F.when(known, F.struct((one["prior"] + likelihood).alias("score"), one["label"].alias("label")))

    best = F.array_max(F.transform("nb", score))
    return rows.withColumn("predicted", best["label"]).drop("nb")


def accuracy(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """Share of the rows whose predicted label is right; none predicted is wrong."""
    right = F.coalesce((F.col(label) == F.col(guess)).cast("bigint"), F.lit(0))
    return predicted.agg(F.count(F.lit(1)).alias("n_test"), F.sum(right).alias("n_right")).withColumn(
        "accuracy", F.col("n_right") / F.col("n_test")
    )


def labelled_vectors(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Wide numeric columns -> ``(label double, features vector)``."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    return assembler.transform(rows).withColumn("label", F.col(label).cast("double"))


def tall_to_vectors(features: DataFrame, size: int, key: str = "label") -> DataFrame:
    """Tall ``(key, index, v)`` -> one vector per key; a vector has at most ``size`` entries."""
    by_index = F.map_from_entries(F.collect_list(F.struct("index", "v")))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce(F.try_element_at("cells", i.cast("bigint")), F.lit(0.0)),
    )
    grouped = features.groupBy(key).agg(by_index.alias("cells"))
    return grouped.select(key, array_to_vector(dense).alias("features"))


def train_naive_bayes(train: DataFrame, smoothing: float = 1.0):
    return NaiveBayes(smoothing=smoothing, modelType="multinomial").fit(train)


def train_tree(train: DataFrame, depth: int = 20, bins: int = 32):
    return DecisionTreeClassifier(impurity="gini", maxDepth=depth, maxBins=bins, seed=11).fit(train)


def histograms(rows: DataFrame, features: str, bins: int = 32) -> DataFrame:
    """``(feature, bin, label, n)`` of an array of counts, as one aggregation.

    Bins are equally wide between 0 and a feature's largest value; a null count is 0.  The table has
    at most features x bins x labels rows, whatever the number of examples.
    """
    filled = rows.where("label IS NOT NULL").select(
        "label", F.transform(features, lambda v: F.coalesce(v, F.lit(0)).cast("bigint")).alias("v")
    )
    cells = filled.select("label", F.posexplode("v").alias("feature", "v"))
    most = cells.groupBy("feature").agg(F.max("v").alias("most"))
    width = F.expr(f"v * {bins} div (most + 1)").cast("int")
    placed = cells.join(F.broadcast(most), "feature").withColumn("bin", width)
    return placed.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))


def split_gains(counted: DataFrame, bins: int = 32, decimals: int = 9) -> DataFrame:
    """``(feature, cut, n_left, n_right, gain, best)``: Gini gain of every split ``bin <= cut``.

    Of equal gains the smallest feature and cut is the best.  Works on ``histograms``, so all joins
    are over a small table of fixed size.
    """
    squares = lambda c: F.sum(F.col(c) * F.col(c))
    totals = counted.groupBy("feature", "label").agg(F.sum("n").alias("all"))
    cuts = totals.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(bins - 2))))
    held = counted.select("feature", "label", "bin", "n")
    left = cuts.join(held, ["feature", "label"]).groupBy("feature", "cut", "label", "all").agg(
        F.sum(F.when(F.col("bin") <= F.col("cut"), F.col("n")).otherwise(0)).alias("left")
    )
    sums = left.withColumn("right", F.col("all") - F.col("left")).groupBy("feature", "cut").agg(
        F.sum("all").alias("n"), F.sum("left").alias("n_left"), F.sum("right").alias("n_right"),
        squares("all").alias("s"), squares("left").alias("s_left"), squares("right").alias("s_right"),
    ).where("n_left > 0 AND n_right > 0")
    # impurity of a part, times its size, is its size less the sum of squares over its size
    gain = (F.col("s_left") / F.col("n_left") + F.col("s_right") / F.col("n_right") - F.col("s") / F.col("n")) / F.col("n")
    gains = sums.select("feature", "cut", "n_left", "n_right", F.round(gain, decimals).alias("gain"))
    first = gains.agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "cut")).alias("b")).scalar()
    return gains.withColumn("best", (F.col("feature") == first["feature"]) & (F.col("cut") == first["cut"]))
