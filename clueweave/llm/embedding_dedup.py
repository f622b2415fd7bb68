"""Embedding near-duplicates by collision-counting projections.

Unit vectors whose cosine reaches the threshold lie at most ``sqrt(2 - 2 cosine)`` apart, so their
projections on a random direction differ by a normal step with that deviation over the square root
of the dimension.  Vectors are projected on many directions; along each, a query's window reaches
``reach`` such deviations to both sides.  A pair is a candidate when it collides in at least
``needed`` windows, the largest number that true pairs miss with a probability below ``miss``;
candidates are verified by their exact cosine in double precision, so no link is below it.

The first direction also orders the work: its line is cut into cells as wide as its (wider) window,
so linked vectors of a group lie in one cell or in neighbours.  Cells are cut into pieces of about
``piece`` vectors; each pair of pieces is one small task that sorts every projection, finds the
windows by binary search and counts collisions.  A task returns one number per vector and a
forest of links, never its pairs, so a group of thousands of near copies stays cheap to ship.

Vectors compare only within equal, non-null labels and equal lengths.  Equal vectors of a label are
one point with a weight.  Vectors that are null, empty, zero, or hold null or non-finite components
link with nothing.  Repeated rows link with each other like any equal vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.llm.common import two_hashes
from clueweave.llm.components import components
from clueweave.session import written

DIRECTIONS = 16
#: Half windows in deviations of a pair at the threshold; the first direction's is wider, because
#: every link has to collide there.
REACH, FIRST_REACH = 3.0, 4.5
#: Probability that a pair at the threshold has too few collisions.
MISS = 1e-6
#: Vectors of one piece of a cell.
PIECE = 4096
SEED = 20240229


def needed(directions: int = DIRECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """Calibration: the collisions that a pair at the threshold has but for ``miss``."""
    p = math.erf(reach / math.sqrt(2))
    below, count = 0.0, 0
    while count < directions:
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > miss:
            break
        count += 1
    return count


def _lines(dimension: int, directions: int) -> np.ndarray:
    """Unit directions, one per column."""
    lines = np.random.default_rng([SEED, dimension]).standard_normal((dimension, directions))
    return lines / np.linalg.norm(lines, axis=0)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _deviation(cosine: float, dimension: int) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-12) / dimension)


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def link_block(
    left: np.ndarray, right: np.ndarray, cosine: float, directions: int, reach: float, miss: float
) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(i, j)`` of linked rows of ``left`` and ``right``."""
    dimension = left.shape[1]
    a, b = _units(left), _units(right)
    lines, half = _lines(dimension, directions), reach * _deviation(cosine, dimension)
    pa_, pb = a @ lines, b @ lines
    least, out = needed(directions, reach, miss), []
    order = np.argsort(pb, axis=0, kind="stable")
    ranks = np.argsort(order, axis=0, kind="stable")
    for begin in range(0, len(a), 256):
        ask = pa_[begin : begin + 256]
        counts = np.zeros((len(ask), len(b)), dtype=np.int8)
        at = np.arange(len(ask))
        for k in range(directions):
            line = pb[order[:, k], k]
            marks = np.zeros((len(ask), len(b) + 1), dtype=np.int8)
            marks[at, np.searchsorted(line, ask[:, k] - half, "left")] += 1
            marks[at, np.searchsorted(line, ask[:, k] + half, "right")] -= 1
            counts += np.cumsum(marks, axis=1, dtype=np.int8)[:, ranks[:, k]]
        i, j = np.nonzero(counts >= least)
        for part in range(0, len(i), 1 << 17):
            x, y = i[part : part + (1 << 17)] + begin, j[part : part + (1 << 17)]
            linked = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            out.append((x[linked], y[linked]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links ``nodes[i] - nodes[j]``, each component a star."""
    least = np.arange(len(nodes))
    while True:  # smallest position in reach, by passing minima along the links
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[least[moved]].tolist()))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, directions: int = DIRECTIONS, reach: float = REACH,
    first_reach: float = FIRST_REACH, miss: float = MISS, piece: int = PIECE,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vec_id, embedding, label``."""
    k1, k2 = two_hashes(F.col("label"), F.col("embedding"))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding", k1.alias("k1"),
        k2.alias("k2"), (_usable(F.col("embedding")) & F.col("label").isNotNull()).alias("usable"),
    )

    def cells(column: pa.Array) -> pa.Array:
        out = []
        for vector in column:
            v = np.array(vector.as_py(), dtype=np.float64)
            first = _lines(len(v), directions)[:, 0] @ (v / np.linalg.norm(v))
            out.append(math.floor(first / (first_reach * _deviation(cosine, len(v)))))
        return pa.array(out, pa.int32())

    where = arrow_udf(cells, "int").asNondeterministic()
    points = written(
        rows.where("usable")
        .groupBy("label", "embedding", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("cell", where("embedding"))
        .withColumn("size", F.size("embedding")),
        "vectors",
    )
    group = ["label", "size"]
    counts = written(
        points.groupBy(*group, "cell").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("n")),
        "cells",
    )
    below = counts.select(*group, (F.col("cell") + 1).alias("cell"), F.col("n").alias("below"))
    above = counts.select(*group, (F.col("cell") - 1).alias("cell"), F.col("n").alias("above"))
    sides = counts.join(below, [*group, "cell"], "left").join(above, [*group, "cell"], "left")
    placed = points.join(sides, [*group, "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    )

    def seats(ask: bool, cell: Column, step: int, own: Column, other: Column) -> Column:
        task = lambda o: F.struct(
            F.lit(ask).alias("ask"), cell.alias("low_cell"), F.lit(step).alias("step"),
            (own if ask else o).alias("left"), (o if ask else own).alias("right"),
        )
        return F.transform(other, task)

    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    part, cell = F.col("part"), F.col("cell")
    seat = F.concat(
        seats(True, cell, 0, part, F.sequence(part, F.col("n") - 1)),
        seats(False, cell, 0, part, F.when(part > 0, F.sequence(F.lit(0), part - 1)).otherwise(none)),
        seats(True, cell, 1, part, upto(F.coalesce("above", F.lit(0)))),
        seats(False, cell - 1, 1, part, upto(F.coalesce("below", F.lit(0)))),
    )
    dealt = placed.select(*group, "node", "weight", "embedding", F.inline(seat))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        nodes, weight = rows["node"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
        ask = rows["ask"].to_numpy(bool)
        left = np.flatnonzero(ask)
        alone = rows["step"].iat[0] == 0 and rows["left"].iat[0] == rows["right"].iat[0]
        right = left if alone else np.flatnonzero(~ask)
        i, j = link_block(matrix[left], matrix[right], cosine, directions, reach, miss)
        i, j = left[i], right[j]
        if alone:  # a piece with itself finds each pair twice and each vector with itself
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
        some = np.flatnonzero(links)
        forest = _forest(nodes, i, j)
        return pd.DataFrame(
            {
                "a": np.array([*nodes[some], *(x for x, _ in forest)], dtype=np.int64),
                "b": pd.array([None] * len(some) + [y for _, y in forest], dtype="Int64"),
                "n": np.array([*links[some], *[0] * len(forest)], dtype=np.int64),
            }
        )

    found = written(
        dealt.groupBy(*group, "low_cell", "step", "left", "right").applyInPandas(
            link, "a bigint, b bigint, n bigint"
        ),
        "vector-links",
    )
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = written(
        points.select("node", "k1", "k2", "weight", "least")
        .join(degree, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "vector-roots",
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    known = named.join(smallest, "root").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "smallest",
        F.lit(True).alias("usable"),
    )
    component = F.when(F.col("usable"), F.col("smallest")).otherwise(F.col("vec_id"))
    return rows.join(known, ["k1", "k2", "usable"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


#: The same by all pairs in plain SQL.
SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.x LEFT JOIN degree d ON e.vec_id = d.x
"""
