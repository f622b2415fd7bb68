"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of its word
shingles.  Documents with the same fingerprint are one point.  Points at most ``radius`` bits apart
are linked, and links make components.

Two points within ``radius`` bits differ by at most ``radius // parts`` bits in one of ``parts``
slices of the fingerprint (all differences cannot be larger).  So one vantage-point tree is built
per slice, over Hamming distances within the slice, where few points are close and triangle bounds
prune well.  The upper levels of a tree are fitted on a bounded sample: a node has a vantage point
and the median distance to it.  Its leaves are the shards.  Every point is stored in the one leaf it
falls into and asks every leaf that its ball overlaps: a branch is skipped exactly when the triangle
inequality rules it out, so no pair is lost whatever the sample was.  Inside a shard the tree is
continued down to small leaves, where the full distance decides.  A shard with many points (points
that agree in a slice cannot be split by distance) is cut into pieces, to which its queries are
copied.  Shards give a spanning forest of the links they found, so a large group of near copies
gives about as many links as points.

Words are runs of anything but ASCII white space, after A-Z became lower case.
Defined cases: null, empty and blank texts have no shingle and the fingerprint zero, and link like
any other; fewer words than a shingle are one shingle; rows may repeat, ids may be null (a component
whose ids are all null has a null id).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clueweave.llm.common import two_hashes
from clueweave.llm.components import components
from clueweave.session import written

SEED = 42
#: Points that fit the upper levels of the trees; every point is indexed whatever this is.
SAMPLE = 40_000
#: Points a shard should hold, and how many sampled points a median needs at least.
SHARD, LEAST_SAMPLE = 4_000, 16
#: Points or queries of a node that are compared directly.
LEAF = 48


def shingle_bits(data: bytes, size: int) -> int:
    """Fingerprint of a text in UTF-8."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[size - 1 :] or ends[-1:]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(text[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int) -> Column:
    """Fingerprints as signed 64-bit integers (the bits count)."""

    def of(texts: pa.Array) -> pa.Array:
        bits = [shingle_bits((t.as_py() or "").encode(), size) for t in texts]
        return pa.array(np.array(bits, dtype=np.uint64).view(np.int64))

    return arrow_udf(of, "bigint").asNondeterministic()(text)


def slices(parts: int) -> list[tuple[int, int]]:
    """``(shift, mask)`` of each slice of the 64 bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, (1 << b - a) - 1) for a, b in zip(cuts, cuts[1:])]


def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def plant(sample: np.ndarray, levels: int):
    """Upper levels of a tree: nested ``(vantage, median, near, far)``; None is a leaf.

    A point at distance ``d`` from the vantage point lies near when ``d <= median``.
    """
    if levels == 0 or len(sample) < LEAST_SAMPLE:
        return None
    vantage = int(sample[len(sample) // 2])
    d = _distance(sample, vantage)
    median = int(np.median(d))
    near = d <= median
    if near.all():
        median -= 1
        near = d <= median
    if not near.any():
        return None
    return vantage, median, plant(sample[near], levels - 1), plant(sample[~near], levels - 1)


def descend(tree, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """``(leaf, indices)`` of the points whose ball of ``radius`` meets each leaf; leaves are
    numbered as a heap.  With radius 0 every point meets one leaf."""
    out, stack = [], [(tree, 1, np.arange(len(points)))]
    while stack:
        node, number, index = stack.pop()
        if not len(index):
            continue
        if node is None:
            out.append((number, index))
            continue
        vantage, median, near, far = node
        d = _distance(points[index], vantage)
        stack.append((near, 2 * number, index[d - radius <= median]))
        stack.append((far, 2 * number + 1, index[d + radius > median]))
    return out


def search(
    points: np.ndarray, queries: np.ndarray, shift: int, mask: int, near: int, radius: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``points`` and ``queries`` of one shard.

    Both continue down one tree: points fall to one side of the median, queries to each side
    their ball of ``near`` bits meets.
    """
    values, back = np.unique(np.concatenate([points, queries]), return_inverse=True)
    p_at, q_at = back[: len(points)], back[len(points) :]
    keys = values >> np.uint64(shift) & np.uint64(mask)
    sets, links = np.arange(len(values)), []  # sets: the smallest member known of each point's set
    stack = [(np.unique(p_at), np.unique(q_at), 0)]
    while stack:
        p, q, stuck = stack.pop()
        if not len(p) or not len(q):
            continue
        if min(len(p), len(q)) > LEAF and stuck < 3:
            vantage = int(keys[p[(7 * stuck + len(p) // 2) % len(p)]])
            dp = _distance(keys[p], vantage)
            median = int(np.median(dp))
            median -= bool((dp <= median).all())
            inner = dp <= median
            if inner.any():
                dq = _distance(keys[q], vantage)
                stack.append((p[inner], q[dq - near <= median], 0))
                stack.append((p[~inner], q[dq + near > median], 0))
            else:
                stack.append((p, q, stuck + 1))
            continue
        for i in range(0, len(p), LEAF):  # blocks keep the distance table small
            block = p[i : i + LEAF]
            for j in range(0, len(q), 1 << 14):
                ask = q[j : j + (1 << 14)]
                d = np.bitwise_count(values[block][:, None] ^ values[ask][None, :])
                x, y = np.nonzero(d <= radius)
                x, y = block[x], ask[y]
                apart = sets[x] != sets[y]
                for u, v in zip(x[apart].tolist(), y[apart].tolist()):
                    if (one := sets[u]) != (other := sets[v]):
                        sets[sets == max(one, other)] = min(one, other)
                        links.append((int(values[u].view(np.int64)), int(values[v].view(np.int64))))
    return links


def link_points(points: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(a, b)``: links that connect the distinct fingerprints ``points`` (column ``point``) within
    ``radius`` bits, as a forest per shard."""
    spark = points.sparkSession
    count = points.count()
    if count < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    parts = max(1, radius // 2 + 1)
    near = radius // parts
    chosen = points.orderBy(F.xxhash64("point"), "point").limit(sample).toPandas()["point"]
    chosen = chosen.to_numpy(np.int64).view(np.uint64)
    levels = max(0, int(np.ceil(np.log2(max(count / shard, 1)))))
    cuts = slices(parts)
    trees = [plant(np.unique(chosen >> np.uint64(s) & np.uint64(m)), levels) for s, m in cuts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            bits = own.view(np.uint64)
            for number, ((s, m), tree) in enumerate(zip(cuts, trees)):
                keys = bits >> np.uint64(s) & np.uint64(m)
                for role, reach in ((True, 0), (False, near)):
                    for leaf, index in descend(tree, keys, reach):
                        n = len(index)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, number, np.int32)),
                                pa.array(np.full(n, leaf, np.int64)),
                                pa.array(np.full(n, role)),
                                pa.array(own[index]),
                            ],
                            names=["tree", "leaf", "home", "point"],
                        )

    dealt = points.select("point").mapInArrow(deal, "tree int, leaf bigint, home boolean, point bigint")
    # one row per shard, a number bounded by the levels that the sample allows
    sizes = dealt.where("home").groupBy("tree", "leaf").agg(
        F.ceil(F.count(F.lit(1)) / (4 * shard)).cast("int").alias("pieces")
    )
    cut = dealt.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn(
        "piece",
        F.explode(
            F.when(F.col("home"), F.array(F.pmod(F.xxhash64("point"), F.col("pieces")).cast("int")))
            .otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
        ),
    )

    def linked(key, rows: pd.DataFrame) -> pd.DataFrame:
        s, m = cuts[int(key[0])]
        bits = rows["point"].to_numpy(np.int64).view(np.uint64)
        home = rows["home"].to_numpy(bool)
        found = search(bits[home], bits[~home], s, m, near, radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cut.groupBy("tree", "leaf", "piece").applyInPandas(linked, "a bigint, b bigint")


def _roots(marked: DataFrame, radius: int, shard: int, sample: int) -> DataFrame:
    """``(point, root)`` of every fingerprint in column ``point``."""
    points = written(marked.select("point").distinct(), "fingerprints")
    joined = components(link_points(points, radius, shard, sample))
    return points.join(joined.withColumnRenamed("node", "point"), "point", "left").select(
        "point", F.coalesce("root", "point").alias("root")
    )


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = 4, shard: int = SHARD, sample: int = SAMPLE
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row, from ``doc_id`` and ``text``.

    The fingerprint is sixteen lower-case hexadecimal digits; ``component_id`` is the smallest
    ``doc_id`` in reach over links, itself included.
    """
    marked = written(docs.select("doc_id", fingerprint(F.col("text"), size).alias("point")), "marked")
    members = marked.groupBy("point").agg(F.min("doc_id").alias("least"))
    roots = written(_roots(marked, radius, shard, sample).join(members, "point"), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return marked.join(named.select("point", "component_id"), "point").select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, size: int = 4, radius: int = 4, shard: int = SHARD, sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with one document of each component: the smallest ``doc_id`` (nulls last; then by a
    hash of the text).  Of rows equal in id and text one stays."""
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    marked = written(
        docs.select("doc_id", "text")
        .withColumns({"k1": k1, "k2": k2, "point": fingerprint(F.col("text"), size)})
        .drop("text"),
        "marked",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    members = marked.groupBy("point", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    first = members.groupBy("point").agg(F.min(F.struct(order.alias("at"), "rows")).alias("first"))
    kept = (
        _roots(marked, radius, shard, sample)
        .join(first, "point")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(
            F.col("first.at.k1").alias("__k1"), F.col("first.at.k2").alias("__k2"),
            F.col("first.rows").alias("__rows"),
        )
    )
    found = docs.withColumns({"__k1": k1, "__k2": k2}).join(kept, ["__k1", "__k2"])
    found = written(found, "kept-documents")
    once = found.where("__rows = 1")
    again = found.where("__rows > 1").dropDuplicates(["__k1", "__k2"])
    return once.unionByName(again).drop("__k1", "__k2", "__rows")
