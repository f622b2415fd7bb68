"""Column statistics and principal components, with and without missing values."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.session import written

#: Rounds that are always made before the threshold counts.
LEAST_ROUNDS = 5


def column_stats(rows: DataFrame, column: str) -> DataFrame:
    """``(pos, n, mean, variance)`` per array position, ignoring nulls."""
    cells = rows.select(F.posexplode(column).alias("pos", "v")).select(
        "pos", F.col("v").cast("double").alias("v")
    )
    return cells.groupBy("pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance")
    )


def percent_variance(stats: DataFrame) -> DataFrame:
    total = stats.agg(F.sum("variance"))
    return stats.withColumn("percent", 100 * F.col("variance") / total.scalar())


def pca(rows: DataFrame, column: str, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """MLlib components of complete data: rows with ``scores``, loadings, explained shares.

    Of either sign of a component the one with a positive largest loading is taken.
    """
    vectors = rows.withColumn("_v", array_to_vector(F.transform(column, lambda v: v.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="scores").fit(vectors)
    loadings = model.pc.toArray()
    turned = signed(loadings)
    turn = F.array(*(F.lit(float(s)) for s in (turned * loadings).sum(axis=0)))
    scored = model.transform(vectors).drop("_v")
    scores = F.zip_with(vector_to_array("scores"), turn, lambda v, t: v * F.signum(t))
    return scored.withColumn("scores", scores), turned, np.asarray(model.explainedVariance.toArray())


@dataclass
class Components:
    """Result of :func:`ppca`."""

    loadings: np.ndarray  # dimensions x components, orthonormal
    mean: np.ndarray
    noise: float
    eigenvalues: np.ndarray
    percent: np.ndarray
    rounds: int
    completed: DataFrame  # (id, y: completed row, x: scores of the centred row)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _scores(y: np.ndarray, seen: np.ndarray, loadings: np.ndarray, noise: float) -> np.ndarray:
    """Scores of rows from their seen cells alone.

    Filling hidden cells from the scores and scoring the filled row again has this limit, so no
    row needs to remember its scores of the round before.
    """
    k = loadings.shape[1]
    outer = loadings[:, :, None] * loadings[:, None, :]
    grams = (seen.astype(float) @ outer.reshape(len(loadings), -1)).reshape(-1, k, k)
    return np.linalg.solve(grams + noise * np.eye(k), (y @ loadings)[:, :, None])[:, :, 0]


class Extrapolation:
    """Anderson acceleration of a fixed-point map with a monotone safeguard.

    ``after(point, image, value)`` gives the next point from the last few differences; a point whose
    ``value`` rose is given up for the plain image of the best point, and the memory is dropped.
    """

    def __init__(self, memory: int = 10, warm_up: int = 4):
        self.memory, self.warm_up = memory, warm_up
        self.images: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []
        self.best = np.inf
        self.fallback: np.ndarray | None = None
        self.calls = 0

    def after(self, point: np.ndarray, image: np.ndarray, value: float) -> np.ndarray:
        self.calls += 1
        if self.fallback is not None and not value <= self.best + 1e-9 * abs(self.best):
            back, self.fallback = self.fallback, None
            self.images, self.steps = [], []
            return back
        self.best, self.fallback = value, None
        self.images = [*self.images, image][-self.memory - 1 :]
        self.steps = [*self.steps, image - point][-self.memory - 1 :]
        if self.calls < self.warm_up or len(self.steps) < 2:
            return image
        by_step = np.diff(np.array(self.steps), axis=0).T
        by_image = np.diff(np.array(self.images), axis=0).T
        gram = by_step.T @ by_step
        ridge = 1e-10 * np.trace(gram) * np.eye(len(gram))
        share = np.linalg.lstsq(gram + ridge, by_step.T @ self.steps[-1], rcond=None)[0]
        self.fallback = image
        return image - by_image @ share


def em_step(total: np.ndarray, n: int, missing: int, loadings: np.ndarray, noise: float):
    """``(loadings, noise, objective)`` of the next round from the summed moments of all rows."""
    d, k = loadings.shape
    yx, xx, yy = total[: d * k].reshape(d, k), total[d * k : d * k + k * k].reshape(k, k), total[-1]
    sx = np.linalg.inv(np.eye(k) + loadings.T @ loadings / noise)
    after = yx @ np.linalg.inv(xx + n * sx)
    ctc = after.T @ after
    # squared distance of the filled rows to their reconstruction, from the moments
    residual = yy - 2 * np.sum(yx * after) + np.trace(xx @ ctc)
    noise_after = float((residual + n * np.sum(ctc * sx) + missing * noise) / (n * d))
    objective = (
        n * (d * np.log(noise_after) + np.trace(sx) - np.log(np.linalg.det(sx)))
        + np.trace(xx)
        - missing * np.log(noise)
    )
    return after, noise_after, objective


def moments(y: np.ndarray, hidden: np.ndarray, loadings: np.ndarray, noise: float) -> np.ndarray:
    """Moments of rows with their hidden cells filled: rows x scores, scores x scores, sum of squares."""
    x = _scores(np.where(hidden, 0.0, y), ~hidden, loadings, noise)
    filled = np.where(hidden, x @ loadings.T, y)
    return np.concatenate([(filled.T @ x).ravel(), (x.T @ x).ravel(), [(filled**2).sum()]])


def ppca(
    rows: DataFrame,
    key: str,
    column: str,
    k: int = 2,
    threshold: float = 1e-5,
    max_rounds: int | None = None,
    seed: int = 11,
) -> Components:
    """Probabilistic PCA by accelerated expectation maximisation; null cells are estimated.

    Each round is one pass in which tasks add up sums of fixed size (dimensions x components); only
    those reach the driver, which solves the small systems.  Scores follow from the parameters and
    the seen cells of a row, so rows hold no state, every round reads the same stored rows, and the
    round is a plain map of the parameters.  That map creeps along its slowest direction for
    thousands of rounds; ``Extrapolation`` takes the same map to the same fixed point in some tens.
    The rounds go on until the objective changes by less than ``threshold`` and the parameters by
    less than its root; with ``max_rounds`` an unconverged fit is an error.
    """
    stats = column_stats(rows, column).orderBy("pos").toPandas()  # one row per dimension
    mean, d = stats["mean"].to_numpy(), len(stats)
    n = rows.count()
    missing = int(n * d - stats["n"].sum())
    rng = np.random.default_rng(seed)
    loadings = rng.standard_normal((d, k))

    centred = F.transform(column, lambda v, i: v.cast("double") - F.lit(mean.tolist())[i])
    stored = written(rows.select(key, centred.alias("y")), "ppca")

    def sums(part):
        """Sum of ``part(cells, hidden)`` over all rows."""

        def run(batches):
            acc = None
            for pdf in batches:
                y = _matrix(pdf["y"])
                found = part(y, np.isnan(y))
                acc = found if acc is None else acc + found
            if acc is not None:
                yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

        totals = stored.select("y").mapInPandas(run, "i int, v double")
        return totals.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()

    def first_residual(y, hidden):
        y = np.where(hidden, 0.0, y)
        x = y @ loadings @ np.linalg.inv(loadings.T @ loadings)
        return np.array([(np.where(hidden, 0.0, x @ loadings.T - y) ** 2).sum()])

    noise = float(sums(first_residual)[0] / (n * d - missing))
    faster = Extrapolation()
    point = np.append(loadings.ravel(), np.log(noise))
    old = np.inf
    for done in itertools.count(1):
        loadings, noise = point[:-1].reshape(d, k), float(np.exp(point[-1]))
        total = sums(functools.partial(moments, loadings=loadings, noise=noise))
        after, noise_after, objective = em_step(total, n, missing, loadings, noise)
        image = np.append(after.ravel(), np.log(noise_after))
        change, old = abs(1 - objective / old), objective
        moved = np.linalg.norm(image - point) / np.linalg.norm(image)
        if change < threshold and moved < threshold**0.5 and done >= LEAST_ROUNDS:
            loadings, noise = after, noise_after
            break
        if done == max_rounds:
            raise RuntimeError(f"not converged after {done} rounds, last change {change:.3g}")
        point = faster.after(point, image, objective)

    final = written(_filled(stored, key, loadings, noise), "ppca-rows")
    basis = np.linalg.qr(loadings)[0]
    second = _second_moments(final, basis)
    covariance = (second["zz"] - np.outer(second["z"], second["z"]) / n) / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    basis, values = signed(basis @ vectors[:, order]), values[order]
    completed = final.mapInPandas(
        lambda batches: _project(batches, key, basis, mean), f"{key} bigint, y array<double>, x array<double>"
    )
    variance = (second["yy"] - second["y"] ** 2 / n) / (n - 1)
    return Components(
        basis, mean, noise, values, 100 * values / variance.sum(), done, completed
    )


def signed(basis: np.ndarray) -> np.ndarray:
    """Columns turned so that the loading of the largest size is positive."""
    top = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return basis * np.where(top < 0, -1.0, 1.0)


def _filled(stored: DataFrame, key: str, loadings: np.ndarray, noise: float) -> DataFrame:
    """Rows with hidden cells from the scores at the fitted parameters."""

    def run(batches):
        for pdf in batches:
            y = _matrix(pdf["y"])
            hidden = np.isnan(y)
            x = _scores(np.where(hidden, 0.0, y), ~hidden, loadings, noise)
            filled = np.where(hidden, x @ loadings.T, y)
            yield pd.DataFrame({key: pdf[key], "y": filled.tolist()})

    return stored.mapInPandas(run, f"{key} bigint, y array<double>")


def _second_moments(rows: DataFrame, basis: np.ndarray) -> dict[str, np.ndarray]:
    d, k = basis.shape

    def run(batches):
        acc = np.zeros(k * k + k + 2 * d)
        for pdf in batches:
            y = _matrix(pdf["y"])
            z = y @ basis
            acc += np.concatenate([(z.T @ z).ravel(), z.sum(0), y.sum(0), (y**2).sum(0)])
        yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

    total = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    v = total.orderBy("i").toPandas()["v"].to_numpy()
    cut = np.cumsum([k * k, k, d])
    zz, z, y, yy = np.split(v, cut)
    return {"zz": zz.reshape(k, k), "z": z, "y": y, "yy": yy}


def _project(batches, key, basis, mean):
    for pdf in batches:
        y = _matrix(pdf["y"])
        yield pd.DataFrame({key: pdf[key], "y": (y + mean).tolist(), "x": (y @ basis).tolist()})
