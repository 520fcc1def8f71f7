"""Vector transforms learned from scatter sums: centre, length-normalise, LDA, WCCN, and the two-covariance model.

Only sums of dims x dims numbers reach the driver, whatever the number of vectors or speakers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Scatter:
    n: int
    speakers: int
    mean: np.ndarray
    within: np.ndarray
    between: np.ndarray
    equal_within: np.ndarray


def _outer(rows: DataFrame, weight: str, value: str, dims: int) -> np.ndarray:
    """Sum of weight * value value^T, by partial sums in each Arrow batch and one aggregation."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(float)
                total += (x * b["w"].to_numpy(float)[:, None]).T @ x
        i, j = np.indices((dims, dims))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = rows.select(F.col(weight).cast("double").alias("w"), F.col(value).alias("v")).mapInPandas(part, "i int, j int, s double")
    out = np.zeros((dims, dims))
    for r in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def scatter(rows: DataFrame, speaker: str, value: str, dims: int) -> Scatter:
    """Within and between scatter of labelled vectors (array<double> of ``dims``)."""
    each = rows.select(speaker, F.posexplode(value).alias("i", "x")).groupBy(speaker, "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    means = each.groupBy(speaker).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    t = each.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g")).orderBy("i").collect()  # ``dims`` rows
    mean = np.array([r["g"] for r in t])
    count = means.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    centred = means.withColumn("m", F.zip_with("m", F.array(*[F.lit(float(g)) for g in mean]), lambda a, b: a - b))
    between = _outer(centred, "n", "m", dims) / count["n"]
    inside = rows.select(speaker, F.col(value).alias("v")).join(means, speaker).select(F.zip_with("v", "m", lambda a, b: a - b).alias("d"), F.lit(1.0).alias("one"), (1 / F.col("n")).alias("share"))
    within = _outer(inside, "one", "d", dims) / count["n"]
    equal = _outer(inside, "share", "d", dims) / count["k"]
    return Scatter(int(count["n"]), int(count["k"]), mean, within, between, equal)


def discriminants(s: Scatter, keep: int, ridge: float = 1e-4) -> np.ndarray:
    """Directions (dims x keep) of most between- for their within-scatter: whiten, then the symmetric problem."""
    w = s.within + ridge * np.trace(s.within) / len(s.within) * np.eye(len(s.within))
    half = np.linalg.inv(np.linalg.cholesky(w))
    value, vector = np.linalg.eigh(half @ s.between @ half.T)
    return (half.T @ vector[:, np.argsort(-value)])[:, :keep]


def wccn(covariance: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    c = covariance + ridge * np.trace(covariance) / len(covariance) * np.eye(len(covariance))
    return np.linalg.cholesky(np.linalg.inv(c))


def apply(value: Column, matrix: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """(value - mean) times a matrix of fixed size, as one array expression."""
    v = value if mean is None else F.zip_with(value, F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in matrix[:, j]]) for j in range(matrix.shape[1])])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(v, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def unit(value: Column) -> Column:
    norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(value, lambda x: x / norm)).otherwise(value)


def two_covariance(s: Scatter) -> tuple[np.ndarray, np.ndarray]:
    """(T, psi): the space in which within is 1 and between is psi, from unbiased scatter estimates."""
    size = s.n / s.speakers
    within = s.within * s.n / max(s.n - s.speakers, 1)
    between = s.between - within / size
    half = np.linalg.inv(np.linalg.cholesky(within + 1e-9 * np.eye(len(within))))
    value, vector = np.linalg.eigh(half @ between @ half.T)
    order = np.argsort(-value)
    return half.T @ vector[:, order], np.maximum(value[order], 0.0)
