"""The two-covariance model by expectation maximisation, with unequal numbers of recordings a speaker.

What a speaker adds to a round depends on the number of recordings and on their sum alone, and quadratically on the sum.
So the sums' outer products, gathered once for each number of recordings, are all that the rounds read. A round turns them
to the axes on which both covariances are diagonal, so that it inverts one matrix, whatever the number of such numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

LEAST_SPEAKERS, LEAST_REPEATS = 10, 2
#: Fixed value: a direction with less between- than this share of its within-spread tells nobody apart.
INERT = 0.1


class TooFewSpeakers(ValueError):
    """Spread between or within speakers can't be estimated."""


@dataclass
class Statistics:
    mean: np.ndarray
    n: int
    #: sum of x x^T about the mean over all recordings
    total: np.ndarray
    #: number of recordings -> (speakers that have it, sum of f f^T over their sums f)
    by_count: dict[int, tuple[int, np.ndarray]]

    @property
    def speakers(self) -> int:
        return sum(k for k, _ in self.by_count.values())


def _outer_by(rows: DataFrame, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """rows: by int, v array<double> -> by -> (rows, sum of v v^T): one matrix a task and value of ``by``."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for key, own in b.groupby("by"):
                x = np.stack(own["v"].to_numpy()).astype(float)
                n, s = held.get(key, (0, 0.0))
                held[key] = n + len(own), s + x.T @ x
        for key, (n, s) in held.items():
            yield pd.DataFrame({"by": [key], "n": [n], "s": [s.ravel()]})

    got = rows.select("by", "v").mapInPandas(part, "by int, n long, s array<double>").select("by", "n", F.posexplode("s").alias("i", "x"))
    got = got.groupBy("by", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()  # dims^2 numbers for each value
    out = {}
    for key, own in got.groupby("by"):
        s = np.zeros(dims * dims)
        s[own["i"].to_numpy()] = own["x"].to_numpy()
        out[int(key)] = int(own["n"].iloc[0]), s.reshape(dims, dims)
    return out


def statistics(rows: DataFrame, speaker: str, value: str, dims: int) -> Statistics:
    """From labelled vectors (array<double> of ``dims``); rows without a speaker don't count."""
    rows = rows.where(F.col(speaker).isNotNull())
    flat = rows.select(F.col(speaker).alias("speaker"), F.posexplode(value).alias("i", "x"))
    each = stored(flat.groupBy("speaker", "i").agg(F.count("*").cast("int").alias("n"), F.sum("x").alias("f")), "speaker-sums")
    mean = each.groupBy("i").agg((F.sum("f") / F.sum("n")).alias("m")).orderBy("i").collect()  # ``dims`` rows
    mean = np.array([r["m"] for r in mean])
    if len(mean) != dims:
        raise TooFewSpeakers("no vectors")
    m = F.array(*[F.lit(float(x)) for x in mean])
    sums = each.groupBy("speaker").agg(F.first("n").alias("by"), F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda s: s["f"]).alias("f"))
    sums = sums.select("by", F.zip_with("f", m, lambda f, c: f - F.col("by") * c).alias("v"))
    total = _outer_by(rows.select(F.lit(0).alias("by"), F.zip_with(value, m, lambda x, c: x - c).alias("v")), dims)[0]
    return Statistics(mean, total[0], total[1], _outer_by(sums, dims))


class _Axes:
    """The space in which within is 1 and between is psi: there every number of recordings has diagonal matrices."""

    def __init__(self, s: Statistics, between: np.ndarray, within: np.ndarray):
        half = np.linalg.cholesky(within)
        back = np.linalg.inv(half)
        self.psi, turn = np.linalg.eigh(back @ between @ back.T)
        self.to, self.back = back.T @ turn, half @ turn  # to^T within to = 1, back back^T = within
        self.log_within = 2 * float(np.log(np.diag(half)).sum())
        self.total = ((s.total @ self.to) * self.to).sum(0)  # the diagonal of to^T total to


def _stacked(s: Statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of recordings, speakers that have them, and the sums' products, one below the other."""
    n = np.array(list(s.by_count), float)
    k, f = zip(*s.by_count.values())
    return n, np.array(k, float), np.stack(f)


def log_likelihood(s: Statistics, between: np.ndarray, within: np.ndarray) -> float:
    """Of all recordings, their speakers' places integrated out."""
    axes, (n, k, f) = _Axes(s, between, within), _stacked(s)
    return _log_likelihood(s, axes, n, k, axes.to.T @ f @ axes.to)


def _log_likelihood(s: Statistics, axes: _Axes, n: np.ndarray, k: np.ndarray, f: np.ndarray) -> float:
    d, both = len(axes.psi), 1 + n[:, None] * axes.psi[None, :]
    out = s.n * (d * math.log(2 * math.pi) + axes.log_within) + axes.total.sum()
    own = np.diagonal(f, axis1=1, axis2=2)
    out += (k[:, None] * np.log(both)).sum() + ((1 / both - 1) * own / n[:, None]).sum()
    return float(-0.5 * out)


@dataclass
class TwoCovariance:
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    n: int
    speakers: int
    converged: bool
    trace: list[float] = field(default_factory=list)

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """(T, psi): the space in which within is 1 and between is psi, largest first."""
        half = np.linalg.inv(np.linalg.cholesky(self.within))
        value, vector = np.linalg.eigh(half @ self.between @ half.T)
        order = np.argsort(-value)
        return half.T @ vector[:, order], np.maximum(value[order], 0.0)

    def diagnostics(self) -> dict[str, float]:
        """What one must know of a model to trust its scores: the spectrum of psi, and how the fit ended."""
        psi = self.axes()[1]
        total = float(psi.sum())
        second = float(psi[1]) if len(psi) > 1 else math.nan
        return {
            "dimension": len(psi), "effective_dimension": total**2 / float((psi**2).sum()) if total else 0.0, "n_above_inert": int((psi > INERT).sum()),
            "psi_1": float(psi[0]), "psi_2": second, "psi_ratio": float(psi[0]) / second if second else math.nan, "psi_mean": total / len(psi), "psi_1_share": float(psi[0]) / total if total else math.nan,
            "n_speakers": self.speakers, "n_recordings": self.n, "n_rounds": len(self.trace) - 1, "log_likelihood": self.trace[-1], "converged": float(self.converged),
        }


def fit(s: Statistics, rounds: int = 500, least_gain: float = 1e-7) -> TwoCovariance:
    """Ends when a round gains less than ``least_gain`` a recording. Raises TooFewSpeakers where a spread has no ground."""
    d = len(s.mean)
    if s.speakers < LEAST_SPEAKERS or max(s.by_count) < LEAST_REPEATS:
        raise TooFewSpeakers(f"{s.speakers} speakers, {max(s.by_count, default=0)} recordings at most")
    ridge = 1e-8 * max(float(np.trace(s.total)) / s.n / d, 1e-12) * np.eye(d)
    between = within = s.total / s.n / 2 + ridge
    n, k, f = _stacked(s)
    axes = _Axes(s, between, within)
    turned = axes.to.T @ f @ axes.to
    out = TwoCovariance(s.mean, between, within, s.n, s.speakers, False, [_log_likelihood(s, axes, n, k, turned)])
    for _ in range(rounds):
        # a speaker's place is lift f, and what is left of its spread is spread: diagonal on these axes
        lift = axes.psi[None, :] / (1 + n[:, None] * axes.psi[None, :])
        second = lift[:, :, None] * turned * lift[:, None, :]
        b = np.diag((k[:, None] * lift).sum(0)) + second.sum(0)
        w = np.diag((n[:, None] * k[:, None] * lift).sum(0)) + (n[:, None, None] * second - (lift[:, :, None] + lift[:, None, :]) * turned).sum(0)
        between, within = axes.back @ b @ axes.back.T / s.speakers + ridge, (s.total + axes.back @ w @ axes.back.T) / s.n + ridge
        between, within = (between + between.T) / 2, (within + within.T) / 2
        axes = _Axes(s, between, within)
        turned = axes.to.T @ f @ axes.to
        value = _log_likelihood(s, axes, n, k, turned)
        gain = value - out.trace[-1]
        out = TwoCovariance(s.mean, between, within, s.n, s.speakers, gain < least_gain * s.n, [*out.trace, value])
        if out.converged:
            break
    return out
