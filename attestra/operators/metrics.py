"""Proper scoring and calibration over trials (score, label): histograms first, windows over distinct scores after.

The number of distinct scores bounds what a window holds; for scores that are all different, ``binned`` rounds them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import LN10, cost, softplus
from ..sources.tables import stored
from . import kernel
from .ordered import between, cumulative, edges_of, in_ranges, quantiles

MIN_PER_CLASS = 30


def cllr(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cllr, n_same, n_different; null where a class is empty. One pass with partial sums."""
    c = cost(F.col("score"), F.col("label"))
    one, other = F.avg(F.when(F.col("label") == 1, c)), F.avg(F.when(F.col("label") == 0, c))
    return rows.groupBy(*by).agg((0.5 * (one + other)).alias("cllr"), F.count_if(F.col("label") == 1).alias("n_same"), F.count_if(F.col("label") == 0).alias("n_different"))


def histogram(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """score, n_same, n_different: equal scores are one row from here on."""
    return rows.where("score is not null").groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("n_same"), F.count_if(F.col("label") == 0).alias("n_different"))


def summed(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``histogram`` of rows (score, label, n) that stand for n trials each."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0))
    return rows.where("score is not null").groupBy(*by, "score").agg(of(1).alias("n_same"), of(0).alias("n_different"))


def binned(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.withColumn("score", F.round("score", digits))


def totals(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return hist.groupBy(*by).agg(F.sum("n_same").alias("same"), F.sum("n_different").alias("different"))


def eer(hist: DataFrame) -> DataFrame:
    """One row eer: the interpolated crossing of false acceptance and false rejection over all distinct thresholds.

    Error rates at a threshold follow from what lies below it. Their difference falls from 1, so the crossing lies
    between the last threshold at which it is positive and the first at which it is not; where neither rate moves
    (a threshold below all scores) the ends are 1 and 0. The histogram is read several times, so it is stored: the trials
    behind it are scored once.
    """
    hist = stored(hist, "histogram")
    rows = cumulative(hist, "score", {"n_same": "s", "n_different": "d"}).crossJoin(F.broadcast(totals(hist)))
    rows = rows.select("score", (1 - F.col("d") / F.col("different")).alias("far"), (F.col("s") / F.col("same")).alias("frr"))
    rows = rows.unionByName(hist.agg((F.min("score") - 1).alias("score")).select("score", F.lit(1.0).alias("far"), F.lit(0.0).alias("frr")))
    gap = F.col("far") - F.col("frr")
    point = F.struct("far", "frr")
    # two thresholds matter: the last before the sign changes, the first after
    ends = rows.agg(F.max_by(point, F.when(gap > 0, F.col("score"))).alias("a"), F.min_by(point, F.when(gap <= 0, F.col("score"))).alias("b"), F.min_by(point, F.abs(gap)).alias("c"))
    d0, d1 = F.col("a.far") - F.col("a.frr"), F.col("b.far") - F.col("b.frr")
    part = d0 / (d0 - d1)
    value = 0.5 * (F.col("a.far") + part * (F.col("b.far") - F.col("a.far")) + F.col("a.frr") + part * (F.col("b.frr") - F.col("a.frr")))
    return ends.select(F.coalesce(value, 0.5 * (F.col("c.far") + F.col("c.frr"))).alias("eer"))


def pool(n_same: np.ndarray, n_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators of tied groups in score order: (block of each group, value of each block)."""
    value, weight, size = [], [], []
    for s, n in zip(n_same, n_all):
        value.append(s / n)
        weight.append(float(n))
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, w, k = value.pop(), weight.pop(), size.pop()
            value[-1] = (value[-1] * weight[-1] + v * w) / (weight[-1] + w)
            weight[-1] += w
            size[-1] += k
    return np.repeat(np.arange(len(size)), size), np.array(value)


def _pooled(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with ``name``: the number of their block among the rows of one group of ``by``, in score order."""
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + f", {name} int"

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("score", ignore_index=True)
        block, _ = pool(p["n_same"].to_numpy(float), (p["n_same"] + p["n_different"]).to_numpy(float))
        return p.assign(**{name: block.astype("int32")})

    return rows.groupBy(*by).applyInPandas(fit, schema)


def pav(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hist with block and fitted, for each group of ``by``.

    Scores are pooled inside ranges, then the ranges' blocks (one row each) across them: pooling what is pooled already
    gives the same fit. A task holds a range's distinct scores, or the blocks of a group.
    """
    ranged = stored(_pooled(in_ranges(hist.select(*by, "score", "n_same", "n_different"), "score"), [*by, "_range"], "_local"), "pooled")
    key = [*by, "_range", "_local"]
    blocks = ranged.groupBy(*key).agg(F.min("score").alias("score"), F.sum("n_same").alias("n_same"), F.sum("n_different").alias("n_different"))
    blocks = stored(_pooled(blocks, list(by), "block"), "blocks")
    share = F.sum("n_same") / F.sum(F.col("n_same") + F.col("n_different"))
    values = blocks.groupBy(*by, "block").agg(share.alias("fitted"))
    numbers = blocks.select(*key, "block").join(values, [*by, "block"])
    return ranged.join(numbers, key).drop("_range", "_local")


def pav_log_lr(fitted: Column, same: Column, different: Column) -> Column:
    """Posterior log odds less prior log odds; infinite in pure blocks."""
    return F.when(fitted <= 0, F.lit(-math.inf)).when(fitted >= 1, F.lit(math.inf)).otherwise(F.log(fitted) - F.log1p(-fitted) - F.log(same / different))


def cllr_min(fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """C_llr after the optimal monotone calibration."""
    t = totals(fitted, by)
    rows = fitted.join(F.broadcast(t), list(by)) if by else fitted.crossJoin(F.broadcast(t))  # a row for each group
    x = pav_log_lr(F.col("fitted"), F.col("same"), F.col("different"))
    finite = F.abs(x) != math.inf
    # a pure block costs its own class nothing and holds no trial of the other
    mine = F.sum(F.when(finite, F.col("n_same") * softplus(-x)).otherwise(0.0))
    other = F.sum(F.when(finite, F.col("n_different") * softplus(x)).otherwise(0.0))
    return rows.groupBy(*by).agg((0.5 * (mine / F.first("same") + other / F.first("different")) / math.log(2)).alias("cllr_min"))


def with_devils(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hist with a different-source trial above all scores and a same-source trial below, in each group of ``by``."""
    ends = hist.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).withColumn("m", F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)))
    added = ends.select(*by, F.explode(F.array(F.struct((F.col("hi") + F.col("m")).alias("score"), F.lit(0).cast("long").alias("n_same"), F.lit(1).cast("long").alias("n_different")),
                                               F.struct((F.col("lo") - F.col("m")).alias("score"), F.lit(1).cast("long").alias("n_same"), F.lit(0).cast("long").alias("n_different")))).alias("x"))
    return hist.select(*by, "score", "n_same", "n_different").unionByName(added.select(*by, "x.*"))


def elub(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group) lower_log_lr, upper_log_lr: extreme finite block values of the refitted calibration."""
    fitted = pav(with_devils(hist, by), by)
    t = F.broadcast(totals(fitted, by))  # a row for each group
    x = pav_log_lr(F.col("fitted"), F.col("same"), F.col("different"))
    rows = (fitted.join(t, list(by)) if by else fitted.crossJoin(t)).select(*by, F.when(F.abs(x) != math.inf, x).alias("x"))
    return rows.groupBy(*by).agg(F.min("x").alias("lower_log_lr"), F.max("x").alias("upper_log_lr"))


#: What a C_llr says of a system; at 1 it says nothing, above 1 it misleads.
MARGINAL_ABOVE = 0.9


def grade(c: Column) -> Column:
    near_one = F.abs(c - 1) <= 1e-9 * F.greatest(F.abs(c), F.lit(1.0))
    return F.when(near_one, "uninformative").when(c > 1, "misleading").when(c > MARGINAL_ABOVE, "marginal").otherwise("informative")


def evaluation(rows: DataFrame) -> DataFrame:
    """One row for reported natural log LRs (score, label): cllr, cllr_min (never above cllr), calibration_loss, eer,
    lower_log10, upper_log10 (bounds), n_same, n_different, grade."""
    hist = stored(histogram(rows), "histogram")
    c = cllr(rows).crossJoin(cllr_min(pav(hist))).crossJoin(eer(hist)).crossJoin(elub(hist))  # one row each
    least = F.least("cllr_min", "cllr")
    bounds = [(F.col(f"{k}_log_lr") / LN10).alias(f"{k}_log10") for k in ("lower", "upper")]
    return c.select("cllr", least.alias("cllr_min"), (F.col("cllr") - least).alias("calibration_loss"), "eer", *bounds, "n_same", "n_different", grade(F.col("cllr")).alias("grade"))


def clipping(rows: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """One row clipped, clipped_same, clipped_different: shares of log LRs (score, label) that bounds change."""
    out = ((F.col("score") < lower) | (F.col("score") > upper)).cast("double")
    of = lambda k: F.coalesce(F.avg(F.when(F.col("label") == k, out)), F.lit(0.0))
    return rows.agg(F.avg(out).alias("clipped"), of(1).alias("clipped_same"), of(0).alias("clipped_different"))


def tippett(hist: DataFrame) -> DataFrame:
    """score, same_above, different_below: shares of same-source trials at or above a score, of different-source at or below."""
    rows = cumulative(hist, "score", {"n_same": "s", "n_different": "d"}).crossJoin(F.broadcast(totals(hist)))
    above, below = (F.col("same") - F.col("s")) / F.col("same"), (F.col("d") + F.col("n_different")) / F.col("different")
    return rows.select("score", above.alias("same_above"), below.alias("different_below"))


def kish(rows: DataFrame, owner: str) -> DataFrame:
    """One row n_owners, effective_n: (sum n)^2 / sum n^2 over owners."""
    n = rows.groupBy(owner).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_owners"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_n"))


class TooFewTrials(ValueError):
    """A calibrator refuses a class with fewer trials than MIN_PER_CLASS."""


def fit_logistic(rows: DataFrame, steps: int = 60) -> tuple[float, float]:
    """(slope >= 0, intercept) that minimise C_llr on standardised scores; each Newton step is one aggregation."""
    ends = rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
    if min(ends["a"], ends["b"]) < MIN_PER_CLASS:
        raise TooFewTrials("too few trials of a class to calibrate")
    spread = ends["s"] or 1.0
    z = rows.select(((F.col("score") - ends["m"]) / spread).alias("z"), "label", F.when(F.col("label") == 1, 0.5 / ends["a"]).otherwise(0.5 / ends["b"]).alias("w")).persist()
    a, b = 1.0, 0.0
    for _ in range(steps):
        x = F.lit(a) * F.col("z") + F.lit(b)
        p = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
        g, h = F.col("w") * (p - F.col("label")), F.col("w") * p * (1 - p)
        r = z.agg(F.sum(g * F.col("z")), F.sum(g), F.sum(h * F.col("z") * F.col("z")), F.sum(h * F.col("z")), F.sum(h)).first()
        hess = np.array([[r[2] + 1e-9, r[3]], [r[3], r[4] + 1e-9]])
        step = np.linalg.solve(hess, np.array([r[0], r[1]]))
        if a - step[0] < 0:  # at the bound only the intercept is free
            step = np.array([a, r[1] / (r[4] + 1e-9)])
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    z.unpersist()
    return a / spread, b - a * ends["m"] / spread


def knots(fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """score, log_lr: one knot a block, at its highest score, the posterior kept off 0 and 1."""
    t = F.broadcast(totals(fitted, by))  # a row for each group
    n = F.col("same") + F.col("different")
    p = F.greatest(F.least(F.col("fitted"), 1 - 1 / (2 * n)), 1 / (2 * n))
    rows = fitted.groupBy(*by, "block").agg(F.max("score").alias("score"), F.first("fitted").alias("fitted"))
    rows = rows.join(t, list(by)) if by else rows.crossJoin(t)
    return rows.select(*by, "score", (F.log(p) - F.log1p(-p) - F.log(F.col("same") / F.col("different"))).alias("log_lr"))


def interpolated(rows: DataFrame, at: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with log_lr between knots (of their group), constant outside. Scores are not null.

    Rows and knots go to score ranges; inside, a row has a knot before and after it in order, and across ranges the last
    knot before and the first one after come from a row for each range.
    """
    edges = edges_of(rows, "score")
    knot = F.struct(F.col("score").alias("x"), F.col("log_lr").alias("y"))
    k = between(at.select(*by, "score", knot.alias("_knot")), "score", edges)
    ends = k.groupBy(*by, "_range").agg(F.min("_knot").alias("first"), F.max("_knot").alias("last"))
    every = ends.select(*by).distinct() if by else ends.limit(1).select()
    ends = every.crossJoin(rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("_range"))).join(ends, [*by, "_range"], "left")
    along = Window.partitionBy(*by).orderBy("_range")
    outside = ends.select(
        *by, "_range",
        F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("first").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    placed = between(rows, "score", edges)
    whole = placed.withColumn("_knot", F.lit(None).cast(k.schema["_knot"].dataType)).unionByName(k.withColumn("_is", F.lit(True)), allowMissingColumns=True)
    # both frames grow along their order: one that shrinks is read anew for every row
    grown = lambda order: Window.partitionBy(*by, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.last("_knot", True).over(grown(F.asc("score"))), F.last("_knot", True).over(grown(F.desc("score")))
    whole = whole.withColumns({"_low": low, "_high": high}).where("_is is null")
    out = whole.join(F.broadcast(outside), [*by, "_range"], "left")  # ranges times groups
    a, b = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    s = F.col("score")
    y = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == s) | (a["x"] == b["x"]), a["y"]).otherwise(a["y"] + (s - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))
    return out.withColumn("log_lr", y).select(*rows.columns, "log_lr")


def silverman(rows: DataFrame) -> DataFrame:
    """label, n, h: bandwidths of the two classes."""
    q = rows.groupBy("label").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("s"))
    middle = F.lit(None).cast("double")
    for label, (low, high) in quantiles(rows, F.col("score"), (0.25, 0.75), "label").items():
        middle = F.when(F.col("label").eqNullSafe(F.lit(label)), high - low).otherwise(middle)
    q = q.withColumn("iqr", middle)
    s = F.when(F.col("iqr") > 0, F.least("s", F.col("iqr") / 1.34)).otherwise(F.col("s"))
    return q.select("label", "n", (0.9 * F.when(s > 0, s).otherwise(1e-6) * F.pow("n", F.lit(-0.2))).alias("h"))


def kde_log_ratio(queries: DataFrame, hist: DataFrame, bandwidths: DataFrame) -> DataFrame:
    """score, log_ratio for distinct query scores: log density among same-source less that among different-source.

    The sample enters as a histogram of distinct scores, gathered into cells; no query meets a sample row.
    """
    h = {r["label"]: r["h"] for r in bandwidths.collect()}  # two rows
    of = lambda label, n: kernel.density(hist.where(F.col(n) > 0).select("score", F.col(n).alias("w")), h.get(label) or 1e-6)
    return kernel.log_ratios(queries.select("score").distinct(), of(1, "n_same"), of(0, "n_different"))
