"""Ordered-sequence operators: runs, hangover, gaps, sliding and whole normalisation, deltas, perturbation.

``part`` and ``order`` name a sequence and the place in it; every window is partitioned by ``part``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: str, order: str):
    return Window.partitionBy(part).orderBy(order)


def runs(rows: DataFrame, part: str, order: str, flag: Column) -> DataFrame:
    """part, run, value, first, last, n: maximal runs of an equal flag (gaps and islands)."""
    w = _w(part, order)
    marked = rows.select(part, order, flag.alias("value")).withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag(order).over(w).isNull()).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w))
    return marked.groupBy(part, "run").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def true_runs(rows: DataFrame, part: str, order: str, flag: Column, least: int = 1) -> DataFrame:
    """Runs where the flag holds, at least ``least`` long."""
    return runs(rows, part, order, flag).where(F.col("value") & (F.col("n") >= least)).drop("value")


def bridged(rows: DataFrame, part: str, order: str, flag: Column, most: int) -> DataFrame:
    """part, first, last of true runs once false runs of at most ``most`` between two true ones are filled."""
    r = runs(rows, part, order, flag)
    w = _w(part, "run")
    inner = ~F.col("value") & (F.col("n") <= most) & F.lag("value").over(w) & F.lead("value").over(w)
    filled = r.withColumn("on", F.col("value") | F.coalesce(inner, F.lit(False)))
    out = filled.withColumn("new", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).withColumn("k", F.sum("new").over(w)).where("on")
    return out.groupBy(part, "k").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("k")


def hangover(flag: Column, part: str, order: str, reach: int) -> Column:
    """The flag held on for ``reach`` rows after it was last set."""
    return F.max(flag).over(_w(part, order).rowsBetween(-reach, 0))


def pauses(r: DataFrame, part: str) -> DataFrame:
    """part, after, pause: places between the end of a run and the start of the next."""
    gap = F.lead("first").over(_w(part, "first")) - F.col("last")
    return r.select(part, F.col("last").alias("after"), gap.alias("pause")).where("pause is not null")


def sliding(rows: DataFrame, part: str, order: str, value: str, window: int, digits: int | None = None) -> DataFrame:
    """rows with normalised: centred sliding mean and variance over 2*(window//2)+1 places, edge rows repeated outwards.

    Running sums make it one pass whatever the width; what a frame lacks at an edge is that many copies of the edge row.
    """
    h = window // 2
    w, all_ = _w(part, order), Window.partitionBy(part)
    around = w.rowsBetween(-h, h)
    i, n = F.row_number().over(w), F.count("*").over(all_)
    ends = rows.withColumns({"_i": i, "_n": n, "_first": F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_last": F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
                             "_s": F.sum(value).over(around), "_q": F.sum(F.col(value) * F.col(value)).over(around)})
    left, right = F.greatest(h + 1 - F.col("_i"), F.lit(0)), F.greatest(F.col("_i") + h - F.col("_n"), F.lit(0))
    size = 2 * h + 1
    mean = (F.col("_s") + left * F.col("_first") + right * F.col("_last")) / size
    square = (F.col("_q") + left * F.col("_first") * F.col("_first") + right * F.col("_last") * F.col("_last")) / size
    spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    out = (F.col(value) - mean) / F.when(spread < 1e-8, 1.0).otherwise(spread)
    return ends.withColumn("normalised", out).drop("_i", "_n", "_first", "_last", "_s", "_q")


def whole(value: Column, part: str) -> Column:
    """A z-score over the sequence; a constant sequence is only centred."""
    w = Window.partitionBy(part)
    s = F.stddev_pop(value).over(w)
    return (value - F.avg(value).over(w)) / F.when(s < 1e-8, 1.0).otherwise(s)


def delta(value: str, part: str, order: str, reach: int = 2) -> Column:
    """Regression slope over +-reach rows, edge rows repeated outwards."""
    w = _w(part, order)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(ends), F.last(value).over(ends)
    top = sum((k * (F.coalesce(F.lead(value, k).over(w), last) - F.coalesce(F.lag(value, k).over(w), first)) for k in range(1, reach + 1)), F.lit(0.0))
    return top / (2 * sum(k * k for k in range(1, reach + 1)))


def pre_emphasis(value: str, part: str, order: str, coefficient: float = 0.97) -> Column:
    return F.col(value) - coefficient * F.coalesce(F.lag(value).over(_w(part, order)), F.col(value))


def quotient(rows: DataFrame, part: str, order: str, value: str, places: int = 1) -> DataFrame:
    """part, quotient: mean absolute change between neighbours (1), or from a centred mean over ``places``, by the mean."""
    w = _w(part, order)
    if places == 1:
        change = F.abs(F.col(value) - F.lag(value).over(w))
    else:
        h = places // 2
        inside = (F.row_number().over(w) > h) & (F.lead(value, h).over(w).isNotNull())
        change = F.when(inside, F.abs(F.col(value) - F.avg(value).over(w.rowsBetween(-h, h))))
    return rows.select(part, F.abs(value).alias("v"), change.alias("c")).groupBy(part).agg((F.avg("c") / F.avg("v")).alias("quotient")).where("quotient is not null")


def frames(rows: DataFrame, part: str, order: str, value: str, length: int, hop: int) -> DataFrame:
    """part, frame, n, mean, energy of overlapping frames; a partial tail is dropped. A row goes to every frame over it."""
    w = _w(part, order)
    placed = rows.select(part, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(part)).alias("_n"))
    low = F.greatest(F.ceil((F.col("i") - length + 1) / hop), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("i") / hop), F.floor((F.col("_n") - length) / hop)).cast("long")
    spread = placed.where((F.col("_n") >= length) & (low <= high)).select(part, "v", F.explode(F.sequence(low, high)).alias("frame"))
    return spread.groupBy(part, "frame").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("energy"))


def _closed(sizes: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, packs, carry): running sums, and for a pack begun at each row, or after the last, what is closed and open at the end."""
    sums, n = np.cumsum(sizes), len(sizes)
    before = np.concatenate([[0.0], sums])
    ends = np.searchsorted(sums, before[:-1] + target)  # the row that fills a pack begun at each row
    packs, carry = np.zeros(n + 1, "int64"), np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        if ends[i] < n:
            packs[i], carry[i] = packs[ends[i] + 1] + 1, carry[ends[i] + 1]
        else:
            carry[i] = sums[-1] - before[i]
    return sums, packs, carry


def folded(rows: DataFrame, part: str, order: str, size: Column, target: int, name: str = "pack", tail: float | None = None, width: int = 10_000) -> DataFrame:
    """part, order, pack: rows packed in order until a pack reaches ``target``, then afresh; the unfinished tail has pack null,
    unless it reaches ``tail``. Null sizes count 0, a null order comes last, rows without a part are a part of their own.

    The total resets, so it is no running sum. A part is cut into stretches of ``width`` values of its (numeric) order. Each
    stretch says what it makes of any total that it may begin with: only the rows up to its first full pack matter for that. One pass over
    a part's stretches then gives each its beginning, and stretches are packed side by side.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (part, order)}
    stretch = F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(2**62))
    small_rows = rows.select(part, order, stretch.alias("_at"), F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_size"))

    def outcomes(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([order, "_size"], ignore_index=True)
        sums, packs, carry = _closed(p["_size"].to_numpy(), target)
        few = min(int(np.searchsorted(sums, target)) + 1, len(sums))  # later rows never end a pack that came in open
        row = p[[part, "_at"]].head(1).assign(total=sums[-1])
        return row.assign(sums=[sums[:few].tolist()], packs=[(packs[1 : few + 1] + 1).tolist()], carry=[carry[1 : few + 1].tolist()])

    def begun(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_at", ignore_index=True)
        done, held, first, opened = 0, 0.0, [], []
        for r in p.itertuples(index=False):
            first.append(done)
            opened.append(held)
            end = int(np.searchsorted(r.sums, target - held))
            if end < len(r.sums) and held + r.sums[end] >= target:
                done, held = done + int(r.packs[end]), float(r.carry[end])
            else:
                held += r.total
        return p[[part, "_at"]].assign(first=first, opened=opened, last=done, rest=held)

    def packed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([order, "_size"], ignore_index=True)
        sums, k, at = np.cumsum(p["_size"].to_numpy()), int(p["first"][0]), 0
        out, base = np.empty(len(p), "int64"), -float(p["opened"][0])
        while at < len(p):
            end = min(int(np.searchsorted(sums, base + target)), len(p) - 1)
            out[at : end + 1] = k
            at, k, base = end + 1, k + 1, sums[end]
        lost = (out == p["last"]) & (tail is None or float(p["rest"][0]) < tail)
        return p[[part, order]].assign(**{name: pd.array(np.where(lost, -1, out), dtype="Int32")}).replace({name: {-1: pd.NA}})

    key = f"`{part}` {kinds[part]}, _at long"
    said = small_rows.groupBy(part, "_at").applyInPandas(outcomes, f"{key}, total double, sums array<double>, packs array<long>, carry array<double>")
    begins = said.groupBy(part).applyInPandas(begun, f"{key}, first long, opened double, last long, rest double")
    begins = begins.withColumnsRenamed({part: "_part", "_at": "_begin"})
    joined = small_rows.join(begins, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_at") == F.col("_begin"))).drop("_part", "_begin")
    return joined.groupBy(part, "_at").applyInPandas(packed, f"`{part}` {kinds[part]}, `{order}` {kinds[order]}, {name} int")
