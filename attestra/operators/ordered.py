"""Running sums over a whole table without one window over all of it.

Rows go to ranges of the order key; windows stay inside a range, and what the ranges before hold comes from one row a
range. The number of ranges bounds what the last step sees, not the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
#: Boundaries that a nested condition holds; more are counted one by one.
NESTED = 255
#: Parts that a stretch of values is cut into to find a rank, and values that are collected to find the ranks among them.
PARTS, COLLECTED = 16_384, 100_000


def edges_of(rows: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """Boundaries of ranges of ``order``: approximate quantiles."""
    return sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)))


def below(column: str, edges: list[float]) -> Column:
    """The number of sorted ``edges`` below a value, found by halves; 0 where it is null."""
    if len(edges) > NESTED:
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(column)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(float(edges[middle])) < F.col(column), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(edges))


def between(rows: DataFrame, order: str, edges: list[float]) -> DataFrame:
    """rows with _range: the number of boundaries below."""
    return rows.withColumn("_range", below(order, edges))


def in_ranges(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """rows with _range: the number of their range of ``order``. Boundaries are approximate quantiles."""
    return between(rows, order, edges_of(rows, order, ranges))


def cumulative(rows: DataFrame, order: str, columns: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """rows (one for each value of ``order``) with, for column -> name, name: the sum over all rows before.

    The result doesn't depend on the ranges' boundaries.
    """
    placed = in_ranges(rows, order, ranges)
    sums = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for c, n in columns.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in columns.values()])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(sums), "_range")  # at most ``ranges`` rows
    out = out.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}") for c, n in columns.items()})
    return out.drop("_range", *[f"_{n}" for n in columns.values()])


@dataclass
class _Stretch:
    """The n values of a group from low to high, of which ``before`` smaller ones come first, and the ranks looked for."""

    key: object
    low: float
    high: float
    before: int
    n: int
    ranks: list[int]

    def of(self, groups: dict[object, np.ndarray]) -> np.ndarray:
        v = groups.get(self.key, np.zeros(0))
        return v[(v >= self.low) & (v <= self.high)]

    def parts(self, v: np.ndarray, number: int) -> np.ndarray:
        """Halved, so that no difference overflows; the two ends never share a part."""
        return np.minimum((v / 2 - self.low / 2) / (self.high / 2 - self.low / 2) * number, number - 1).astype(np.int32)


def _groups(b: pa.RecordBatch) -> dict[object, np.ndarray]:
    """The values of each group; those that are null are left out."""
    b = b.filter(b["v"].is_valid())
    codes = b["k"].dictionary_encode("encode")
    at, v = np.asarray(codes.indices), np.asarray(b["v"], float)
    return {key: v[at == i] for i, key in enumerate(codes.dictionary.to_pylist())}


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of a batch: how many values are least, finite and largest, and the finite ones' ends."""
    for b in batches:
        rows = []
        for key, v in _groups(b).items():
            inner = v[np.isfinite(v)]
            some = len(inner) > 0
            rows.append((key, len(v), int((v == -np.inf).sum()), len(inner), int((v == np.inf).sum()), float(inner.min()) if some else None, float(inner.max()) if some else None))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [b.schema.field("k").type, *[pa.int64()] * 4, *[pa.float64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "n", "least", "finite", "most", "low", "high"])


def _counted(rows: DataFrame, rest: list[_Stretch]) -> pd.DataFrame:
    """i, part, n, low, high of the occupied parts of each stretch, counted in the tasks."""
    parts = PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = (np.full((len(rest), parts), x, t) for x, t in ((0, np.int64), (np.inf, float), (-np.inf, float)))
        for b in batches:
            groups = _groups(b)
            for i, s in enumerate(rest):
                v = np.sort(s.of(groups))  # so that parts come in order
                if len(v):
                    part, first, many = np.unique(s.parts(v, parts), return_index=True, return_counts=True)
                    n[i, part] += many
                    low[i, part] = np.minimum(low[i, part], v[first])
                    high[i, part] = np.maximum(high[i, part], v[first + many - 1])
        i, part = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i.astype(np.int32), part.astype(np.int32), n[i, part], low[i, part], high[i, part])], ["i", "part", "n", "low", "high"])

    counts = rows.mapInArrow(run, "i int, part int, n long, low double, high double").groupBy("i", "part")
    return counts.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()


def _collected(rows: DataFrame, rest: list[_Stretch]) -> list[np.ndarray]:
    """The sorted values of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = _groups(b)
            own = [s.of(groups) for s in rest]
            i = np.repeat(np.arange(len(rest), dtype=np.int32), [len(v) for v in own])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.concatenate(own))], ["i", "v"])

    got = rows.mapInArrow(run, "i int, v double").toPandas()
    return [np.sort(got["v"].to_numpy(float)[got["i"].to_numpy() == i]) for i in range(len(rest))]


def quantiles(rows: DataFrame, value: Column, shares: Sequence[float], by: str | None = None) -> dict[object, list[float]]:
    """Exact interpolated quantiles of the values that are not null, for each value of ``by`` (None without it); groups without values have none.

    The stretch that holds a rank is cut into parts whose counts tell in which of them it lies, until few values are left:
    the driver gets COLLECTED values and PARTS counts a stretch at most, whatever the number of rows, which are read three times or so.
    """
    # values are worked out once a reading and counted in arrays
    rows = rows.select((F.lit(None).cast("int") if by is None else F.col(by)).alias("k"), value.cast("double").alias("v"))
    many = [F.sum(c).alias(c) for c in ("n", "least", "finite", "most")]
    ends = rows.mapInArrow(_ends, f"k {rows.schema['k'].dataType.simpleString()}, n long, least long, finite long, most long, low double, high double")
    ends = ends.groupBy("k").agg(*many, F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row a group
    inf, found, open_ = math.inf, {}, []
    for r in ends:
        ranks = {k for q in shares for k in (math.floor(q * (r["n"] - 1)), math.ceil(q * (r["n"] - 1)))}
        top = r["least"] + r["finite"]
        found |= {(r["k"], k): -inf if k < r["least"] else inf if k < top + r["most"] else math.nan for k in ranks}
        if inner := sorted(k for k in ranks if r["least"] <= k < top):
            open_.append(_Stretch(r["k"], r["low"], r["high"], r["least"], r["finite"], inner))
    while True:
        rest = []
        for s in open_:
            left = []
            for k in s.ranks:
                if s.low / 2 == s.high / 2 or k == s.before:
                    found[s.key, k] = s.low
                elif k == s.before + s.n - 1:
                    found[s.key, k] = s.high
                else:
                    left.append(k)
            if left:
                rest.append(_Stretch(s.key, s.low, s.high, s.before, s.n, left))
        if not rest:
            break
        if sum(s.n for s in rest) <= COLLECTED:
            found |= {(s.key, k): float(v[k - s.before]) for s, v in zip(rest, _collected(rows, rest)) for k in s.ranks}
            break
        counts, open_ = _counted(rows, rest), []
        for i, s in enumerate(rest):
            own = counts[counts["i"] == i].sort_values("part")
            until = s.before + own["n"].to_numpy().cumsum()
            at = np.searchsorted(until, s.ranks, side="right")
            for p in np.unique(at):
                n = int(own["n"].iloc[p])
                open_.append(_Stretch(s.key, float(own["low"].iloc[p]), float(own["high"].iloc[p]), int(until[p]) - n, n, [k for k, a in zip(s.ranks, at) if a == p]))
    out = {}
    for r in ends:
        out[r["k"]] = []
        for q in shares:
            place = q * (r["n"] - 1)
            low, high = math.floor(place), math.ceil(place)
            a, b = found[r["k"], low], found[r["k"], high]
            out[r["k"]].append(a if low == high or a == b else (high - place) * a + (place - low) * b)
    return out
