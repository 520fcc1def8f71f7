"""Spans, subsets, peaks and recordings on small tables with odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import selection


def test_spans_part_a_sequence(spark):
    for n in (1, 2, 3, 7, 10):
        rows = spark.range(n)
        thirds = [{r["id"] for r in rows.where(selection.in_span(F.col("id"), F.lit(n), a / 3, b / 3)).collect()} for a, b in ((0, 1), (1, 2), (2, 3))]
        assert sorted(x for t in thirds for x in t) == list(range(n))
    for bad in ((0.5, 0.5), (-0.1, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            selection.in_span(F.col("id"), F.lit(3), *bad)


def test_subset_holds_whole_owners(spark):
    rows = spark.createDataFrame([(i, f"o{i % 9}" if i % 10 else None) for i in range(90)], "i int, owner string")
    got = selection.owner_subset(rows, "owner", 4).collect()
    owners = sorted({r["owner"] for r in got})
    assert len(owners) == 4 and {(r["owner"], r["relabelled"]) for r in got} == set(zip(owners, range(4)))
    assert {r["i"] for r in got} == {i for i in range(90) if i % 10 and f"o{i % 9}" in owners}
    assert selection.owner_subset(rows, "owner", 50).count() == 81 and selection.owner_subset(rows.limit(0), "owner", 3).count() == 0


def test_prominent_peaks_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [(float(f), float(b)) for f, b in zip(rng.integers(0, 40, 9) * 50, rng.integers(1, 6, 9))] + [(None, 1.0), (100.0, None)]) for i in range(30)] + [(98, []), (99, None)]
    df = spark.createDataFrame(rows, "i int, p array<struct<frequency: double, bandwidth: double>>")
    got = {r["i"]: r["x"] for r in df.select("i", selection.prominent(F.col("p"), 3, 180.0).alias("x")).collect()}
    for i, peaks in rows[:-1]:
        taken = []
        for b, f in sorted((b, f) for f, b in peaks if f is not None and b is not None):
            if len(taken) < 3 and all(abs(f - g) >= 180 for g, _ in taken):
                taken.append((f, b))
        assert [tuple(x) for x in got[i]] == sorted(taken)
    assert got[99] is None


def test_recordings_of_incidents(spark):
    df = spark.createDataFrame([("op-1-7", ["a", "b", "c"]), ("op-1-9", ["a", "b", "c"]), ("x", ["a"]), ("op-3", [])], "i string, r array<string>")
    assert [r["x"] for r in df.select(selection.recording_of(F.col("i"), F.col("r")).alias("x")).collect()] == ["b", "a", None, None]
    assert tuple(selection.modes(df.select(F.lit("m").alias("m")), "m", "m").first()) == (["m"], True, True)
    assert tuple(selection.modes(df.select(F.col("i").alias("m")).limit(0), "m", "m").first()) == ([], False, False)
