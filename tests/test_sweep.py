"""Many cells at once against one at a time; finished cells are not computed again; interpolation in ranges."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import hypotheses, metrics, order_resample, sweep


def trials(cells=("a", "b"), n: int = 320, seed: int = 0):
    """(cell, split, owner, label, score): cells that see the labels better and worse."""
    rng = np.random.default_rng(seed)
    out = []
    for c, cell in enumerate(cells):
        for i in range(n):
            label = int(rng.random() < 0.4)
            out.append((cell, ("development", "evaluation")[i % 2], f"o{int(rng.integers(0, 9))}", label, float(round(rng.normal() * (1 + c) + 2 * label + 5 * c, 2))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell string, split string, owner string, label int, score double").repartition(3)


def of(rows, cell, split):
    return [(r[4], r[3], r[2]) for r in rows if r[0] == cell and r[1] == split]


def cllr(x, y):
    halves = [np.mean(np.log2(1 + np.exp(np.where(y[y == k] == 1, -1, 1) * x[y == k]))) for k in (0, 1)]
    return 0.5 * sum(halves)


def test_logistic_fits_of_all_cells_are_those_of_each(spark):
    rows = trials(("a", "b", "c"))
    hist = metrics.histogram(frame(spark, rows).where("split = 'development'"), ("cell",))
    got = sweep.fit_logistic(hist)
    for cell in "abc":
        own = spark.createDataFrame([r[:2] for r in of(rows, cell, "development")], "score double, label int")
        assert got[cell] == pytest.approx(metrics.fit_logistic(own), rel=1e-5)
        # the gradient is zero there
        x, y = (np.array(v, float) for v in list(zip(*of(rows, cell, "development")))[:2])
        p = 1 / (1 + np.exp(-(got[cell][0] * x + got[cell][1])))
        w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        assert abs((w * (p - y)).sum()) < 1e-6 and abs((w * (p - y) * x).sum()) < 1e-5


@pytest.mark.parametrize("by", [(), ("cell",)])
def test_interpolation_is_that_of_sorted_knots(spark, by):
    rng = np.random.default_rng(2)
    knots = {c: sorted({round(float(v), 1) for v in rng.normal(size=9)}) for c in "ab"}
    values = {c: np.cumsum(rng.random(len(k))) for c, k in knots.items()}
    cells = "ab" if by else "a"
    at = spark.createDataFrame([(c, x, float(y)) for c in cells for x, y in zip(knots[c], values[c])], "cell string, score double, log_lr double")
    q = [(c, float(v), i) for c in cells for i, v in enumerate(np.r_[rng.normal(size=150) * 2, knots[c], -50, 50])]
    rows = spark.createDataFrame(q, "cell string, score double, i int").repartition(3)
    got = {(r["cell"], r["i"]): r["log_lr"] for r in metrics.interpolated(rows, at if by else at.drop("cell"), by).collect()}
    assert len(got) == len(q) and all(got[c, i] == pytest.approx(np.interp(v, knots[c], values[c])) for c, v, i in q)
    assert metrics.interpolated(rows.limit(0), at if by else at.drop("cell"), by).count() == 0


def test_no_window_shrinks_as_it_goes(spark):
    """A frame from a row to the end of its range is read anew for every row: time goes by rows squared."""
    rows, at = (spark.createDataFrame([(0.5, 1.0)], f"score double, {c} double") for c in ("x", "log_lr"))
    plan = metrics.interpolated(rows, at)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and "RangeFrame, currentrow$(), unboundedfollowing$()" not in plan


def test_trials_are_counted_before_a_sweep(spark, monkeypatch):
    """A trial that comes a thousand times is one row of all that follows, and counts a thousand times."""
    seen, rows, plain = [], trials(), sweep.calibrated
    monkeypatch.setattr(sweep, "calibrated", lambda r: seen.append(r.count()) or plain(r))
    once = frame(spark, rows)
    many = once.crossJoin(spark.range(1000)).drop("id")
    got = [{(r["cell"], r["calibrator"]): r for r in sweep.evaluate(x, 60, 1).collect()} for x in (once, many)]
    assert seen[0] == seen[1] <= len(rows)
    for key, r in got[0].items():
        assert got[1][key]["n_same"] == 1000 * r["n_same"] and got[1][key]["cllr_min"] == pytest.approx(r["cllr_min"])
        if key[1] == "isotonic":
            assert got[1][key]["cllr_min_upper"] == pytest.approx(r["cllr_min_upper"])


def test_cells_are_costed_like_one_at_a_time(spark):
    rows = trials() + [("thin", "development", "o1", 1, 1.0), ("thin", "evaluation", "o1", 0, 0.0), ("a", "evaluation", None, 1, 3.0), ("a", "evaluation", "o1", 1, None)]
    got = {(r["cell"], r["calibrator"]): r for r in sweep.evaluate(frame(spark, rows), 200, 1).collect()}
    assert set(got) == {(c, k) for c in "ab" for k in sweep.CALIBRATORS} | {("thin", None)}
    assert not got["thin", None]["evaluable"] and got["thin", None]["cllr"] is None
    for cell in "ab":
        dev, test = of(rows, cell, "development"), [r for r in of(rows, cell, "evaluation") if r[0] is not None and r[2] is not None]
        d = spark.createDataFrame([r[:2] for r in dev], "score double, label int")
        x, y = np.array([r[0] for r in test]), np.array([r[1] for r in test])
        slope, shift = metrics.fit_logistic(d)
        hist = metrics.histogram(d)
        k = metrics.knots(metrics.pav(hist)).orderBy("score").toPandas()
        ratios = {r["score"]: r["log_ratio"] for r in metrics.kde_log_ratio(spark.createDataFrame([(float(v),) for v in set(x)], "score double"), hist, metrics.silverman(d)).collect()}
        plain = {"logistic": slope * x + shift, "isotonic": np.interp(x, k["score"], k["log_lr"]), "kernel_density": np.array([ratios[v] for v in x])}
        low = metrics.elub(hist.withColumn("score", slope * F.col("score") + shift)).first()
        for name, v in plain.items():
            r = got[cell, name]
            assert r["cllr_unbounded"] == pytest.approx(cllr(v, y), rel=1e-5), name
            assert r["cllr_lower"] <= r["cllr"] <= r["cllr_upper"] and r["n_same"] == (y == 1).sum()
            assert r["calibration_loss"] == pytest.approx(r["cllr"] - r["cllr_min"]) and r["cllr_min_lower"] <= r["cllr_min_upper"]
        r = got[cell, "logistic"]
        bounded = np.clip(plain["logistic"], *low)
        assert r["cllr"] == pytest.approx(cllr(bounded, y), rel=1e-5) and r["clipped"] == pytest.approx(np.mean(bounded != plain["logistic"]))
        assert (r["lower_log10"], r["upper_log10"]) == pytest.approx((low[0] / math.log(10), low[1] / math.log(10)))
    assert sweep.evaluate(frame(spark, []), 10).count() == 0


def test_finished_cells_are_kept(spark, tmp_path, monkeypatch):
    rows, path = frame(spark, trials(("a", "b", "c"), 200)), str(tmp_path / "cells")
    first = sweep.run(rows.where("cell <> 'c'"), path, 60, 1, at_once=1)
    before = {r["cell"]: r for r in first.where("calibrator = 'isotonic'").collect()}
    assert set(before) == {"a", "b"}
    files = set(os.listdir(path))
    assert sweep.run(rows.where("cell <> 'c'"), path, 60, 1).count() == 6 and len([f for f in set(os.listdir(path)) - files if f.startswith("part")]) <= 1  # the empty one
    asked = []
    plain = sweep.evaluate
    monkeypatch.setattr(sweep, "evaluate", lambda r, *a: asked.append({x["cell"] for x in r.select("cell").distinct().collect()}) or plain(r, *a))
    after = sweep.run(rows, path, 60, 1)
    assert asked == [{"c"}] and after.count() == 9 and {r["cell"]: r for r in after.where("calibrator = 'isotonic' and cell <> 'c'").collect()} == before
    one = sweep.overall(after).first()
    assert one["n_cells"] == 3 == one["n_supported"] + one["n_falsified"] + one["n_inconclusive"] and one["best_cllr_min"] <= one["worst_cllr_min"]


# -- hypotheses


def test_hypotheses_are_decided_by_their_rules(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        label, base = int(rng.random() < 0.4), rng.normal()
        sees = lambda d: float(round((base + d * label - d / 2) * 1.5, 2))
        rows.append((f"o{int(rng.integers(0, 15))}", label, sees(5.0), sees(5.0), sees(1.0), float(round(rng.normal(), 2)), None if rng.random() < 0.1 else sees(0.5), sees(9.0)))
    df = spark.createDataFrame(rows, "owner string, label int, good double, twin double, poor double, none double, thin double, best double").persist()
    v = order_resample.replicates(df, ("good", "twin", "poor", "none"), n=120, seed=2)
    assert [hypotheses.channel_viability(v, c, 120).verdict for c in ("good", "none")] == ["supported", "falsified"]
    apart = hypotheses.disguise_resistance(v, ["good", "none"], ["poor"], 120)
    each = {c: order_resample.estimate(v, {c: 1.0}, "cllr_min", 120) for c in ("good", "twin", "poor", "none")}
    assert (apart.value, apart.lower, apart.upper) == pytest.approx((each["poor"]["value"] - each["good"]["value"], each["poor"]["lower"] - each["good"]["upper"], each["poor"]["upper"] - each["good"]["lower"]))
    assert apart.verdict == "supported" and hypotheses.disguise_resistance(v, ["good"], ["twin"], 120).verdict == "falsified"
    assert [hypotheses.disguise_decay(v, *c, 120).verdict for c in (("poor", "good"), ("good", "poor"), ("good", "twin"))] == ["supported", "falsified", "inconclusive"]
    assert [hypotheses.cross_lingual_penalty(v, *c, 120).verdict for c in (("good", "poor"), ("poor", "good"))] == ["supported", "falsified"]
    better = hypotheses.fusion_superiority(df, ["poor", "thin"], "best", "none", 120)
    assert better.verdict == "supported" and better.detail["margin_over_naive"] > 0.02 and hypotheses.fusion_superiority(df, ["best"], "none", "poor", 120).verdict == "falsified"
    assert hypotheses.fusion_superiority(df, ["poor"], "best", "best", 120).verdict == "inconclusive"
    x, y = (np.array([r[k] for r in rows if r[6] is not None], float) for k in (6, 1))
    assert better.detail["thin"] == pytest.approx(cllr(x, y))
    assert [hypotheses.synthetic_gating(df, c, ["a"], 120).verdict for c in ("best", "none")] == ["supported", "falsified"]
    for bad in (lambda: hypotheses.synthetic_gating(df, "best", [], 9), lambda: hypotheses.disguise_resistance(v, [], ["poor"], 9), lambda: hypotheses.fusion_superiority(df.where("label = 1"), ["poor"], "best", "none", 40)):
        with pytest.raises(hypotheses.NothingToCompare):
            bad()
    with pytest.raises(ValueError):
        hypotheses.Outcome("x", 0.0, 0.0, 0.0, True, True, "")
    assert hypotheses.table(spark, [better]).first()["verdict"] == "supported"
