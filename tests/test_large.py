"""Steps that must not gather a table in one task, nor work through a table again and again."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import copula, fusion, metrics, ordered, plda


def counting(rows):
    """rows, and an accumulator of how many were made."""
    made = rows.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), made


def test_trials_of_an_eer_are_scored_once(spark):
    trials = spark.range(500).select((F.col("id") % 97).cast("double").alias("score"), (F.col("id") % 3 % 2).cast("int").alias("label"))
    rows, made = counting(trials)
    assert metrics.eer(metrics.histogram(rows)).collect() and made.value == 500


@pytest.mark.parametrize("nested", [255, 0])
def test_edges_below_are_counted(spark, monkeypatch, nested):
    monkeypatch.setattr(ordered, "NESTED", nested)
    edges = [-2.0, 0.0, 0.5, 3.0, 7.0]
    values = [-9.0, -2.0, -1.0, 0.0, 0.5, 0.6, 3.0, 6.9, 7.0, 8.0, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r["n"] for r in rows.select(ordered.below("x", edges).alias("n")).collect()]
    assert got == [5 if math.isnan(v) else sum(e < v for e in edges) for v in values] + [0]


def test_a_round_inverts_one_matrix(spark, monkeypatch):
    """Whatever the number of different numbers of recordings."""
    rng = np.random.default_rng(2)
    rows = [(s, (rng.normal(size=3) * 2 + rng.normal(size=3)).tolist()) for s in range(24) for _ in range(s + 1)]
    s = plda.statistics(spark.createDataFrame(rows, "speaker int, v array<double>"), "speaker", "v", 3)
    calls, inv = [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda m: calls.append(1) or inv(m))
    model = plda.fit(s, rounds=5)
    assert len(s.by_count) == 24 and len(model.trace) == 6 and len(calls) <= 6


@pytest.mark.parametrize(("parts", "held"), [(16_384, 100_000), (16_384, 5), (3, 5), (2, 0)])
def test_quantiles_are_those_of_sorted_values(spark, monkeypatch, parts, held):
    monkeypatch.setattr(ordered, "PARTS", parts)
    monkeypatch.setattr(ordered, "COLLECTED", held)
    rng = np.random.default_rng(4)
    values = {0: rng.normal(size=120).tolist() + [0.25] * 40 + [1e300, -1e300, None], 1: [math.inf, -math.inf, *rng.normal(size=30).tolist(), math.nan], 2: [3.0], 3: [1.0, 2.0], None: [5.0] * 9, 4: [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "label int, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = ordered.quantiles(rows, F.col("v"), shares, "label")
    want = {r["label"]: r["q"] for r in rows.groupBy("label").agg(F.percentile("v", F.array(*[F.lit(q) for q in shares])).alias("q")).collect() if r["q"] is not None}
    assert set(got) == set(want) == {0, 1, 2, 3, None}
    for k in want:
        assert [str(x) if math.isnan(x) else x for x in got[k]] == [str(x) if math.isnan(x) else x for x in want[k]]
    assert ordered.quantiles(rows.where("label = 4"), F.col("v"), shares) == {}


def test_no_task_gathers_all_values_for_a_quantile(spark):
    m = spark.range(400).select((F.col("id") % 7 % 2).cast("int").alias("label"), F.sin(F.col("id").cast("double")).alias("naive")).withColumn("corrected", 0.7 * F.col("naive"))
    rows = m.select("label", F.col("naive").alias("score"))
    for df in (fusion.overstatement(m, "corrected", "naive"), metrics.silverman(rows)):
        assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
    empty = fusion.overstatement(m.where("label > 5"), "corrected", "naive").first()
    assert empty["n"] == 0 and empty["median_log10"] is None


def test_ranges_of_kendalls_tau_grow_with_the_rows(spark, monkeypatch):
    """No range holds many more rows than it should; tau is that of all pairs."""
    monkeypatch.setattr(copula, "RANGES", 2)
    monkeypatch.setattr(copula, "RANGE_ROWS", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = np.round(x + rng.normal(size=300), 1)
    m = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "label int, x double, y double")
    sizes = copula._ranged(m, ("x", "y"), [(0, 1)], [sorted(q) for q in m.approxQuantile(["x", "y"], [i / 15 for i in range(1, 15)], 0.01)])
    assert sizes.where("xr % 2 = 0").groupBy("label", "xr").count().agg(F.max("count")).first()[0] <= 40
    plans = copula.kendall(m, ("x", "y"))
    assert "lambda" not in plans._jdf.queryExecution().optimizedPlan().toString()
    for r in plans.collect():
        u, v = (c[r["label"] :: 2] for c in (x, y))
        i, j = np.triu_indices(len(u), 1)
        a, b = np.sign(u[i] - u[j]), np.sign(v[i] - v[j])
        assert r["n"] == 150 and r["tau"] == pytest.approx((a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum()), abs=1e-12)


def test_normal_scores_need_no_density(spark, monkeypatch, sf_dir):
    """Ranks are read off one histogram of the trials."""
    from attestra.operators import kernel
    from attestra.plans import fusing

    built, comparisons = [], fusing.comparisons
    monkeypatch.setattr(fusing, "comparisons", lambda *a: built.append(counting(comparisons(*a))) or built[-1][0])
    monkeypatch.setattr(kernel, "density", None)
    rows = fusing.normal_scores(spark, sf_dir).collect()
    assert rows and len(built) == 1 and built[0][1].value == comparisons(spark, sf_dir).count()


def test_no_trial_of_the_four_cells_is_written(spark, sf_dir):
    """What is stored is counts by score and owner: fewer rows than trials and cells, all trials in them."""
    from attestra.plans import contrasts

    hist, trials = contrasts.four_cell_counts(spark, sf_dir), contrasts.four_cells(spark, sf_dir).count()
    got = hist.groupBy("cell").agg(F.sum(F.col("n_same") + F.col("n_different")).alias("n")).collect()
    assert {r["cell"]: r["n"] for r in got} == {c: trials for c in contrasts.CELLS} and hist.count() < 4 * trials


def test_communities_send_labels_to_edges_and_hash_a_draw_once(spark, monkeypatch):
    """Edges are not shuffled in a round where labels are few; the communities are those of the shuffling way, and of blocks of resamples."""
    from attestra.operators import graph

    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), round(float(w), 3), round(float(w), 3) - 1, round(float(w), 3) + 1.5) for a, b, w in zip(rng.integers(0, 12, 150), rng.integers(12, 60, 150), rng.normal(2.0, 0.8, 150))]
    edges = spark.createDataFrame(rows, "src long, dst long, log_lr double, lower double, upper double")
    written, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    found = lambda: (sorted(map(tuple, graph.communities(edges, 1.5).collect())), sorted((*r[:2], round(r[2], 9)) for r in graph.stability(edges, 1.5, 6).select("community", "n_members", "stability").collect()))
    few = found()
    rounds = [plan for name, plan in written if name == "labels" and "max_by" in plan]
    assert rounds and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in rounds)
    monkeypatch.setattr(graph, "LABELS", 130)  # two resamples at once
    assert found() == few
    monkeypatch.setattr(graph, "LABELS", 3)
    assert found() == few
    draws = graph.redrawn(edges, 4, 1, 1.5)
    assert draws._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    every = {tuple(r)[:3]: r["log_lr"] for r in graph.redrawn(edges.distinct(), 4).collect() if r["log_lr"] >= 1.5}
    assert {tuple(r)[:3]: r["log_lr"] for r in graph.redrawn(edges.distinct(), 4, 1, 1.5).collect()} == every


def test_subsets_are_evaluated_in_arrays(spark):
    """No column expression for each subset and pattern; the costs are those of the fused columns."""
    from attestra.functions.likelihood import cost
    from attestra.operators import latent

    rng = np.random.default_rng(8)
    rows = [(i % 2 if i % 29 else None, *[float(x) if rng.random() < 0.7 else None for x in rng.normal(i % 2, 1.5, 3)]) for i in range(400)]
    m = spark.createDataFrame(rows, "label int, a double, b double, c double")
    out = latent.ablation(m, m, ("a", "b", "c"))
    assert "mapinarrow" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["subset"]: r for r in out.collect()}
    assert len(got) == 7
    for names, model in latent.fit_subsets(m, ("a", "b", "c")).items():
        x = m.select("label", model.fused().alias("x"), fusion.naive(names).alias("y")).where("x is not null")
        half = lambda c, k: F.avg(F.when(F.col("label") == k, cost(F.col(c), F.col("label"))))
        want = x.agg(F.count("*"), 0.5 * (half("x", 1) + half("x", 0)), 0.5 * (half("y", 1) + half("y", 0))).first()
        assert tuple(got["+".join(names)])[2:] == pytest.approx(tuple(want), abs=1e-10)


def test_no_comparison_is_written_before_the_result(spark, sf_dir, monkeypatch):
    from attestra.plans import comparison

    monkeypatch.setattr(comparison, "stored", None)
    assert comparison.incident_comparisons(spark, sf_dir).count() == comparison.comparisons(spark, sf_dir).count()
