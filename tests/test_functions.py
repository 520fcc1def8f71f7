from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.functions import likelihood as lk
from attestra.functions import text as t
from attestra.operators import fusion, governance, graph, metrics, pairs, profiles, resample, sampling, sequence
from attestra.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_lgamma(spark):
    xs = [1e-4, 0.3, 1.0, 2.5, 7.0, 40.25, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(lk.lgamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


def test_extreme_scores_are_finite(spark):
    rows = spark.createDataFrame([(900.0, 1), (-900.0, 1), (900.0, 0), (-900.0, 0)], "score double, label int")
    assert math.isfinite(metrics.cllr(rows).first()["cllr"])
    zero = spark.createDataFrame([(0.0, 1), (0.0, 0)], "score double, label int")
    assert metrics.cllr(zero).first()["cllr"] == 1.0
    assert metrics.cllr(zero.where("label = 1")).first()["cllr"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)).filter(lambda x: sum(x) > 0), min_size=1, max_size=30))
def test_pool_is_isotonic_and_keeps_the_mean(groups):
    s, n = np.array([a for a, _ in groups], float), np.array([a + b for a, b in groups], float)
    block, value = metrics.pool(s, n)
    assert (np.diff(value) > 0).all() or len(value) == 1
    assert math.isclose(float((value[block] * n).sum()), float(s.sum()), abs_tol=1e-9)


def test_ties_are_pooled_whatever_their_order(spark):
    rows = [(1.0, 0), (1.0, 1), (0.0, 0), (2.0, 1)]
    out = set()
    for _ in range(3):
        random.shuffle(rows)
        h = metrics.histogram(spark.createDataFrame(rows, "score double, label int")).withColumn("g", F.lit(1))
        out.add(round(metrics.cllr_min(metrics.pav(h, ("g",)), ("g",)).first()["cllr_min"], 9))
    assert len(out) == 1


def test_logistic_fit_lowers_the_cost(spark):
    rng = np.random.default_rng(5)
    data = [(float(x), 1) for x in rng.normal(3, 2, 300)] + [(float(x), 0) for x in rng.normal(-1, 2, 300)]
    rows = spark.createDataFrame(data, "score double, label int")
    slope, shift = metrics.fit_logistic(rows)
    assert slope > 0
    after = metrics.cllr(rows.withColumn("score", F.col("score") * slope + shift)).first()["cllr"]
    assert after < metrics.cllr(rows).first()["cllr"]


def test_bootstrap_covers_the_point(spark):
    rng = np.random.default_rng(2)
    data = [(float(rng.normal(2 if k % 4 == 0 else -2, 1)), int(k % 4 == 0), f"s{k % 12}") for k in range(480)]
    data += [(float(rng.normal(2, 1)), 1, f"s{k % 12}") for k in range(60)]
    out = resample.bootstrap_cllr(spark.createDataFrame(data, "score double, label int, owner string"), 200, 1)
    assert out["lower"] <= out["value"] <= out["upper"]


def test_shared_rare_category_says_more(spark):
    counts = spark.createDataFrame([(0, "busy", 3), (1, "busy", 3), (50, "rare", 3), (2, "rare", 3), (3, "new", 1)], "entity long, category string, n long")
    background = spark.createDataFrame([("busy", 0.9), ("rare", 0.1)], "category string, frequency double")
    table = pairs.probe_pairs(pairs.with_weights(counts, background, 5.0, "k")).select(*pairs.sides(), pairs.multinomial("k", 5.0).alias("x"))
    x = {(r["a"], r["b"]): r["x"] for r in table.collect()}
    assert x[50, 2] > x[0, 1] > 0 > x[0, 2]
    assert x[0, 3] is not None and len(x) == 7


def test_marginals_merge(spark):
    a, b = [1.0, 2.0, 4.0], [2.5, 3.5]
    m = lambda v: (F.lit(float(len(v))), F.lit(float(np.mean(v))), F.lit(float(np.var(v) * len(v))))
    n, mean, m2 = (spark.range(1).select(c).first()[0] for c in lk.merged_moments(m(a), m(b)))
    assert (n, round(mean, 12), round(m2, 12)) == (5, round(float(np.mean(a + b)), 12), round(float(np.var(a + b) * 5), 12))


def test_bands(spark):
    for x, want in ((0.0, "no_support"), (-0.5, "weak"), (1.0, "moderate"), (2.5, "moderately_strong"), (-3.0, "strong"), (4.0, "very_strong"), (6.0, "extremely_strong")):
        assert one(spark, lk.band(F.col("x")), x=x) == want


def test_cues_overlap_and_match_inside_words(spark):
    got = one(spark, t.moves(F.lit("Shopping before BEFORE the PIN")), x=1)
    assert [(m["pos"], m["label"]) for m in got] == [(4, "credential_request"), (9, "urgency"), (16, "urgency"), (27, "credential_request")]
    assert one(spark, t.occurrences(F.lit("aaaa"), "aa"), x=1) == [0, 1, 2]


def test_lcs(spark):
    def plain(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
            prev = row
        return prev[-1]

    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(t.lcs(F.col("a"), F.col("b"))).collect()]
    assert got == [plain(a, b) for a, b in rows]


def test_phrase_policy(spark):
    text = "A dispatch of voice \n print, re-match; it Matches. Positively  identified"
    assert one(spark, t.violations(F.col("x")), x=text) == ["voice \n print", "Matches", "Positively  identified"]


def test_chain_names_the_first_broken_entry(spark):
    log = governance.chained(spark, [governance.canonical({"n": i, "a": "é"}) for i in range(6)], "g")
    assert governance.verify_chain(log, "g").first().asDict() == {"is_intact": True, "n_entries": 6, "first_broken": None}
    bad = log.withColumn("body", F.when(F.col("sequence") == 4, "{}").otherwise(F.col("body")))
    assert governance.verify_chain(bad, "g").first()["first_broken"] == 4
    assert governance.verify_chain(log.where("sequence <> 3"), "g").first()["first_broken"] == 4
    assert governance.verify_chain(log.where("sequence < 1"), "g").first()["is_intact"]


def test_absent_is_not_neutral(spark):
    rows = spark.createDataFrame([("c1", "acoustic", 1.0, 1), ("c1", "device", -2.0, 1), ("c2", "temporal", 0.0, 0)], "cmp_id string, stream string, log_lr double, label int")
    m = {r["cmp_id"]: r for r in fusion.wide(rows).collect()}
    assert m["c1"]["temporal"] is None and m["c1"]["pattern"] == 17 and m["c2"]["pattern"] == 4


def test_linear_fusion_weights_are_not_negative(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(y * 2 - 1, 1)), float(rng.normal(1 - y * 2, 1)), int(y)) for y in rng.integers(0, 2, 300)]
    w, _ = fusion.fit_linear(spark.createDataFrame(rows, "acoustic double, device double, label int"), ("acoustic", "device"), 40)
    assert w[0] > 0 and w[1] == 0


def test_communities(spark):
    e = [(1, 2), (2, 3), (1, 3), (7, 8), (8, 9), (7, 9), (3, 20)]
    rows = [(a, b, 5.0 if b != 20 else 1.0, 4.0, 6.0, ["x"]) for a, b in e]
    got = graph.communities(spark.createDataFrame(rows, "src long, dst long, log_lr double, lower double, upper double, streams array<string>"))
    assert {r["node"]: r["community"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_paths_are_simple_and_stop_at_their_target(spark):
    e = [(1, 2), (2, 3), (3, 4), (1, 4), (2, 4)]
    rows = [(a, b, 1.0, 0.0, 2.0, ["x"]) for a, b in e]
    edges = spark.createDataFrame(rows, "src long, dst long, log_lr double, lower double, upper double, streams array<string>")
    got = graph.paths(edges, spark.createDataFrame([(1,)], "source long"), spark.createDataFrame([(4,)], "target long"))
    assert sorted(r["nodes"] for r in got.collect()) == [[1, 2, 3, 4], [1, 2, 4], [1, 4]]


def test_hash_and_greedy_splits_keep_keys_together(spark):
    rows = spark.range(500).select((F.col("id") % 17).alias("k"))
    for split in (sampling.partitioned(rows, "k", {"a": 0.7, "b": 0.3}), sampling.hashed(rows, "k", {"a": 0.7, "b": 0.3})):
        assert split.count() == 500
        assert sampling.disjoint(split.where("split = 'a'"), split.where("split = 'b'"), "k").isEmpty()


def test_sliding_is_plain_normalisation_with_edges_repeated(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    got = sequence.sliding(spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "p int, i int, x double"), "p", "i", "x", 4).orderBy("i").collect()
    for i, r in enumerate(got):
        w = np.array([v[min(max(j, 0), 6)] for j in range(i - 2, i + 3)])
        assert math.isclose(r["normalised"], (v[i] - w.mean()) / w.std(), abs_tol=1e-9)


def test_background_of_nothing(spark):
    empty = spark.createDataFrame([], "entity long, category string, n long")
    assert profiles.background(empty).count() == 0


@pytest.mark.parametrize("start", [1, 3])
def test_streamed_audit_carries_the_last_hash(spark, tmp_path, start):
    log = governance.chained(spark, [f"entry {k}" for k in range(12)], "g").where(f"sequence >= {start}")
    (tmp_path / "in").mkdir()
    cuts = [(start, 5), (6, 6), (7, 9), (10, 12)]

    def run(last_body: str | None = None):
        for k, (a, b) in enumerate(cuts):
            part = log.where(f"sequence between {a} and {b}")
            if last_body is not None and b == 12:
                part = part.withColumn("body", F.when(F.col("sequence") == 11, last_body).otherwise(F.col("body")))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
            events.checked_audit(stream, "g", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [(r["is_intact"], r["n_entries"], r["first_broken"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()]

    assert run("forged") == [(True, 6 - start, None), (True, 1, None), (True, 3, None), (False, 1, 11)]


def test_p_value_agrees_with_the_interval():
    rng = np.random.default_rng(4)
    settled = 0
    for shift in np.linspace(0, 1, 40):
        x = rng.exponential(size=60) - 1 + shift
        replicates = rng.choice(x, (4000, 60)).mean(axis=1)
        jackknife = (x.sum() - x) / 59
        lo, hi, how = resample.bca(x.mean(), replicates, jackknife)
        p = resample.bca_p_value(x.mean(), replicates, jackknife)
        assert how == "bca" and 0 < p <= 1
        if abs(p - 0.05) > 0.005:
            assert (p < 0.05) == (lo > 0 or hi < 0)
            settled += p < 0.05
    assert 5 < settled < 40
    same = np.ones(10)
    assert resample.bca_p_value(1.0, same, same) == 0.2
