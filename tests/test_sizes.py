"""Rows that only larger tables have: ties of a rounding, many copies, classes that meet."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.functions.likelihood import dot, plda, plda_sides
from attestra.operators import fusion, pair_arrays, profiles, trials
from attestra.plans.linkage import USED, comparisons
from attestra.queries import QUERIES, SQL

from .test_large import counting


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over small tables written to ``folder``."""
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t, frame in tables.items():
        frame.to_parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    rows = lambda found: sorted(tuple(r) for r in found)
    return rows(df.collect()), rows(con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall())


def test_half_hundredths_of_a_rate_are_rounded_alike(spark, tmp_path):
    values = [95.3, 94.7, 95.0, 94.9, 95.1, 94.8, 118.3, 147.9, 203.9, 244.3, None]
    events = pd.DataFrame({"event_id": range(len(values)), "value": values})
    got, want = both(spark, tmp_path, "nearest_mode", events=events)
    assert got == want and (0, 4.75) not in got and (1, 4.75) in got


def test_halves_of_the_last_place_are_rounded_alike(spark, tmp_path):
    """99 hundredths of 53 / 16,000 lie on a half of the eighth place, which doubles miss."""
    line = pd.DataFrame({"l_suppkey": [0] * 53 + list(range(1, 15_948)), "l_partkey": 1, "l_orderkey": [i % 53 for i in range(16_000)]})
    order = pd.DataFrame({"o_orderkey": range(53), "o_custkey": range(100, 153)})
    got, want = both(spark, tmp_path, "rarest_shared_agent", orders=order, lineitem=line)
    assert len(line) == 16_000 and len(got) == 103 and got == want and {r[3] for r in got} == {0.00327938}


@pytest.fixture(scope="module")
def odd_recordings(spark):
    """Equal, zero, short, empty and missing vectors, a missing component, and recordings without a speaker."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3 if i % 7 else None, i % 4, [float(x) for x in rng.normal(size=5)]) for i in range(1, 160)]
    for i, v in ((50, None), (3, None), (4, [0.0] * 5), (5, [1.0, 2.0]), (6, []), (7, [1.0, None, 0.0, 0.0, 0.0]), (100, [1.0] * 5), (8, [1.0] * 5)):
        rows[i - 1] = (*rows[i - 1][:3], v)
    return spark.createDataFrame(rows, "vec_id long, speaker int, session long, unit array<double>")


@pytest.mark.parametrize("blocks", [2_000, 1])
def test_trials_are_those_of_the_pairs(spark, odd_recordings, monkeypatch, blocks):
    monkeypatch.setattr(trials, "PROBES", blocks)
    monkeypatch.setattr(trials, "TRIALS", 7)
    psi = [2.0, 1.0, 0.5, 0.25, 0.125]
    whole = F.struct(*odd_recordings.columns)
    p, q = odd_recordings.select(whole.alias("p")).where("p.vec_id % 50 = 0"), odd_recordings.select(whole.alias("q"))
    pairs = p.crossJoin(q).where("p.vec_id <> q.vec_id and (q.vec_id % 50 <> 0 or p.vec_id < q.vec_id)").where(~((F.col("p.speaker") == F.col("q.speaker")) & (F.col("p.session") == F.col("q.session"))))
    x, y = F.col("p.unit"), F.col("q.unit")
    scores = F.when(F.size(x) == F.size(y), dot(x, y)), F.when((F.size(x) == 5) & (F.size(y) == 5), plda(x, y, F.array(*[F.lit(v) for v in psi])))
    want = {(r[0], r[1]): r[2:] for r in pairs.select("p.vec_id", "q.vec_id", (F.col("p.speaker") == F.col("q.speaker")).cast("int"), *scores).collect()}
    got = trials.build(odd_recordings, [(F.col("unit"), F.col("unit")), plda_sides(F.col("unit"), psi)]).collect()
    assert len(got) == len(want) > 300
    for r in got:
        label, *values = want[r["a"], r["b"]]
        assert r["label"] == label and r["score"] == pytest.approx(values, abs=1e-12)


def test_comparisons_move_vectors_and_no_trials(spark, sf_dir):
    """One exchange of the vectors, none by comparison; the rows are those that grouping the streams gave."""
    m = comparisons(spark, sf_dir)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vec_id") == plan.count("Exchange ") and "cmp_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    long = m.select("cmp_id", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("log_lr")) for s in USED])).alias("o")).select("cmp_id", "label", "o.*").where("log_lr is not null")
    rows = lambda df: sorted(map(tuple, df.select("cmp_id", "label", *fusion.STREAMS, "pattern").collect()))
    assert rows(fusion.wide(long)) == rows(m)


@pytest.mark.parametrize("held", [250_000, 7])
def test_leaders_of_tasks_hold_the_best_of_all_pairs(spark, monkeypatch, held):
    """The best of the leaders are the best of all pairs, ties in the order of ids; tasks return no row for every pair."""
    counted = spark.range(400).select((F.col("id") % 200).alias("entity"), (F.col("id") * 7 % 11 % 5).cast("string").alias("category"), (F.col("id") % 3 + 1).alias("n")).groupBy("entity", "category").agg(F.sum("n").alias("n"))
    moments = spark.range(190).select(F.col("id").alias("entity"), (F.col("id") % 4 + 1).alias("n"), (F.col("id") % 6).cast("double").alias("mean"), F.lit(0.5).alias("m2"))
    counts = {"kind": pair_arrays.Counts(counted, profiles.background(counted), 20.0)}
    values = {"v": pair_arrays.Values(moments, spark.createDataFrame([(2.0, 0.7, 2.5, 1.5)], "mean double, precision double, shape double, scale double"))}
    score = (F.col("v") + F.coalesce("kind", F.lit(0.0))).alias("x")
    all_ = pair_arrays.scored(spark.range(200).select(F.col("id").alias("entity")), counts, values).select("p.entity", "q.entity", score).where("x is not null").collect()
    monkeypatch.setattr(pair_arrays, "PAIRS", held)
    some = pair_arrays.scored(spark.range(200).select(F.col("id").alias("entity")), counts, values, best=pair_arrays.Best(3, ("v",))).select("p.entity", "q.entity", score).collect()
    ways = [tuple(r) for r in all_] + [(b, a, x) for a, b, x in all_ if b % 50 == 0]
    top = lambda rows: {p: [b for _, b in sorted((-round(x, 9), b) for a, b, x in rows if a == p)[:3]] for p in {r[0] for r in rows}}
    assert top([tuple(r) for r in some]) == top(ways) and len(top(ways)) == 4 and len(some) < len(ways)


@pytest.mark.parametrize("name", ["dm_llr_pairs", "nig_llr_pairs"])
def test_count_and_moment_pairs_are_scored_by_arrays_in_all_tasks(spark, tmp_path, name):
    """No join by pair; the population keeps its partitions where shuffles have as many. One order alone has no pair."""
    order = pd.DataFrame({"o_orderkey": range(900), "o_custkey": [i * 7 % 211 for i in range(900)], "o_orderpriority": [f"{i * i % 5}" for i in range(900)], "o_totalprice": [(i * 37 % 101) + 0.5 for i in range(900)]})
    got, want = both(spark, tmp_path, name, orders=order)
    assert len(got) == len(want) > 600 and [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-5)
    held, tasks = spark.conf.get("spark.sql.shuffle.partitions"), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = QUERIES[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == tasks
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    (tmp_path / "one").mkdir()
    assert both(spark, tmp_path / "one", name, orders=order.assign(o_custkey=50)[:1]) == ([], [])


def test_a_draw_of_a_path_is_hashed_once(spark, sf_dir):
    """Inside lambdas nothing is shared: what a path or a draw has once stands once in the plan. Paths keep their tasks."""
    df = QUERIES["path_monte_carlo"](spark, sf_dir)
    draws = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "sha2(" in x]
    assert draws and all(x.count("sha2(") == 2 for x in draws)  # the common disturbance and the hop's own
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kept", [96 << 20, 8 * 40 * 3])
def test_gains_of_common_categories_are_worked_out_once(monkeypatch, kept):
    """Many entities with the same categories: no ln Gamma for every pair and category; the log LRs are those of single pairs."""
    monkeypatch.setattr(pair_arrays, "KEPT", kept)
    rng = np.random.default_rng(6)
    have = rng.integers(0, 4, (40, 9)) * (np.arange(9)[None, :] != 8)  # probes' counts of nine categories; none has the last
    have[1:, 7] = 0  # one probe has this
    own = np.r_[rng.integers(0, 3, (60, 9)), [[70] * 9], [[0] * 9]]
    alpha, at = np.linspace(0.3, 4.0, 9), np.nonzero(have.T)
    starts = np.r_[0, np.cumsum((have > 0).sum(0))]
    index = pair_arrays._Index(starts, at[1], have.T[at].astype(float), alpha, have.sum(1).astype(float), 21.0)
    rows = [np.flatnonzero(r) if r.any() else None for r in own], [r[r > 0] if r.any() else None for r in own], own.sum(1).astype(float)
    got = index.log_lr(*rows)
    g = np.vectorize(math.lgamma)
    up = lambda a, n: g(a + n) - g(a)
    want = sum(up(a, x[:, None] + y[None, :]) - up(a, x)[:, None] - up(a, y)[None, :] for a, x, y in zip(alpha, own.T, have.T))
    x, y = own.sum(1), have.sum(1)
    want = want + up(21.0, x)[:, None] + up(21.0, y)[None, :] - up(21.0, x[:, None] + y[None, :])
    assert got[:-1] == pytest.approx(want[:-1], abs=1e-9) and np.isnan(got[-1]).all()
    if kept > 1 << 20:
        made, lgamma = [], pair_arrays.lgamma
        monkeypatch.setattr(pair_arrays, "lgamma", lambda v: made.append(np.size(v)) or lgamma(v))
        assert np.array_equal(index.log_lr(*rows), got, equal_nan=True) and sum(made) < 1_500


def test_edges_leave_the_arrays_alone_and_are_scored_once(spark, sf_dir, monkeypatch):
    """Trials below the threshold are no rows of Spark's, and both directions of an edge come from one product."""
    from attestra.operators import graph
    from attestra.plans import linkage
    from attestra.plans.calibration import trial_table

    fair = sorted(map(tuple, trial_table(spark, sf_dir).where(F.col("score") >= linkage.FAIR).collect()))
    assert sorted(map(tuple, trial_table(spark, sf_dir, linkage.FAIR).collect())) == fair and len(fair) > 100
    made, table = [], linkage.trial_table
    monkeypatch.setattr(linkage, "trial_table", lambda *a: made.append(counting(table(*a))) or made[-1][0])
    edges = linkage.edges(spark, sf_dir)
    got = graph.neighbours(edges, 1.5).select("src", "dst", "log_lr").collect()
    assert len(made) == 1 and made[0][1].value == len(fair)
    strong = [(a, b) for a, b, _, score, *_ in fair if round(score * 10 - 1, 6) >= 1.5]
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(strong + [(b, a) for a, b in strong])


@pytest.mark.parametrize("repeated", [False, True])
def test_two_systems_on_one_trial_are_not_joined(spark, tmp_path, repeated):
    """A trial holds both scores; only repeated recordings, whose pairs meet each other's, need a join."""
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"vec_id": [*range(1, 120), 60 if repeated else 120], "label": [i % 4 for i in range(119)] + [3], "embedding": [rng.normal(size=4).astype("float32") for _ in range(120)]})
    got, want = both(spark, tmp_path, "pair_join_two_systems", embeddings=frame)
    assert len(got) == len(want) > 100 and [r[:3] for r in got] == [r[:3] for r in want]
    assert sorted(r[3] for r in got) == pytest.approx(sorted(r[3] for r in want), abs=2e-6)
    plan = QUERIES["pair_join_two_systems"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == repeated
