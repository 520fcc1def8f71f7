"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from attestra.operators import metrics
from attestra.plans.calibration import score_file
from attestra.queries import QUERIES, SQL


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) < 2e-3, (name, x, y)


#: Queries that the smallest tables leave without a row.
MAY_BE_EMPTY = {"logistic_fit"}
#: Queries that refuse the smallest tables, with a row that says so and nothing else.
MAY_REFUSE = {"channel_viability_verdict"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(name, spark, sf_dir):
    """Rows come, none twice, and the numbers in them are finite where they are not absent."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(map(str, rows))) == len(rows)
    numbers = [c for c, kind in df.dtypes if kind == "double"]
    assert all(r[c] is None or not math.isinf(r[c]) for r in rows for c in numbers)
    assert name in MAY_REFUSE or all(any(r[c] is not None for r in rows) for c in df.columns if rows)


def test_the_fit_of_the_score_file_has_no_slope_left(spark):
    """The gradient of C_llr is zero at the fitted line."""
    rows = score_file(spark, "/root/testdata/sf0.01")
    slope, shift = metrics.fit_logistic(rows)
    p = rows.toPandas()
    x, y = p["score"].to_numpy(), p["label"].to_numpy()
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    off = w * (1 / (1 + np.exp(-(slope * x + shift))) - y)
    assert abs(off.sum()) < 1e-7 and (abs((off * x).sum()) < 1e-6 or slope == 0)


def test_every_probe_has_its_ranking(spark, sf_dir, duck):
    got = {r["probe"] for r in QUERIES["probe_set_search_topk"](spark, sf_dir).select("probe").distinct().collect()}
    want = duck.execute("SELECT o_custkey FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1 HAVING count(*) >= 2").fetchall()
    assert got == {k for (k,) in want} and len(got) > 1
