"""Queries over temporal, transactional and device evidence, and the ranked search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.likelihood import LN10, band, lgamma, logistic, uniform_prior
from ..operators import pairs, profiles
from ..operators.pair_arrays import Best, Counts, Values, scored
from ..sources.tables import read, small, stored
from .registry import query

TOP = 50


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _halves_away(c: Column | str, digits: int) -> Column:
    """``_r`` without decimals, for scores of many pairs: halves away from zero, as SQL rounds doubles."""
    x = F.col(c) if isinstance(c, str) else c
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits + 0.0


def _cats(sql_category: str, entity: str, table: str) -> str:
    return f"SELECT {entity} AS entity, CAST({sql_category} AS VARCHAR) AS category, count(*) AS n FROM {table} GROUP BY 1, 2"


@query(_cats("hour(ts)", "user_id", "events"))
def temporal_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.counts(read(spark, sf_dir, "events"), "user_id", F.hour("ts"))


@query(_cats("isodow(ts) - 1", "user_id", "events"))
def temporal_weekday_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.counts(read(spark, sf_dir, "events"), "user_id", F.weekday("ts"))


@query("""SELECT event_id, round(ln(greatest((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 1.0)), 6) AS log_gap
FROM events QUALIFY lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL""")
def temporal_interarrival_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.gaps(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")
    return rows.where("log_gap is not null").select("event_id", _r("log_gap").alias("log_gap"))


#: Exact whole-number rounding, half up: as doubles, shares such as 2.75e-8 * n fall on either side of a half.
_REPORTED = "((198000000 * sum(n) + (SELECT sum(n) FROM {t})) // (2 * (SELECT sum(n) FROM {t}))) / 1e8"


def reported(counted: DataFrame) -> DataFrame:
    """category, reported_frequency: 99 hundredths of a category's share, to 8 places."""
    n = counted.groupBy("category").agg(F.sum("n").cast("decimal(20,0)").alias("n"))
    rows = n.crossJoin(F.broadcast(counted.agg(F.sum("n").cast("decimal(20,0)").alias("_total"))))
    places = F.expr("(198000000BD * n + _total) div (2BD * _total)")
    return rows.select("category", (places / F.lit(1e8)).alias("reported_frequency"))


_MOMENTS = "SELECT {e} AS entity, count(*) AS n, round(avg({v}), 6) AS mean, round(var_pop({v}) * count(*), 4) AS m2 FROM {t} GROUP BY 1"


def _moments(rows: DataFrame, entity: str, value: Column) -> DataFrame:
    return profiles.moments(rows, entity, value).select("entity", "n", _r("mean").alias("mean"), _r("m2", 4).alias("m2"))


@query(_MOMENTS.format(e="user_id", v="ln(greatest(value, 1.0))", t="events"))
def temporal_duration_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(read(spark, sf_dir, "events"), "user_id", profiles.log_floor(F.col("value"), 1.0))


_CIRCULAR = """WITH n AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1),
bins AS (SELECT unnest(range(24)) AS b), w AS (SELECT b.b AS i, c.b AS j, exp(4.0 * cos(2 * pi() * (b.b - c.b) / 24)) AS w FROM bins b, bins c),
k AS (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM w)
SELECT CAST(k.i AS VARCHAR) AS category, round(sum(n.n * k.w) / (SELECT sum(n) FROM n), 8) AS frequency FROM n JOIN k ON n.h = k.j GROUP BY k.i"""


@query(_CIRCULAR)
def circular_background_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.circular(profiles.counts(read(spark, sf_dir, "events"), "user_id", F.hour("ts")), 24).select("category", _r("frequency", 8).alias("frequency"))


@query(_cats("o_orderpriority", "o_custkey", "orders"))
def tx_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


_LINES = "(SELECT o_custkey, l_suppkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_partkey")


@query(_cats("l_suppkey", "o_custkey", _LINES))
def tx_agent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.counts(_lines(spark, sf_dir), "o_custkey", "l_suppkey")


@query(_cats("l_partkey", "o_custkey", _LINES))
def tx_counterparty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.counts(_lines(spark, sf_dir), "o_custkey", "l_partkey")


@query(_MOMENTS.format(e="o_custkey", v="ln(greatest(o_totalprice, 0.01))", t="orders"))
def tx_amount_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(read(spark, sf_dir, "orders"), "o_custkey", profiles.log_floor(F.col("o_totalprice"), 0.01))


@query("""WITH n AS (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1)
SELECT category, n, round(n / (SELECT sum(n) FROM n), 8) AS frequency, round(n / (SELECT sum(n) FROM n) * 0.99, 8) AS reported_frequency,
round(0.01 / (SELECT count(*) FROM n), 8) AS unseen_frequency FROM n""")
def background_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles.background(profiles.counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority"))
    return rows.select("category", "n", *[_r(c, 8).alias(c) for c in ("frequency", "reported_frequency", "unseen_frequency")])


@query("""WITH k AS (SELECT event_type AS category FROM events GROUP BY 1) SELECT category, round(1.0 / (SELECT count(*) FROM k), 8) AS frequency FROM k""")
def uniform_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "events").select(F.col("event_type").alias("category")).distinct()
    return kinds.crossJoin(F.broadcast(kinds.agg(F.count("*").alias("k")))).select("category", F.round(1 / F.col("k"), 8).alias("frequency"))


# -- pair scores: SQL building blocks. A probe's id is divisible by 50; a pair of two probes is scored once.

_PAIRS = "{a}.entity % 50 = 0 AND {a}.entity <> {b}.entity AND ({b}.entity % 50 <> 0 OR {a}.entity < {b}.entity)"


def _dm_sql(name: str, entity: str, category: str, table: str, concentration: float, frequency: str | None = None) -> str:
    """CTEs ending in name(a, b, dm)."""
    mass = concentration + max(concentration * 0.01, 1e-6)
    freq = frequency or f"SELECT category, sum(n) / (SELECT sum(n) FROM {name}_c) AS f FROM {name}_c GROUP BY 1"
    rise = lambda a, n: f"(lgamma({a} + {n}) - lgamma({a}))"
    return f"""{name}_c AS (SELECT {entity} AS entity, CAST({category} AS VARCHAR) AS category, count(*) AS n FROM {table} GROUP BY 1, 2),
{name}_f AS ({freq}), {name}_t AS (SELECT entity, sum(n) AS n FROM {name}_c GROUP BY 1),
{name}_s AS (SELECT x.entity AS a, y.entity AS b, sum({rise(f"{concentration} * f", "(x.n + y.n)")} - {rise(f"{concentration} * f", "x.n")} - {rise(f"{concentration} * f", "y.n")}) AS s
  FROM {name}_c x JOIN {name}_c y ON x.category = y.category AND {_PAIRS.format(a="x", b="y")} JOIN {name}_f ON {name}_f.category = x.category GROUP BY 1, 2),
{name} AS (SELECT x.entity AS a, y.entity AS b, coalesce(s.s, 0) - {rise(mass, "(x.n + y.n)")} + {rise(mass, "x.n")} + {rise(mass, "y.n")} AS dm
  FROM {name}_t x JOIN {name}_t y ON {_PAIRS.format(a="x", b="y")} LEFT JOIN {name}_s s ON s.a = x.entity AND s.b = y.entity)"""


def _nig_sql(name: str, entity: str, value: str, table: str) -> str:
    """CTEs ending in name(a, b, nig)."""

    def marginal(n: str, mean: str, m2: str) -> str:
        scale = f"(p.scale + 0.5 * {m2} + p.k * {n} * ({mean} - p.mu) * ({mean} - p.mu) / (2 * (p.k + {n})))"
        return f"(-0.5 * {n} * ln(pi()) + 0.5 * (ln(p.k) - ln(p.k + {n})) + lgamma(2.5 + {n} / 2.0) - lgamma(2.5) + 2.5 * ln(p.scale) - (2.5 + {n} / 2.0) * ln({scale}))"

    pooled = marginal("(x.n + y.n)", "(x.mean + (y.mean - x.mean) * y.n / (x.n + y.n))", "(x.m2 + y.m2 + (y.mean - x.mean) * (y.mean - x.mean) * x.n * y.n / (x.n + y.n))")
    return f"""{name}_p AS (SELECT avg({value}) AS mu, 0.4 * var_samp({value}) / (0.6 * var_samp({value})) AS k, 0.4 * var_samp({value}) * 1.5 AS scale FROM {table}),
{name}_m AS (SELECT {entity} AS entity, count(*) AS n, avg({value}) AS mean, var_pop({value}) * count(*) AS m2 FROM {table} GROUP BY 1),
{name} AS (SELECT x.entity AS a, y.entity AS b, {pooled} - {marginal("x.n", "x.mean", "x.m2")} - {marginal("y.n", "y.mean", "y.m2")} AS nig
  FROM {name}_m x JOIN {name}_m y ON {_PAIRS.format(a="x", b="y")}, {name}_p p)"""


_AMOUNT = "ln(greatest(o_totalprice, 0.01))"


@query(f"WITH {_dm_sql('d', 'o_custkey', 'o_orderpriority', 'orders', 100.0)} SELECT a, b, round(dm, 5) AS log_lr FROM d")
def dm_llr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(profiles.counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority"), "kind")
    rows = scored(counted.select("entity").distinct(), {"kind": Counts(counted, small(profiles.background(counted)), 100.0)}, {})
    return rows.select(*pairs.sides(), _halves_away("kind", 5).alias("log_lr"))


@query(f"WITH {_nig_sql('g', 'o_custkey', _AMOUNT, 'orders')} SELECT a, b, round(nig, 5) AS log_lr FROM g")
def nig_llr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, value = read(spark, sf_dir, "orders"), profiles.log_floor(F.col("o_totalprice"), 0.01)
    moments = stored(profiles.moments(orders, "o_custkey", value), "amount")
    rows = scored(moments.select("entity"), {}, {"amount": Values(moments, profiles.normal_prior(orders, value))})
    return rows.select(*pairs.sides(), _halves_away("amount", 5).alias("log_lr"))


def transactional_evidence(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """Types, agents and counterparties, and amounts of every customer."""
    lines, orders, value = _lines(spark, sf_dir), read(spark, sf_dir, "orders"), profiles.log_floor(F.col("o_totalprice"), 0.01)
    tables = {"kind": (orders, "o_orderpriority", 100.0), "agent": (lines, "l_suppkey", 20.0), "party": (lines, "l_partkey", 20.0)}
    counts = {}
    for name, (rows, column, concentration) in tables.items():
        counted = stored(profiles.counts(rows, "o_custkey", column), name)
        counts[name] = Counts(counted, profiles.background(counted), concentration)
    return counts, {"amount": Values(profiles.moments(orders, "o_custkey", value), profiles.normal_prior(orders, value))}


def transactional_scores(spark: SparkSession, sf_dir: str, best: Best | None = None) -> DataFrame:
    """a, b, log_lr; null where either side has fewer than two transactions. With ``best`` only leaders, and of customers with two."""
    counts, values = transactional_evidence(spark, sf_dir)
    customers = values["amount"].moments.select("entity", "n")
    rows = scored(customers.where("n >= 2") if best else customers, counts, values, best=best)
    score = F.col("amount") + sum((F.coalesce(c, F.lit(0.0)) for c in counts), F.lit(0.0))
    enough = (F.col("p.n") >= 2) & (F.col("q.n") >= 2)
    return rows.select(*pairs.sides(), F.when(enough, score).alias("log_lr"))


_TX = f"""{_nig_sql('g', 'o_custkey', _AMOUNT, 'orders')}, {_dm_sql('d', 'o_custkey', 'o_orderpriority', 'orders', 100.0)},
{_dm_sql('s', 'o_custkey', 'l_suppkey', _LINES, 20.0)}, {_dm_sql('p', 'o_custkey', 'l_partkey', _LINES, 20.0)},
tx AS (SELECT g.a, g.b, CASE WHEN x.n >= 2 AND y.n >= 2 THEN g.nig + coalesce(d.dm, 0) + coalesce(s.dm, 0) + coalesce(p.dm, 0) END AS log_lr
  FROM g JOIN g_m x ON x.entity = g.a JOIN g_m y ON y.entity = g.b LEFT JOIN d ON d.a = g.a AND d.b = g.b LEFT JOIN s ON s.a = g.a AND s.b = g.b LEFT JOIN p ON p.a = g.a AND p.b = g.b)"""


@query(f"WITH {_TX} SELECT a, b, round(log_lr, 4) AS log_lr FROM tx")
def transactional_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactional_scores(spark, sf_dir).select("a", "b", _r("log_lr", 4).alias("log_lr"))


#: Sites stand for cell sites, which no table holds: a dozen bands of the events' values.
_DEVICE = "(SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, CAST(CAST(floor(value) AS BIGINT) % 12 AS VARCHAR) AS site FROM events)"


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = (F.floor("value") % 12).cast("string")
    return read(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), site.alias("site"))


#: Kind -> (column, concentration): handsets tell much, their models little.
DEVICE_KINDS = {"imei": ("k", 5.0), "handset": ("event_type", 200.0), "site": ("site", 30.0)}


@query(f"""WITH {_dm_sql('i', 'user_id', 'k', _DEVICE, 5.0)}, {_dm_sql('h', 'user_id', 'event_type', _DEVICE, 200.0)}, {_dm_sql('l', 'user_id', 'site', _DEVICE, 30.0)}
SELECT i.a, i.b, round(i.dm + h.dm + l.dm, 4) AS log_lr FROM i JOIN h USING (a, b) JOIN l USING (a, b)""")
def device_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handsets, their models and sites; null where two incidents record nothing of one kind in common."""
    events = stored(device_events(spark, sf_dir), "device")
    counts = {}
    for name, (column, concentration) in DEVICE_KINDS.items():
        counted = stored(profiles.counts(events, "user_id", column), name)
        counts[name] = Counts(counted, small(profiles.background(counted)), concentration)
    rows = scored(events.select(F.col("user_id").alias("entity")).where("entity is not null").distinct(), counts, {})
    score = F.when(F.coalesce(*counts).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in counts), F.lit(0.0)))
    return rows.select(*pairs.sides(), _r(score, 4).alias("log_lr"))


def _shared_sql(name: str, column: str) -> str:
    return f"""{name}_c AS ({_cats(column, 'user_id', _DEVICE)}), {name}_f AS (SELECT category, {_REPORTED.format(t=f"{name}_c")} AS f FROM {name}_c GROUP BY 1),
{name} AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n, min(f) AS rarest FROM {name}_c x JOIN {name}_c y ON x.category = y.category AND {_PAIRS.format(a='x', b='y')} JOIN {name}_f ON {name}_f.category = x.category GROUP BY 1, 2)"""


@query(f"""WITH {_shared_sql('i', 'k')}, {_shared_sql('h', 'event_type')}, {_shared_sql('l', 'site')}
SELECT a, b, coalesce(i.n, 0) AS n_shared_imei, coalesce(l.n, 0) AS n_shared_sites, coalesce(h.n, 0) > 0 AS shares_model, i.rarest AS rarest_imei_frequency FROM i FULL JOIN h USING (a, b) FULL JOIN l USING (a, b)""")
def device_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two incidents have in common, of pairs that have anything: handsets, sites, models, and how rare the rarest handset is."""
    events = stored(device_events(spark, sf_dir), "device")
    rows = None
    for name, (column, _) in DEVICE_KINDS.items():
        counted = stored(profiles.counts(events, "user_id", column), name)
        one = pairs.shared(counted, reported(counted)).withColumn("kind", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    n = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    rare = F.max(F.when(F.col("kind") == "imei", F.col("rarest")))
    return rows.groupBy("a", "b").agg(n("imei").alias("n_shared_imei"), n("site").alias("n_shared_sites"), (n("handset") > 0).alias("shares_model"), rare.alias("rarest_imei_frequency"))


_HOUR_F = "SELECT category, frequency AS f FROM (" + _CIRCULAR.replace(", 8) AS frequency", ", 15) AS frequency") + ")"
_WEEKDAY_F = _HOUR_F.replace("hour(ts)", "isodow(ts) - 1").replace("range(24)", "range(7)").replace("/ 24)", "/ 7)")


_TEMPORAL = f"""{_dm_sql('h', 'user_id', 'hour(ts)', 'events', 30.0, _HOUR_F)}, {_dm_sql('w', 'user_id', 'isodow(ts) - 1', 'events', 30.0, _WEEKDAY_F)},
{_nig_sql('g', 'user_id', 'ln(greatest(value, 1.0))', 'events')},
tm AS (SELECT h.a, h.b, x.n AS n_first, y.n AS n_second, h.dm AS hour, w.dm AS weekday, g.nig AS duration FROM h JOIN w USING (a, b) JOIN g USING (a, b) JOIN g_m x ON x.entity = h.a JOIN g_m y ON y.entity = h.b)"""


def temporal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p, q (entity, n calls) with the log LRs hour, weekday and duration."""
    events, value = read(spark, sf_dir, "events"), profiles.log_floor(F.col("value"), 1.0)
    counts = {}
    for name, column, bins in (("hour", F.hour("ts"), 24), ("weekday", F.weekday("ts"), 7)):
        counted = stored(profiles.counts(events, "user_id", column), name)
        counts[name] = Counts(counted, F.broadcast(profiles.circular(counted, bins)), 30.0)  # a row a bin
    values = {"duration": Values(profiles.moments(events, "user_id", value), profiles.normal_prior(events, value))}
    return scored(values["duration"].moments.select("entity", "n"), counts, values)


@query(f"WITH {_TEMPORAL} SELECT a, b, CASE WHEN n_first >= 3 AND n_second >= 3 THEN round(hour + weekday + duration, 4) END AS log_lr FROM tm")
def temporal_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    enough = (F.col("p.n") >= 3) & (F.col("q.n") >= 3)
    score = F.col("hour") + F.col("weekday") + F.col("duration")
    return temporal_parts(spark, sf_dir).select(*pairs.sides(), _r(F.when(enough, score), 4).alias("log_lr"))


@query(f"WITH {_TEMPORAL} SELECT a, b, n_first, n_second, round(hour, 4) AS hour, round(weekday, 4) AS weekday, round(duration, 4) AS duration FROM tm")
def temporal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the temporal score, and the calls on either side."""
    rows = temporal_parts(spark, sf_dir)
    return rows.select(*pairs.sides(), F.col("p.n").alias("n_first"), F.col("q.n").alias("n_second"), *[_r(c, 4).alias(c) for c in ("hour", "weekday", "duration")])


@query(f"""WITH c AS ({_cats('l_suppkey', 'o_custkey', _LINES)}), f AS (SELECT category, {_REPORTED.format(t='c')} AS f FROM c GROUP BY 1)
SELECT x.entity AS a, y.entity AS b, count(*) AS n_shared, min(f) AS rarest_frequency
FROM c x JOIN c y ON x.category = y.category AND {_PAIRS.format(a='x', b='y')} JOIN f ON f.category = x.category GROUP BY 1, 2""")
def rarest_shared_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(profiles.counts(_lines(spark, sf_dir), "o_custkey", "l_suppkey"), "agents")
    rows = pairs.shared(counted, reported(counted))
    return rows.select("a", "b", F.col("n").alias("n_shared"), F.col("rarest").alias("rarest_frequency"))


GRID = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)


def _grid_sql() -> str:
    rise = lambda a, n: f"(lgamma({a} + {n}) - lgamma({a}))"
    return f"""WITH c AS (SELECT o_custkey AS entity, o_orderkey % 2 AS half, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1, 2, 3),
f AS (SELECT category, sum(n) / (SELECT sum(n) FROM c) AS f FROM c GROUP BY 1), grid AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS c),
t AS (SELECT entity, sum(n) FILTER (half = 0) AS na, sum(n) FILTER (half = 1) AS nb FROM c GROUP BY 1 HAVING na IS NOT NULL AND nb IS NOT NULL),
s AS (SELECT x.entity, grid.c, sum({rise('grid.c * f', '(x.n + y.n)')} - {rise('grid.c * f', 'x.n')} - {rise('grid.c * f', 'y.n')}) AS s
 FROM c x JOIN c y ON x.entity = y.entity AND x.category = y.category AND x.half = 0 AND y.half = 1 JOIN f ON f.category = x.category, grid GROUP BY 1, 2)
SELECT grid.c AS concentration, count(*) AS n_pairs, round(avg(coalesce(s.s, 0) - {rise('(grid.c + greatest(grid.c * 0.01, 1e-6))', '(na + nb)')} + {rise('(grid.c + greatest(grid.c * 0.01, 1e-6))', 'na')} + {rise('(grid.c + greatest(grid.c * 0.01, 1e-6))', 'nb')}), 5) AS mean_log_lr
FROM t CROSS JOIN grid LEFT JOIN s ON s.entity = t.entity AND s.c = grid.c GROUP BY 1"""


@query(_grid_sql())
def concentration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log LR of same-source pairs (odd and even orders of a customer) for each concentration of the grid."""
    orders = read(spark, sf_dir, "orders")
    halves = [profiles.counts(orders.where(F.col("o_orderkey") % 2 == h), "o_custkey", "o_orderpriority") for h in (0, 1)]
    freq = small(profiles.background(profiles.counts(orders, "o_custkey", "o_orderpriority")))
    # weights at concentration 1 are the frequencies themselves
    sides = [pairs.with_weights(h, freq, 1.0, "kind").select(F.struct("entity", "kind", "kind_n").alias(s)) for h, s in zip(halves, "ab")]
    rows = sides[0].join(sides[1], F.col("a.entity") == F.col("b.entity"))
    rows = rows.withColumn("c", F.explode(F.array(*[F.lit(c) for c in GRID])))
    rise = lambda a, n: lgamma(a + n) - lgamma(a)
    ma, mb, c = F.col("a.kind"), F.col("b.kind"), F.col("c")
    shared = F.array_intersect(F.map_keys(ma), F.map_keys(mb))
    gain = F.aggregate(shared, F.lit(0.0), lambda s, k: s + rise(c * ma[k]["alpha"], ma[k]["n"] + mb[k]["n"]) - rise(c * ma[k]["alpha"], ma[k]["n"]) - rise(c * ma[k]["alpha"], mb[k]["n"]))
    mass, na, nb = c + F.greatest(c * profiles.UNSEEN_MASS, F.lit(1e-6)), F.col("a.kind_n"), F.col("b.kind_n")
    score = gain - rise(mass, na + nb) + rise(mass, na) + rise(mass, nb)
    return rows.groupBy(c.alias("concentration")).agg(F.count("*").alias("n_pairs"), _r(F.avg(score), 5).alias("mean_log_lr"))


def search(spark: SparkSession, sf_dir: str, n: int = TOP) -> DataFrame:
    """The customer with the smallest id that has two orders, against all others: transactional evidence, uniform prior."""
    counts, values = transactional_evidence(spark, sf_dir)
    table = stored(values["amount"].moments.select("entity", "n"), "customers")
    found = table.agg(F.count("*").alias("size"), F.min(F.when(F.col("n") >= 2, F.col("entity"))).alias("probe")).first()
    rows = scored(table, counts, values, lambda e: e == F.lit(found["probe"])).where("q.n >= 2")
    score = F.col("amount") + sum((F.coalesce(c, F.lit(0.0)) for c in counts), F.lit(0.0))
    return pairs.searched(rows.select(F.col("q.entity").alias("candidate"), score.alias("log_lr")), n, -math.log(max(found["size"] - 1, 1)))


_SEARCH = f"""WITH {_TX.replace('entity % 50 = 0', "entity = (SELECT min(k) FROM (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) >= 2))").replace('y.entity % 50 <> 0 OR x.entity < y.entity', 'true')},
s AS (SELECT b AS candidate, log_lr, log_lr - ln((SELECT count(DISTINCT o_custkey) FROM orders) - 1) AS posterior FROM tx WHERE log_lr IS NOT NULL)
SELECT candidate, round(log_lr, 4) AS log_lr, round(posterior, 4) AS posterior_log_odds,
CASE WHEN abs(log_lr / ln(10)) < 0.3 THEN 'no_support' WHEN abs(log_lr / ln(10)) < 1 THEN 'weak' WHEN abs(log_lr / ln(10)) < 2 THEN 'moderate' WHEN abs(log_lr / ln(10)) < 3 THEN 'moderately_strong' WHEN abs(log_lr / ln(10)) < 4 THEN 'strong' WHEN abs(log_lr / ln(10)) < 6 THEN 'very_strong' ELSE 'extremely_strong' END AS strength,
(log_lr > 0 AND posterior < 0) AS prior_dominates FROM s ORDER BY posterior DESC, candidate LIMIT {TOP}""".replace("s AS (SELECT b AS candidate", "found AS (SELECT b AS candidate").replace("FROM s ORDER", "FROM found ORDER")


@query(_SEARCH)
def probe_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir).withColumns({"log_lr": _r("log_lr", 4), "posterior_log_odds": _r("posterior_log_odds", 4)})


_RANKED = f"""WITH {_TX}, both_ways AS (SELECT a AS probe, b AS candidate, log_lr FROM tx UNION ALL SELECT b, a, log_lr FROM tx WHERE b % 50 = 0),
ranked AS (SELECT probe, candidate, log_lr, log_lr - ln((SELECT count(DISTINCT o_custkey) FROM orders) - 1) AS posterior FROM both_ways WHERE log_lr IS NOT NULL)
SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY posterior DESC, candidate) AS place, candidate, round(log_lr, 4) AS log_lr, round(posterior, 4) AS posterior_log_odds,
(log_lr > 0 AND posterior < 0) AS prior_dominates FROM ranked QUALIFY place <= {TOP}"""


@query(_RANKED)
def probe_set_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates of every probe against all others; a pair of two probes counts for both."""
    n = read(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("n"))
    ways = transactional_scores(spark, sf_dir, Best(TOP, ("amount",))).where("log_lr is not null")
    ways = ways.select(F.col("a").alias("probe"), F.col("b").alias("candidate"), "log_lr")
    rows = ways.crossJoin(F.broadcast(n)).withColumn("posterior", F.col("log_lr") + uniform_prior(F.col("n")))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("posterior"), "candidate"))
    rows = rows.withColumn("place", place).where(F.col("place") <= TOP)
    return rows.select("probe", "place", "candidate", _r("log_lr", 4).alias("log_lr"), _r("posterior", 4).alias("posterior_log_odds"), ((F.col("log_lr") > 0) & (F.col("posterior") < 0)).alias("prior_dominates"))


@query(f"""WITH {_TX} SELECT a, b, round(log_lr / ln(10), 4) AS log10_lr, round(log_lr - ln(n.n - 1), 4) AS posterior_log_odds, round(CASE WHEN log_lr - ln(n.n - 1) >= 0 THEN 1 / (1 + exp(-(log_lr - ln(n.n - 1)))) ELSE exp(log_lr - ln(n.n - 1)) / (1 + exp(log_lr - ln(n.n - 1))) END, 6) AS probability,
CASE WHEN abs(log_lr / ln(10)) < 0.3 THEN 'no_support' WHEN abs(log_lr / ln(10)) < 1 THEN 'weak' WHEN abs(log_lr / ln(10)) < 2 THEN 'moderate' WHEN abs(log_lr / ln(10)) < 3 THEN 'moderately_strong' WHEN abs(log_lr / ln(10)) < 4 THEN 'strong' WHEN abs(log_lr / ln(10)) < 6 THEN 'very_strong' ELSE 'extremely_strong' END AS strength
FROM tx, (SELECT count(DISTINCT o_custkey) AS n FROM orders) n WHERE log_lr IS NOT NULL""")
def posterior_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("n"))
    rows = transactional_scores(spark, sf_dir).where("log_lr is not null").crossJoin(F.broadcast(n))
    posterior = F.col("log_lr") + uniform_prior(F.col("n"))
    return rows.select("a", "b", _r(F.col("log_lr") / LN10, 4).alias("log10_lr"), _r(posterior, 4).alias("posterior_log_odds"), _r(logistic(posterior)).alias("probability"), band(F.col("log_lr") / LN10).alias("strength"))
