"""Queries over ordered events: activity runs, hangover, pauses, normalisation, slopes, frames, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence as q
from ..sources.tables import read
from .registry import query


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


#: A frame is active if its value lies above this.
ACTIVE = 100.0


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i, value, active: each user's events in time order."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).cast("long").alias("i"), "value", (F.col("value") > ACTIVE).alias("active"))


_S = f"s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value, value > {ACTIVE} AS active FROM events)"
_RUNS = f"""{_S}, g AS (SELECT *, CASE WHEN active IS NOT DISTINCT FROM lag(active) OVER w AND lag(i) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
h AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS run FROM g), r AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(active) AS value, min(i) AS first, max(i) AS last, count(*) AS n FROM h GROUP BY user_id, run)"""


@query(f"WITH {_RUNS} SELECT user_id, run, first, last, n FROM r WHERE value")
def islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.true_runs(placed(spark, sf_dir), "user_id", "i", F.col("active"))


@query(f"WITH {_RUNS} SELECT user_id, run, first, last, n FROM r WHERE value AND n >= 3")
def drop_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.true_runs(placed(spark, sf_dir), "user_id", "i", F.col("active"), 3)


@query(f"""WITH {_RUNS}, b AS (SELECT *, value OR coalesce(NOT value AND n <= 1 AND lag(value) OVER w AND lead(value) OVER w, false) AS is_on FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)),
c AS (SELECT *, CASE WHEN is_on AND NOT coalesce(lag(is_on) OVER (PARTITION BY user_id ORDER BY run), false) THEN 1 ELSE 0 END AS new FROM b), d AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY run) AS k FROM c)
SELECT user_id, min(first) AS first, max(last) AS last FROM d WHERE is_on GROUP BY user_id, k""")
def bridge_short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.bridged(placed(spark, sf_dir), "user_id", "i", F.col("active"), 1)


@query(f"WITH {_S} SELECT user_id, i, max(active) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM s")
def hangover_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("user_id", "i", q.hangover(F.col("active"), "user_id", "i", 2).alias("held"))


@query(f"WITH {_RUNS}, t AS (SELECT user_id, last AS after, lead(first) OVER (PARTITION BY user_id ORDER BY first) - last AS pause FROM r WHERE value) SELECT * FROM t WHERE pause IS NOT NULL")
def pause_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.pauses(q.true_runs(placed(spark, sf_dir), "user_id", "i", F.col("active")), "user_id")


@query(f"""WITH {_S}, n AS (SELECT user_id, max(i) AS n FROM s GROUP BY 1), p AS (SELECT s.user_id, s.i, s.value, v.value AS x FROM s JOIN n USING (user_id), unnest(range(-5, 6)) AS d(d), s v WHERE v.user_id = s.user_id AND v.i = least(greatest(s.i + d.d, 1), n.n))
SELECT user_id, i, round((any_value(value) - avg(x)) / CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END, 5) AS normalised FROM p GROUP BY user_id, i""")
def sliding_cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.sliding(placed(spark, sf_dir), "user_id", "i", "value", 10).select("user_id", "i", _r("normalised", 5).alias("normalised"))


@query(f"WITH {_S} SELECT user_id, i, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-8 THEN 1 ELSE stddev_pop(value) OVER w END, 5) AS z FROM s WINDOW w AS (PARTITION BY user_id)")
def global_cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("user_id", "i", _r(q.whole(F.col("value"), "user_id"), 5).alias("z"))


@query(f"""WITH {_S}, d AS (SELECT user_id, i, (1 * (coalesce(lead(value, 1) OVER w, l) - coalesce(lag(value, 1) OVER w, f)) + 2 * (coalesce(lead(value, 2) OVER w, l) - coalesce(lag(value, 2) OVER w, f))) / 10 AS d
FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM s) WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(d, 5) AS delta FROM d""")
def delta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("user_id", "i", _r(q.delta("value", "user_id", "i"), 5).alias("delta"))


@query(f"WITH {_S} SELECT user_id, i, round(value - 0.97 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY i), value), 6) AS emphasised FROM s")
def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("user_id", "i", _r(q.pre_emphasis("value", "user_id", "i")).alias("emphasised"))


@query(f"""WITH {_S}, a AS (SELECT user_id, abs(value) AS v, abs(value - lag(value) OVER w) AS c1, CASE WHEN row_number() OVER w > 1 AND lead(value) OVER w IS NOT NULL THEN abs(value - avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) END AS c3 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(avg(c1) / avg(v), 6) AS local_quotient, round(avg(c3) / avg(v), 6) AS centred_quotient FROM a GROUP BY 1 HAVING avg(c1) IS NOT NULL AND avg(c3) IS NOT NULL""")
def jitter_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir)
    one, three = (q.quotient(rows, "user_id", "i", "value", k) for k in (1, 3))
    return one.select("user_id", _r("quotient").alias("local_quotient")).join(three.select("user_id", _r("quotient").alias("centred_quotient")), "user_id")


@query(f"""WITH {_S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT user_id, unnest(range(0, n - 16 + 1, 8)) // 8 AS frame FROM n WHERE n >= 16)
SELECT f.user_id, f.frame, count(*) AS n, round(avg(value), 9) AS mean, round(avg(value * value), 9) AS energy FROM f JOIN s ON s.user_id = f.user_id AND s.i - 1 BETWEEN f.frame * 8 AND f.frame * 8 + 15 GROUP BY 1, 2""")
def overlapping_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.frames(placed(spark, sf_dir), "user_id", "i", "value", 16, 8).select("user_id", "frame", "n", _r("mean", 9).alias("mean"), _r("energy", 9).alias("energy"))


#: Ids in a range.
RANGE = 10_000


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT source, least(n, 10) AS k, n FROM r GROUP BY 1, 2, 3), w AS (SELECT DISTINCT source, CASE WHEN k = 1 THEN 0 ELSE (x.x * (n - 1)) // (k - 1) END AS i FROM k, unnest(range(k)) AS x(x))
SELECT r.source, r.doc_id FROM r JOIN w USING (source, i)""")
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten rows of each source, evenly spaced; the sample is the operator's meaning.

    Places come from counts of id ranges: only ranges that hold a wanted place number their rows.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / RANGE).alias("part"))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("source", "part").agg(F.count("*").alias("here")).withColumns({"before": F.coalesce(F.sum("here").over(along), F.lit(0)), "n": F.sum("here").over(Window.partitionBy("source"))})
    k = F.least(F.col("n"), F.lit(10))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda x: F.when(k == 1, F.lit(0).cast("long")).otherwise(F.floor(x * (F.col("n") - 1) / (k - 1)).cast("long")))
    inside = F.array_distinct(F.transform(F.filter(wanted, lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("here"))), lambda i: i - F.col("before")))
    parts = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), inside.alias("wanted")).where(F.size("wanted") > 0)
    rows = d.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    i = F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id")) - 1
    return rows.withColumn("i", i.cast("long")).where(F.array_contains("wanted", F.col("i"))).select("source", "doc_id")


@query("""WITH u AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, min(ts) OVER (PARTITION BY user_id, event_type) AS first_ts, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events),
c AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY first_ts, first_id) AS c FROM u) SELECT user_id, event_type, event_id FROM c WHERE r <= 3 AND c <= 2""")
def retain_bounded_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of each user's first two types, in arrival order; the bound is the operator's meaning."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    chapter = Window.partitionBy("user_id", "event_type")
    rows = e.select("user_id", "event_type", "event_id", F.row_number().over(chapter.orderBy("ts", "event_id")).alias("r"), F.min("ts").over(chapter).alias("first_ts"), F.min("event_id").over(chapter).alias("first_id"))
    rows = rows.withColumn("c", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first_ts", "first_id")))
    return rows.where("r <= 3 and c <= 2").select("user_id", "event_type", "event_id")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source, rn FROM r ORDER BY rn, source LIMIT 60""")
def round_robin_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 rows dealt in turn from the sources; no source gives more than 60, so tasks keep no more of each."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 60").select("doc_id", "source", F.col("rn").cast("long").alias("rn")).orderBy("rn", "source").limit(60)


def folded_sql(rows: str, part: str, order: str, name: str, target: int, tail: float) -> str:
    """Packs by a recursive walk along each part; rows: a query of part, order and size."""
    return f"""WITH RECURSIVE r AS ({rows}), t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS pos FROM r),
f AS (SELECT {part}, {order}, pos, size AS total, 0 AS k FROM t WHERE pos = 1
  UNION ALL SELECT t.{part}, t.{order}, t.pos, CASE WHEN f.total >= {target} THEN 0 ELSE f.total END + t.size, CASE WHEN f.total >= {target} THEN f.k + 1 ELSE f.k END FROM f JOIN t ON t.{part} IS NOT DISTINCT FROM f.{part} AND t.pos = f.pos + 1)
SELECT {part}, {order}, CASE WHEN max(total) OVER (PARTITION BY {part}, k) >= least({target}, {tail}) THEN CAST(k AS DOUBLE) END AS {name} FROM f"""


@query(folded_sql("SELECT doc_id, source, n_chars AS size FROM documents", "source", "doc_id", "pack", 5000, 2500))
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source packed in order into takes of at least 5,000 characters; a tail below half of that has pack null."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return q.folded(d, "source", "doc_id", F.col("n_chars"), 5000, tail=2500).withColumn("pack", F.col("pack").cast("double"))
