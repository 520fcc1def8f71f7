"""Queries over spans, subsets of owners, prominent peaks, incidents' recordings, modes and weakened streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, selection
from ..sources.tables import read, stored
from .calibration import _ALL, _COST, _r, trial_table
from .registry import query
from .sequences import _S, placed


@query(f"""WITH {_S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT s.user_id, value, CASE WHEN i - 1 < n / 3 THEN 'first' WHEN i - 1 >= 2 * n / 3 THEN 'final' END AS third FROM s JOIN n USING (user_id))
SELECT user_id, third, count(*) AS n, round(avg(value), 6) AS mean FROM p WHERE third IS NOT NULL GROUP BY 1, 2""")
def segment_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and final thirds of each user's events."""
    s = placed(spark, sf_dir)
    rows = s.join(s.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    at = F.col("i") - 1
    third = F.when(selection.in_span(at, F.col("n"), 0.0, 1 / 3), "first").when(selection.in_span(at, F.col("n"), 2 / 3, 1.0), "final")
    return rows.withColumn("third", third).where("third is not null").groupBy("user_id", "third").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"))


@query("""WITH d AS (SELECT source, row_number() OVER (ORDER BY sha256(source), source) AS k FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)), t AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS relabelled FROM d WHERE k <= 5)
SELECT doc_id, source, relabelled FROM documents JOIN t USING (source)""")
def owner_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of five sources; the subset is the operator's meaning."""
    return selection.owner_subset(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "source", "relabelled")


@query("""WITH RECURSIVE p AS (SELECT user_id, value * 40 AS f, CAST(event_id % 97 AS DOUBLE) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97, value * 40) AS k FROM (SELECT DISTINCT user_id, value, event_id FROM events WHERE value IS NOT NULL)),
t AS (SELECT user_id, 0::BIGINT AS k, []::DOUBLE[] AS taken FROM (SELECT DISTINCT user_id FROM p)
  UNION ALL SELECT t.user_id, p.k, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda x: abs(x - f) < 180)) = 0 THEN list_append(taken, f) ELSE taken END FROM t JOIN p ON p.user_id = t.user_id AND p.k = t.k + 1)
SELECT user_id, array_to_string(list_transform(list_sort(taken), lambda x: CAST(CAST(round(x) AS BIGINT) AS VARCHAR)), ',') AS peaks FROM (SELECT user_id, arg_max(taken, k) AS taken FROM t GROUP BY 1)""")
def prominent_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four sharpest peaks of each user, at least 180 apart: events' values stand for frequencies, a remainder of their id for bandwidths."""
    e = read(spark, sf_dir, "events").where("value is not null").select("user_id", F.struct((F.col("value") * 40).alias("frequency"), (F.col("event_id") % 97).cast("double").alias("bandwidth")).alias("p"))
    each = e.groupBy("user_id").agg(F.collect_list("p").alias("p"))  # an analysis frame's peaks
    peaks = F.transform(selection.prominent(F.col("p"), 4, 180.0), lambda x: F.round(x["frequency"]).cast("long").cast("string"))
    return each.select("user_id", F.array_join(peaks, ",").alias("peaks"))


@query("""WITH r AS (SELECT user_id, list(event_type ORDER BY event_type) AS recs FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL) GROUP BY 1)
SELECT 'op-' || user_id || '-' || event_id AS incident_id, recs[event_id % len(recs) + 1] AS recording FROM events JOIN r USING (user_id)""")
def incident_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an incident of its user, heard as one of the user's event types in turn."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    recs = e.where("event_type is not null").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("recs"))  # a handful of types
    incident = F.concat_ws("-", F.lit("op"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.join(recs, "user_id").select(incident.alias("incident_id"), selection.recording_of(incident, F.col("recs")).alias("recording"))


@query("SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS modes, count(DISTINCT lang) = 1 AS is_single_mode, list_sort(list(DISTINCT lang)) = ['en'] AS is_reference FROM documents WHERE lang IS NOT NULL")
def pooled_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one mode produced all documents; their languages stand for modes."""
    return selection.modes(read(spark, sf_dir, "documents"), "lang", "en").withColumn("modes", F.array_join("modes", ","))


@query(f"""WITH {_ALL}, g AS (SELECT avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS gap FROM t), d AS (SELECT unnest([1.0, 0.5, 0.0]) AS d),
w AS (SELECT d, label, 10 * CASE WHEN label = 1 AND d < 1 THEN score - (1 - d) * gap ELSE score END - 2 AS s FROM t, g, d)
SELECT CAST(d AS DOUBLE) AS discriminability, round(0.5 * (avg({_COST}) FILTER (label = 1) + avg({_COST}) FILTER (label = 0)), 6) AS cllr FROM w GROUP BY 1""")
def weakened_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C_llr of the trials with their same-source scores moved towards the others by none, half and all of the gap."""
    t = stored(trial_table(spark, sf_dir).select("score", "label"), "trials")
    gap = t.agg((F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))).alias("gap"))
    rows = t.crossJoin(F.broadcast(gap))  # one row
    out = None
    for d in (1.0, 0.5, 0.0):
        one = rows.select(F.lit(d).alias("discriminability"), "label", (10 * selection.weakened(F.col("score"), F.col("label"), F.col("gap"), d) - 2).alias("score"))
        out = one if out is None else out.unionByName(one)
    return metrics.cllr(out, ("discriminability",)).select("discriminability", _r("cllr").alias("cllr"))
