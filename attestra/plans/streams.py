"""Batch runs of the streaming queries over the given tables (available now, then stop)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read, shared_dir, stored
from ..streaming import enrolment
from ..streaming import events as s
from .linkage import GENESIS, audit
from .registry import query


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result once all input that is there has been read, in the shared folder."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append")
    else:
        run = stream.writeStream.foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").outputMode(mode)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out") if mode == "append" else spark.read.parquet(f"{at}/out")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "events")
    return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed once all events are in."""
    out = _finished(spark, s.hourly(_stream(spark, sf_dir)), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, "end", n FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed once all events are in."""
    out = _finished(spark, s.sessions(_stream(spark, sf_dir)), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, s.deduplicated(_stream(spark, sf_dir)).select("event_id", "user_id", "event_type"), "append")


@query("""WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value > 90 AS high FROM events),
h AS (SELECT user_id, k, max(CASE WHEN high THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS last FROM o)
SELECT user_id, count(*) AS n_events, count(*) FILTER (last IS NOT NULL AND k - last <= 3) AS n_held FROM h GROUP BY 1""")
def stream_held_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events held active for three events after one above 90; the last state of each user."""
    out = _finished(spark, s.held_activity(_stream(spark, sf_dir), 90.0, 3), "update")
    return out.groupBy("user_id").agg(F.max_by("n_events", "_batch").alias("n_events"), F.max_by("n_held", "_batch").alias("n_held"))


@query("""WITH l AS (SELECT event_id + 1 AS sequence FROM events), b AS (SELECT sequence, CAST(least(floor(3 * sequence / (SELECT max(sequence) + 1 FROM l)), 2) AS BIGINT) AS batch FROM l)
SELECT batch, true AS is_intact, count(*) AS n_entries, min(sequence) AS first, max(sequence) AS last FROM b GROUP BY 1""")
def stream_audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log of all events that arrives in three stretches, each verified from where the one before ended."""
    at = f"{shared_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    log = stored(enrolment.appended(audit(spark, sf_dir), "sequence", 0, GENESIS), "audit-log")
    top = log.agg(F.max("sequence") + 1).first()[0]
    third = F.least(F.floor(3 * F.col("sequence") / F.lit(top)), F.lit(2))
    for k in range(3):  # a stretch is a file, and one file is a batch
        log.where(third == k).coalesce(1).write.mode("append").parquet(f"{at}/log")
    incoming = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
    s.checked_audit(incoming, GENESIS, f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("batch").cast("long").alias("batch"), "is_intact", "n_entries", *[F.col(c).cast("long").alias(c) for c in ("first", "last")])
