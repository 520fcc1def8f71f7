"""Structured Streaming forms: late-tolerant window counts, sessions, held activity, audit tail.

Sessions over gaps are an extension; the rest mirrors batch operators on unbounded input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.governance import verify_chain

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """user_id, start, n, total of tumbling hours; rows later than ``late`` are dropped with their state."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def held_activity(events: DataFrame, above: float, reach: int, late: str = "2 hours") -> DataFrame:
    """user_id, n_events, n_held: events held active for ``reach`` events after one above a level; state is two numbers a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, n, held = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            left = reach + 1 if v > above else max(left - 1, 0)
            n, held = n + 1, held + (left > 0)
        state.update((left, n, held))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "n_held": [held]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n_events long, n_held long", "left long, n long, held long", "update", GroupStateTimeout.NoTimeout
    )


def checked_audit(log: DataFrame, genesis: str, out: str) -> DataStreamWriter:
    """A streaming query that writes the verdict of each arriving stretch of an audit log: verify_chain's columns, batch,
    first and last sequence and the last hash.

    Stretches arrive in order of sequence. A stretch follows the last hash of the stretch before it, which is read from
    what was written, so a restarted query goes on where it stopped; a stretch that does not start right after the one
    before is broken at its first entry. Only the first stretch of all follows ``genesis``, if it starts at 1; if it starts
    later its own first entry is trusted.
    """

    def check(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()
        ends = batch.agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.max_by("entry_hash", "sequence").alias("last_hash")).first()
        spark, before = batch.sparkSession, None
        try:
            before = spark.read.parquet(out).where(F.col("batch") < number).orderBy(F.desc("batch")).first()
        except AnalysisException:  # nothing is written yet
            pass
        if before is not None:
            follows = before["last_hash"] if ends["first"] == before["last"] + 1 else "missing"
            verdict = verify_chain(batch, follows, ends["first"])
        elif ends["first"] == 1:
            verdict = verify_chain(batch, genesis)
        else:
            head = batch.where(F.col("sequence") == ends["first"]).first()["entry_hash"]
            verdict = verify_chain(batch.where(F.col("sequence") > ends["first"]), head, ends["first"] + 1).withColumn("n_entries", F.col("n_entries") + 1)
        keys = {"batch": number, "first": ends["first"], "last": ends["last"], "last_hash": ends["last_hash"]}
        verdict.withColumns({k: F.lit(v) for k, v in keys.items()}).write.mode("append").parquet(out)
        batch.unpersist()

    return log.writeStream.foreachBatch(check)
