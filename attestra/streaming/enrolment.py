"""Enrolment of incidents as they arrive: each batch is one commit of incidents, evidence and audit entries.

A batch that was committed is passed over when it comes again after a failure. A stream whose extraction fails costs its
own evidence and a warning, not the batch. Audit entries go on where the log stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.governance import ROLES
from ..sources.store import Store
from ..sources.tables import stored

TABLES = {
    "incidents": "incident_id string, case_reference string, enrolled_by string, enrolled_at timestamp, warnings array<string>",
    "evidence": "evidence_id string, incident_id string, stream string, payload string",
    "audit": "sequence long, body string, entry_hash string",
}
KEYS = {"incidents": "incident_id", "evidence": "evidence_id", "audit": "sequence"}
GENESIS = hashlib.sha256(b"attestra-enrolment-1").hexdigest()
Extractor = Callable[[DataFrame], Column]


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, TABLES, KEYS)


def appended(bodies: DataFrame, order: str, sequence: int, previous: str) -> DataFrame:
    """sequence, body, entry_hash of entries (``order``, body) after the entry with that sequence and hash.

    A chain is sequential, so the entries of a batch are hashed in one task, as they stream by in order.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = sequence, previous
        for b in batches:
            hashes = []
            for body in b["body"]:
                before = hashlib.sha256((before + body).encode()).hexdigest()
                hashes.append(before)
            yield pd.DataFrame({"sequence": range(at + 1, at + 1 + len(b)), "body": b["body"], "entry_hash": hashes})
            at += len(b)

    return bodies.repartition(1).sortWithinPartitions(order).select("body").mapInPandas(chain, "sequence long, body string, entry_hash string")


def enrol(store: Store, batch: DataFrame, extractors: dict[str, Extractor], writer: str = "enrolment", number: int | None = None) -> dict[str, str]:
    """Enrol a batch (incident_id, case_reference, submitted_by, role, submitted_at and what extractors read).

    Returns the streams that failed with their errors. Incidents by a role that may not enrol, already enrolled ones, and
    further rows of an incident inside the batch are refused; each refusal is an audit entry. Rows without an
    incident_id are refused as well. An extractor's null is an absent stream.
    """
    with store.begin() as work:
        if number is not None and work.base["batches"].get(writer, -1) >= number:
            return {}
        batch = stored(batch.withColumn("_row", F.monotonically_increasing_id()), "enrolment-batch")
        may = F.broadcast(batch.sparkSession.createDataFrame([(r,) for r, a in ROLES.items() if a == "enrol"], "role string").withColumn("_may", F.lit(True)))
        known = work.read("incidents").select("incident_id", F.lit(True).alias("_known"))
        first = batch.groupBy("incident_id").agg(F.min("_row").alias("_first"))
        rows = batch.join(may, "role", "left").join(known, "incident_id", "left").join(first.withColumnRenamed("incident_id", "_id"), F.col("incident_id").eqNullSafe(F.col("_id")))
        outcome = F.when(F.col("incident_id").isNull(), "failed: no incident").when(F.col("_may").isNull(), "failed: not authorised").when(F.col("_known").isNotNull() | (F.col("_row") > F.col("_first")), "failed: already enrolled").otherwise("ok")
        rows = stored(rows.withColumn("outcome", outcome), "enrolment-outcomes")
        good = rows.where("outcome = 'ok'")
        evidence, failed = None, {}
        for stream, extract in extractors.items():
            try:
                own = good.select("incident_id", F.lit(stream).alias("stream"), extract(good).cast("string").alias("payload")).where("payload is not null")
                own = stored(own.select(F.concat_ws("/", "incident_id", "stream").alias("evidence_id"), "incident_id", "stream", "payload"), f"evidence-{stream}")
            except Exception as e:  # whatever an extractor raises costs its own stream only
                failed[stream] = type(e).__name__
                continue
            evidence = own if evidence is None else evidence.unionByName(own)
        warnings = F.array(*[F.lit(f"{s} evidence was not extracted: {e}") for s, e in failed.items()]).cast("array<string>")
        work.add("incidents", good.select("incident_id", "case_reference", F.col("submitted_by").alias("enrolled_by"), F.col("submitted_at").cast("timestamp").alias("enrolled_at"), warnings.alias("warnings")))
        streams = F.lit(None).cast("array<string>")
        entries = rows
        if evidence is not None:
            work.add("evidence", evidence)
            have = evidence.groupBy("incident_id").agg(F.array_sort(F.collect_set("stream")).alias("_streams"))  # a stream a name at most
            entries, streams = rows.join(have, "incident_id", "left"), F.col("_streams")
        body = F.to_json(F.struct(F.lit("enrol").alias("action"), F.col("submitted_by").alias("actor"), "case_reference", "incident_id", F.lit(len(failed)).alias("n_warnings"), "outcome", F.when(F.col("outcome") == "ok", F.coalesce(streams, F.array().cast("array<string>"))).alias("streams")))
        last = work.read("audit").agg(F.max(F.struct("sequence", "entry_hash")).alias("x")).first()["x"]
        at = (last["sequence"], last["entry_hash"]) if last else (0, GENESIS)
        work.add("audit", stored(appended(entries.select("_row", body.alias("body")), "_row", *at), "enrolment-audit"))
        work.commit(writer, number)
    return failed


def enrolling(incoming: DataFrame, store: Store, extractors: dict[str, Extractor], writer: str = "enrolment") -> DataStreamWriter:
    """A streaming query that enrols what arrives, each batch once."""
    return incoming.writeStream.foreachBatch(lambda batch, number: enrol(store, batch, extractors, writer, number) and None)
