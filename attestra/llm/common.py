"""What the training-data operators share: inputs, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few dozen bytes that may be broadcast; above this a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: Rows an Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text as bytes (null: empty), plus columns asked for by name; others are pruned at the scan."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """``rows`` an Arrow batch for what is run inside; the session's own number afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; a folder of our own only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestra-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (it should be a saved table), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def batches(fn):
    """mapInArrow function from a function of one RecordBatch returning a RecordBatch or None."""

    def run(it):
        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def arrow_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Each round hooks every node of the contracted graph to its smallest neighbour, follows that pointer once more, and
    contracts the edges; nodes at least halve. All steps are joins and min-aggregations, so a hub is never gathered.
    """
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        hook = saved(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("p")), name)
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        hook = saved(hook.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p")), name)
        if labels is None:
            labels = hook.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(hook.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        e = e.join(hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a")
        e = e.join(hook.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b")
        e = e.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e, labels = saved(e, name), saved(labels, name)
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
