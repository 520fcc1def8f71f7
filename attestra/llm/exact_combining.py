"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Three rounds find the row that stays of each text, and each compares the whole normalised text, not a digest alone: a task
combines the equal texts of its own rows, the tasks' winners meet by digest and salt, and the salts' winners meet by
digest. A text that a third of all rows hold thus reaches any task as one row for each task before it. The digest only
carries the outcome back to the rows. That two texts have one digest is seen in the last round; rows of such digests
find their group by digest and text. Groups of more than one row in ``SHARE`` are at most ``SHARE`` in number and go to
the rows by a broadcast; the rows of all other groups are few to a key and meet in a shuffle.

Null text counts as empty, and empty and blank texts are equal. A null doc_id loses to any other. Repeated rows (one
doc_id, equally long equal texts) get a result each, and exactly one of them stays if they win.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BLANKS = " \t\n\x0b\x0c\r"
#: Tasks among which the winners of one text are dealt before they meet.
SALTS = 64
#: Groups with more than one row in so many are broadcast; there are no more of them than this.
SHARE = 10_000


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, n_chars (code points as given), norm, sha and digest, a function of sha."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return d.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", digest(F.col("sha")))


def _combined(rows: DataFrame) -> DataFrame:
    """digest, norm, best and n of each different text: best is the greatest of (code points, least doc_id)."""
    best = F.struct("n_chars", F.bitwise_not("doc_id").alias("least"))
    local = rows.select("digest", "norm", best.alias("best"), (F.spark_partition_id() % SALTS).alias("salt"))
    salted = local.groupBy("digest", "norm", "salt").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def _tally(rows: DataFrame, *by: str) -> DataFrame:
    """Rows alike in all that decides, as one with their number."""
    return rows.groupBy("doc_id", "n_chars", "sha", *by).agg(F.count("*").alias("alike"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    ``digest`` makes the key of a text from the SHA-256 of what is compared; any will do, as texts are compared too.
    """
    rows = _rows(docs, digest)
    groups = saved(_combined(rows).groupBy("digest").agg(F.count("*").alias("texts"), F.max("best").alias("best"), F.sum("n").alias("n")), "exact-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    shared = groups.where("texts > 1").select("digest")
    single, seen = groups.where("texts = 1").select("digest", "best", "n"), rows
    if several := not shared.isEmpty():
        seen = rows.join(shared, "digest", "left_anti")
    keys = saved(_tally(seen).withColumn("digest", digest(F.col("sha"))), "exact-keys")
    large, rest = F.broadcast(single.where(F.col("n") * SHARE > total)), single.where(F.col("n") * SHARE <= total)
    out = keys.join(large, "digest").unionByName(keys.join(large, "digest", "left_anti").join(rest, "digest"))
    if several:
        alike = rows.join(shared, "digest", "left_semi")
        out = out.unionByName(_tally(alike, "digest", "norm").join(_combined(alike), ["digest", "norm"]).drop("norm"))
    keep = F.bitwise_not("best.least")
    wins = F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == F.col("best.n_chars"))
    out = out.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), wins.alias("wins"), F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("alike"))).alias("k"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("k") == 1)).alias("kept"), "text_sha256")
