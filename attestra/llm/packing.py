"""Packing by minimum bin slack.

Documents are encoded where they lie and cut into whole windows and one rest each. The histogram of piece lengths (at
most ``capacity`` numbers) is all that the plan needs: the longest length left opens a window, a subset-sum table in
bitsets finds the multiset of remaining lengths that fills it closest to capacity, and the counts are read back from
the table. A pattern is used as often as the counts allow. The plan then goes to the pieces: each has a rank among
those of its length, and the plan's ranges of ranks say its sequence and offset. Ids are never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, checked_broadcast, saved, small_batches
from .tokens import encoder

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, place long"
PLAN = "length long, first_rank long, last_rank long, first_sequence long, each long, first_offset long"


def fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset of lengths, none oftener than counted, whose sum is closest to ``room`` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] += k
            at -= length * k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces) and how many sequences follow each."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = fill({k: n for k, n in left.items() if n > 0}, capacity - top)
        left[top] += 1
        pattern[top] += 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((dict(pattern), times))
    return out


def plan_rows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, used[length], used[length] + n * times - 1, sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return rows


def _pieces(it, path: str, capacity: int, end_id: int):
    shard, places, end = TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
    for batch in it:
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode([t or b"" for t in batch.column(1).to_pylist()])):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                length = min(capacity, n - start)
                rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, shard, places[length]))
                places[length] += 1
        if rows:
            cols = list(zip(*rows))
            names = [x.split()[0] for x in PIECES.split(", ")]
            types = [pa.int32() if n == "shard" else pa.int64() for n in names]
            yield arrow_batch(**{n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a tokenizer file that every executor has. A null or empty text is its end id alone; repeated rows are packed
    each by itself; null ids stay null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = saved(texts.mapInArrow(lambda it: _pieces(it, path, capacity, end_id), PIECES), "pieces")
    each = saved(pieces.groupBy("length", "shard").agg(F.count("*").alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = saved(each.select("length", "shard", before.alias("base")), "bases")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan_rows(counts, capacity)
    # a few rows for each pattern, and patterns use up lengths: bounded by the capacity, not by the documents
    table = F.broadcast(spark.createDataFrame(rows, PLAN)) if rows else spark.createDataFrame([], PLAN)
    ranked = pieces.join(checked_broadcast(base), ["length", "shard"]).withColumn("rank", F.col("place") + F.col("base")).alias("p")
    at = F.col("rank") - F.col("first_rank")
    inside = (F.col("p.length") == F.col("t.length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    return ranked.join(table.alias("t"), inside).select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("each") * F.col("p.length")).alias("offset"),
    )
