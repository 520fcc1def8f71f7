"""Choices among rows and list entries: spans of a sequence, subsets of owners, prominent peaks, recordings of incidents, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import small
from .sampling import places


def in_span(place: Column, n: Column, start: float, end: float) -> Column:
    """Whether a place (from 0) of n lies in a part of the sequence, its start included and its end not."""
    if not 0 <= start < end <= 1:
        raise ValueError("a span must satisfy 0 <= start < end <= 1")
    return (place >= start * n) & (place < end * n)


def owner_subset(rows: DataFrame, owner: str, n: int) -> DataFrame:
    """All rows of n owners drawn by a hash of the owner, with relabelled: their numbers from 0 in the order of the owner.

    Rows without an owner are in no subset; fewer owners than n are all taken.
    """
    known = rows.where(F.col(owner).isNotNull())
    drawn = places(known.select(owner).distinct(), owner, F.lit(1)).where(F.col("place") < n).select(owner)
    # n rows
    numbered = drawn.select(owner, (F.row_number().over(Window.orderBy(owner)) - 1).cast("long").alias("relabelled"))
    return known.join(small(numbered), owner)


def prominent(peaks: Column, n: int, apart: float) -> Column:
    """Of array<struct<frequency, bandwidth>> the n sharpest that lie at least ``apart`` from every sharper one taken, by frequency.

    Equal bandwidths count in the order of frequency; entries without either number are passed over.
    """
    whole = F.filter(peaks, lambda p: p["frequency"].isNotNull() & p["bandwidth"].isNotNull())
    sharp = F.array_sort(F.transform(whole, lambda p: F.struct(p["bandwidth"].alias("bandwidth"), p["frequency"].alias("frequency"))))
    none = F.filter(sharp, lambda _: F.lit(False))
    free = lambda taken, p: (F.size(taken) < n) & ~F.exists(taken, lambda t: F.abs(t["frequency"] - p["frequency"]) < apart)
    taken = F.aggregate(sharp, none, lambda taken, p: F.when(free(taken, p), F.concat(taken, F.array(p))).otherwise(taken))
    return F.array_sort(F.transform(taken, lambda p: F.struct(p["frequency"].alias("frequency"), p["bandwidth"].alias("bandwidth"))))


def recording_of(incident: Column, recordings: Column) -> Column:
    """The entry of a non-empty list that an incident is heard as: by the number after the last hyphen of its id, around the list."""
    number = F.substring_index(incident, "-", -1).try_cast("long")
    return F.when(F.size(recordings) > 0, F.get(recordings, F.pmod(number, F.size(recordings)).cast("int")))


def modes(rows: DataFrame, mode: str, reference: str) -> DataFrame:
    """One row modes (sorted), is_single_mode, is_reference: results of different modes must not be pooled. Few modes are meant."""
    out = rows.agg(F.array_sort(F.collect_set(mode)).alias("modes"))
    return out.select("modes", (F.size("modes") == 1).alias("is_single_mode"), (F.col("modes") == F.array(F.lit(reference))).alias("is_reference"))


def weakened(score: Column, label: Column, gap: Column, discriminability: float) -> Column:
    """Same-source scores moved towards the different-source ones by a part of the gap between the means; spreads stay."""
    return F.when((label == 1) & F.lit(discriminability < 1), score - (1 - discriminability) * gap).otherwise(score)
