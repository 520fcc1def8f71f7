"""Repair of conversations by aligning their turns with the grammar ``(s?(ua)+)?`` of role initials.

A Wagner-Fischer table holds what it costs to turn a conversation's last rows into the last characters of a target. All
targets end alike (``...uaua``; only an opening ``s`` differs, which no edit can make, so that it is a kept row after
deleted ones), hence one table serves every feasible length. A greedy repair gives the incumbent cost; by it the table is
no wider than Ukkonen's band around equal lengths of rows and target. Every target of least cost is traced back, taking
the ASCII-least edit at each cell, and the audits are compared.

The table is kept in stretches: a first pass stores a row of it for each stretch, and tracing back computes a stretch
anew, so that memory is the band's width times the root of the number of rows. A conversation's rows reach one task in
turn order and are held there one conversation at a time, as its audit and its hash are one value each.
"""

from __future__ import annotations

from functools import lru_cache, partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, small_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
#: Rows of the table that are computed anew at a time, at least.
STRETCH = 64
ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of each row; nulls in the key, role and text are one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _incumbent(initials: str, faults: str) -> int:
    """What a greedy repair costs above the edits that none can do without: deletions, and 1 for each truncated row."""
    over, want, turns, opened = 0, "u", 0, False
    for c, f in zip(initials, faults):
        if f == "x":
            continue
        if c == "s" and not opened and not turns:
            opened = True
            continue
        turns += 1
        over += 0 if c == want else INSERT if c in ROLES else REROLE
        if c == want or c not in ROLES:  # else the wanted turn is put before this one
            want = "a" if want == "u" else "u"
    return over + (INSERT if want == "a" else 2 * INSERT if opened and not turns else 0)


class _Table:
    """The banded table of one conversation: row i is for the rows from i on."""

    def __init__(self, initials: str, faults: str):
        self.n, self.initials = len(initials), initials
        self.forced = np.array([f == "x" for f in faults], bool)
        self.cut = [TRUNCATED * (f == "t") for f in faults]
        self.width = _incumbent(initials, faults) // 2
        self.left = np.r_[np.cumsum(~self.forced[::-1])[::-1], 0].astype(np.int64)
        r = np.arange(-self.width, self.width + 1)
        self.last = np.where(r >= 0, INSERT * r, NEVER)
        self.stretch = max(STRETCH, isqrt(self.n))

    def chars(self, i: int) -> np.ndarray:
        """Number of target characters left at each cell of row i."""
        return np.arange(self.left[i] - self.width, self.left[i] + self.width + 1)

    def row(self, i: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row i from the one after it, and the least edit at each cell."""
        r = self.chars(i)
        if self.forced[i]:
            drop, use = after + DELETE, np.full(len(r), NEVER)
        else:
            drop = np.r_[after[1:], NEVER] + DELETE
            use = after + self.cut[i] + np.where(np.where(r % 2 == 1, "a", "u") == self.initials[i], 0, REROLE)
        best = np.minimum(drop, use)
        best = np.minimum.accumulate(best - INSERT * r) + INSERT * r
        grown = np.r_[NEVER, best[:-1]] + INSERT
        edit = np.where(drop == best, "D", np.where(grown == best, "I", np.where(use - after == self.cut[i], "K", "R")))
        return best, edit

    def solve(self) -> tuple[int, str]:
        """Least cost, and the ASCII-least audit that has it."""
        marks, now, tried = {self.n: self.last}, self.last, []
        for i in range(self.n - 1, -1, -1):
            if self.initials[i] == "s" and not self.forced[i]:
                # an opening s is kept here, and what stands before it goes
                r = self.chars(i + 1)
                fits = np.where((r > 0) & (r % 2 == 0), now, NEVER)
                tried += [(int(fits[k]) + DELETE * i + self.cut[i], i + 1, int(r[k])) for k in np.flatnonzero((fits == fits.min()) & (fits < NEVER))]
            now = self.row(i, now)[0]
            if i % self.stretch == 0:
                marks[i] = now
        r = self.chars(0)
        fits = np.where((r >= 0) & (r % 2 == 0), now, NEVER)
        tried += [(int(fits[k]), 0, int(r[k])) for k in np.flatnonzero((fits == fits.min()) & (fits < NEVER))]
        cost = min(tried)[0]
        return cost, min(self.trace([(i, r) for c, i, r in tried if c == cost], marks))

    def trace(self, starts: list[tuple[int, int]], marks: dict[int, np.ndarray]) -> list[str]:
        """The audits of alignments that start at row i with r characters of the target left."""
        at = [[i, r, "D" * (i - 1) + "K" if i else ""] for i, r in starts]
        for begin in range(0, self.n, self.stretch):
            end = min(self.n, begin + self.stretch)
            now, edits = marks[end], {}
            for i in range(end - 1, begin - 1, -1):
                now, edits[i] = self.row(i, now)
            for one in at:
                i, r, done = one
                out = []
                while begin <= i < end:
                    out.append(edit := edits[i][r - self.left[i] + self.width])
                    i, r = i + (edit != "I"), r - (edit != "D")
                one[:] = i, r, done + "".join(out)
        return [done + "I" * r for _, r, done in at]


@lru_cache(4096)
def _short(initials: str, faults: str) -> tuple[int, str]:
    return _Table(initials, faults).solve()


def align(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; faults has x for rows that must go, t for truncated ones, else a dot."""
    return _short(initials, faults) if len(initials) <= 32 else _Table(initials, faults).solve()


def apply(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows that an audit makes of them."""
    out, it, want = [], iter(rows), "u"
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(it)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[want]
        out.append((role, text))
        want = "a" if role[:1] == "u" else "u"
    return out


def _repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Counts, cost, audit and repaired rows of one conversation: (turn, role, text) in order."""
    faults, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faults.append({"blank": "x", "duplicate": "x", "truncated": "t", None: "."}[fault])
    one = [role[:1] or "-" for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(one, one[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = align("".join(one), "".join(faults))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, apply([x[1:] for x in rows], audit)


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = [("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", _REPAIRED)]


def _conversations(it, batch_rows: int):
    """Rows sorted by conversation and turn -> a row for each conversation."""
    out: list[tuple] = []
    now, rows = None, []

    def packed():
        cols = list(zip(*out))
        cols[-1] = [[{"role": r, "text": t} for r, t in x] for x in cols[-1]]
        out.clear()
        return arrow_batch(**{n: pa.array(c, kind) for (n, kind), c in zip(_FIELDS, cols)})

    for batch in it:
        for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv,):
                if now:
                    out.append((*now, *_repair(rows)))
                now, rows = (conv,), []
            rows += [(turn, role, text)] * copies
        if len(out) >= batch_rows:
            yield packed()
    if now:
        out.append((*now, *_repair(rows)))
    if out:
        yield packed()


def repair(rows: DataFrame) -> DataFrame:
    """What each conversation of ``rows`` (conv_id, turn, role, text, and copies if there are any) needs, and its rows after that.

    Rows count in the order of turn, nulls first; rows of one turn in the order of role and text. Rows without a conv_id are
    one conversation. Conversations of which nothing is left have zeros and an empty audit.
    """
    small_batches(rows.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).alias("copies")
    rows = rows.select("conv_id", "turn", "role", "text", copies).repartition("conv_id").sortWithinPartitions(*order)
    return rows.mapInArrow(partial(_conversations, batch_rows=256), SCHEMA)


def digest(repaired: Column) -> Column:
    """SHA-256 of ``role:text`` of all rows, newline-joined."""
    return F.sha2(F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), 256)


def report(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, with the hash of the repaired rows in place of these."""
    return repair(damage(conversations)).withColumn("repaired_sha256", digest(F.col("repaired"))).drop("repaired")
