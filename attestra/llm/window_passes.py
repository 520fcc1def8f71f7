"""Equal windows across all documents: the passes that the two substring operators share.

A window is ``length`` units (bytes or words) of one document. Its anchor is the least-hashed core among the cores that
start in its first ``length - core + 1`` units, so equal windows have equal anchors at equal places, and neighbouring
windows share one. A digit pass counts the cores: windows whose core occurs once are alone and end there. The windows
of one anchor make a hull; equal hulls are one class from here on, so that a core with any number of copies is counted
before it is shuffled. What is left are cores with several different hulls, the edges of repeats: one hull of each
class goes to the shard of its core, whose block function (an index, a radix sort) settles it window by window.

A core with very many hulls is too much for one block and takes further digit passes. A pass deals a hull's windows to
``SPLIT`` parts by the place of the core in them. All windows of a part reach some way beyond the core on both sides,
so what they share is a longer core, and only as many units as a part has places are left outside it. Parts alone
with their core end there, equal parts are one class, and cores with few parts go to the blocks with all others; what is
still too much is split again, until a core is a whole window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batches, documents, saved, small_batches, texts_of

_U = np.uint64
#: Hulls of one core above which it takes further passes, the parts of a hull in such a pass, and hulls in one block.
HOT_HULLS = 512
SPLIT = 4
BLOCK_HULLS = 4096
KEYS = "key long"
ANCHORS = "doc_id long, key long, hull1 long, hull2 long, lo long, n_windows long, times long"
SEGMENTS = "key long, doc_id long, lo long, n_windows long, copies boolean, units binary, digest binary, lead long, core long"
MARKS = "doc_id long, lo long, n_windows long"


@dataclass(frozen=True)
class Windows:
    """length and core in units; units: text -> array; gram: array -> order of the cores (64 bits) that start at each unit."""

    length: int
    core: int
    units: Callable[[bytes], np.ndarray]
    order: Callable[[np.ndarray], np.ndarray]
    #: of two marks, does the earlier stay (words) or do both go (bytes)
    keep_first: bool

    @property
    def reach(self) -> int:
        return self.length - self.core + 1


def anchors(units: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of a document, in order; empty if it is shorter than a window."""
    n = len(units) - w.length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = (w.order(units) & _U(0xFFFFFFFF00000000)) | np.arange(len(units) - w.core + 1, dtype=np.uint64)
    span = 1
    while span < w.reach:  # least of ``span`` neighbours, doubled; the leftmost of equals
        step = min(span, w.reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least[:n] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], n] - 1


def _anchor_rows(batch: pa.RecordBatch, w: Windows, whole: bool) -> pa.RecordBatch:
    """Rows of ANCHORS, or keys only. Equal hulls one after another in a document are one row with ``times``."""
    digest, key_of = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    docs, keys, hulls, los, counts, times = [], [], [], [], [], []
    for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
        units = w.units(text)
        at, lo, hi = anchors(units, w)
        if not len(at):
            continue
        data, size = memoryview(units.tobytes()), units.itemsize
        key = np.fromiter((key_of(data[a * size : (a + w.core) * size]) for a in at.tolist()), np.uint64, len(at))
        off, n = at - lo, hi - lo + 1
        # the same core at the same place again, next to the last: a run of one unit, line or word
        new = np.r_[True, (key[1:] != key[:-1]) | (off[1:] != off[:-1]) | (n[1:] != n[:-1])]
        if not new.all():
            for k in np.flatnonzero(~new).tolist():  # such neighbours may still differ outside the core
                i, j, m = int(lo[k - 1]) * size, int(lo[k]) * size, int(n[k] + w.length - 1) * size
                new[k] = data[i : i + m] != data[j : j + m]
        first = np.flatnonzero(new)
        run = np.diff(np.r_[first, len(at)])
        # a run of equal neighbours counts as several
        keys.append(np.repeat(key[first], np.minimum(run, 2)) if not whole else key[first])
        if whole:
            lo, n, off = lo[first], n[first], off[first]
            hulls += [digest(data[s * size : (s + k + w.length - 1) * size], o << 32 | k) for s, k, o in zip(lo.tolist(), n.tolist(), off.tolist())]
            docs.append(np.full(len(first), doc_id))
            los.append(lo)
            counts.append(n)
            times.append(run)
    cat = lambda x, t=np.int64: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
    key = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
    if not whole:
        return arrow_batch(key=key)
    hull = np.frombuffer(b"".join(hulls), np.int64).reshape(-1, 2)
    return arrow_batch(doc_id=cat(docs), key=key, hull1=pa.array(hull[:, 0].copy()), hull2=pa.array(hull[:, 1].copy()), lo=cat(los), n_windows=cat(counts), times=cat(times))


def _segment_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 9
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return arrow_batch(**{n.split()[0]: pa.array(c, t) for n, c, t in zip(SEGMENTS.split(", "), cols, types)})


def _split(key: int, doc_id: int, lo: int, n: int, copies: bool, units: memoryview, size: int, lead: int, core: int, length: int) -> list[tuple]:
    """The parts of a hull as rows of SEGMENTS; units: its units, of ``size`` bytes each; lead: units before its core."""
    rows, places = [], length - core + 1
    step = -(-places // SPLIT)
    for o in range(0, places, step):
        top = min(o + step, places) - 1  # windows with o to ``top`` units before the core
        p, q = max(0, lead - top), min(n - 1, lead - o)
        if p > q:
            continue
        wide = length - (top - o)
        part = bytes(units[p * size : (q + length) * size])
        shared = units[(lead - o) * size : (lead - o + wide) * size]
        of = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + o.to_bytes(4, "little") + bytes(shared))
        digest = xxhash.xxh3_128_digest((lead - o - p).to_bytes(4, "little") + part)
        rows.append((of - (1 << 63), doc_id, lo + p, q - p + 1, copies, part, digest, lead - o - p, wide))
    return rows


def _segments(batch: pa.RecordBatch, w: Windows) -> pa.RecordBatch:
    """Hulls as rows with their units; hulls of a hot core in parts, with a digest."""
    rows = []
    for doc_id, text, hulls in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
        units = w.units(text)
        data, size = memoryview(units.tobytes()), units.itemsize
        place = dict(zip(*(x.tolist() for x in anchors(units, w)[1::-1]))) if any(h["hot"] for h in hulls) else {}
        for h in hulls:
            lo, n = h["lo"], h["n_windows"]
            of = data[lo * size : (lo + n + w.length - 1) * size]
            if h["hot"]:
                rows += _split(h["key"], doc_id, lo, n, h["copies"], of, size, place[lo] - lo, w.core, w.length)
            else:
                rows.append((h["key"], doc_id, lo, n, h["copies"], bytes(of), None, None, None))
    return _segment_rows(rows)


def _again(batch: pa.RecordBatch, w: Windows) -> pa.RecordBatch:
    """Parts of a core that is still hot, in parts."""
    size, rows = w.units(b"").itemsize, []
    for key, doc_id, lo, n, copies, units, _, lead, core in zip(*(batch.column(i).to_pylist() for i in range(9))):
        rows += _split(key, doc_id, lo, n, copies, memoryview(units), size, lead, core, w.length)
    return _segment_rows(rows)


def _blocks(it, settle, block_hulls: int):
    """Segments sorted by key -> marks. A block ends between two keys; a key has at most HOT_HULLS hulls."""
    rows, key = [], None

    def close():
        out = settle(rows)
        cols = list(zip(*out)) or [(), (), ()]
        return arrow_batch(**{n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "lo", "n_windows"), cols)})

    for batch in it:
        for r in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if r[0] != key and len(rows) >= block_hulls:
                yield close()
                rows = []
            key = r[0]
            rows.append(r)
    if rows:
        yield close()


def ranges(doc: np.ndarray, lo: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of hit windows (of one segment after another, in order) as (doc_id, first window, windows)."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(doc[at]) != 0) | (np.diff(lo[at]) != 1)])
    n = np.diff(np.r_[new, len(at)])
    return list(zip(doc[at[new]].tolist(), lo[at[new]].tolist(), n.tolist()))


def marks(docs: DataFrame, w: Windows, settle, name: str) -> DataFrame:
    """(doc_id, lo, n_windows): runs of windows that are repeats; ids are unique. settle: rows of a block -> such runs.

    All joins shuffle unless Spark finds a side below its own broadcast threshold. They hash the side whose keys are
    unique, which is small in each partition, so the other side, texts among it, is neither sorted nor kept.
    """
    spark = docs.sparkSession
    hull_of = ["key", "hull1", "hull2"]
    keys = docs.mapInArrow(batches(partial(_anchor_rows, w=w, whole=False)), KEYS)
    keys = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), name)
    found = docs.mapInArrow(batches(partial(_anchor_rows, w=w, whole=True)), ANCHORS)
    found = saved(found.join(keys.hint("shuffle_hash"), "key"), name)
    place = F.struct("doc_id", "lo")
    hull = found.groupBy(*hull_of).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("times").alias("times"), F.first("n_windows").alias("n_windows"))
    hull = saved(hull.select(*hull_of, "first", "n_windows", ((F.col("first") < F.col("last")) | (F.col("times") > 1)).alias("copies")), name)
    # classes with copies: all members are marked, but for the first where that stays
    members = found.join(hull.where("copies").select(*hull_of, "first").hint("shuffle_hash"), hull_of)
    n = F.col("n_windows")
    if w.keep_first:
        is_first = place == F.col("first")
        members = members.where(~is_first | (F.col("times") > 1))
        plain = members.select("doc_id", F.when(is_first, F.col("lo") + n).otherwise(F.col("lo")).alias("lo"), (n * (F.col("times") - F.when(is_first, 1).otherwise(0))).alias("n_windows"))
    else:
        plain = members.select("doc_id", "lo", (n * F.col("times")).alias("n_windows"))
    # cores with several hulls: one hull of each class is settled by its units
    several = saved(hull.groupBy("key").agg(F.count("*").alias("hulls")).where("hulls > 1"), name)
    edge = hull.join(several.hint("shuffle_hash"), "key")
    one = F.struct(F.col("first.lo").alias("lo"), "key", "n_windows", "copies", (F.col("hulls") > HOT_HULLS).alias("hot"))
    edge = saved(edge.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(one).alias("hulls")), name)
    joined = docs.join(edge.hint("shuffle_hash"), "doc_id")
    segments = saved(joined.mapInArrow(batches(partial(_segments, w=w)), SEGMENTS), name)
    cold, out, names = segments.where("digest is null"), [plain], segments.columns
    parts = segments.where("digest is not null")
    while not parts.isEmpty():
        again, parts = _pass(parts, w, name)
        out.append(again)
        cold = cold.unionByName(parts.where("not hot").select(*names))
        parts = saved(parts.where("hot").select(*names).mapInArrow(batches(partial(_again, w=w)), SEGMENTS), name)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = cold.select(*names[:6]).repartition(n_parts, "key").sortWithinPartitions("key", "doc_id", "lo")
    out.append(saved(cold.mapInArrow(lambda it: _blocks(it, settle, BLOCK_HULLS), MARKS), name))
    return reduce(DataFrame.unionByName, out)


def _pass(parts: DataFrame, w: Windows, name: str) -> tuple[DataFrame, DataFrame]:
    """A digit pass over parts of hot cores: (runs that are repeats, one part of each class whose core has several)."""
    place = F.struct("doc_id", "lo")
    rest = ["n_windows", "units", "lead", "core"]
    groups = parts.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "lo", *rest)).alias("first"), F.max(place).alias("last"), F.max("copies").alias("copies"))
    many = F.struct("first.doc_id", "first.lo") < F.col("last")
    one = saved(groups.select("key", "digest", "first.*", (many | F.col("copies")).alias("copies"), many.alias("many")), name)
    firsts = one.where("many").select("key", "digest", place.alias("first"))
    again = parts.select("key", "digest", "doc_id", "lo", "n_windows").join(firsts.hint("shuffle_hash"), ["key", "digest"])
    if w.keep_first:
        again = again.where(place != F.col("first"))
    several = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    left = one.drop("many").join(several.hint("shuffle_hash"), "key").withColumn("hot", F.col("n") > HOT_HULLS)
    return again.select("doc_id", "lo", "n_windows"), saved(left, name)


def with_marks(docs: DataFrame, marked: DataFrame, cut, schema: str, name: str) -> DataFrame:
    """cut(text, sorted runs) for every document; runs: list of dicts lo, n_windows."""
    runs = saved(marked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n_windows")).alias("runs")), name)
    joined = docs.join(runs.hint("shuffle_hash"), "doc_id", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [cut(i, t, r or []) for i, t, r in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_pylist(rows)

    return joined.select("doc_id", "text", "runs").mapInArrow(batches(run), schema)


def covered(n_units: int, runs: list[dict], length: int) -> np.ndarray:
    """Which units lie in a marked window."""
    edge = np.zeros(n_units + 1, np.int32)
    for r in runs:
        edge[min(r["lo"], n_units)] += 1
        edge[min(r["lo"] + r["n_windows"] + length - 1, n_units)] -= 1
    return np.cumsum(edge[:-1]) > 0


def prepared(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return documents(docs).where("doc_id is not null")


def for_each_text(docs: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """run(doc_id, text), which needs ids that are unique, for every row of ``docs``.

    Where ids repeat, each different text of an id becomes a document with a key of its own. Keys are in the order of the
    id, then of the text's digest; rows alike in both share one.
    """
    rows = prepared(docs)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return run(rows)
    own = ["doc_id", "_text"]
    rows = rows.withColumn("_text", F.sha2("text", 256))
    order = rows.select(*own).distinct().repartitionByRange(*own).sortWithinPartitions(*own)
    keys = saved(order.withColumn("_key", F.monotonically_increasing_id()), name)
    unique = saved(rows.dropDuplicates(own).join(keys, own).select(F.col("_key").alias("doc_id"), "text"), name)
    found = run(unique).withColumnRenamed("doc_id", "_key")
    return rows.select(*own).join(keys, own).join(found, "_key").drop("_key", "_text")
