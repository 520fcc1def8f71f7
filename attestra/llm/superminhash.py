"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Documents with one and the same shingle set are one class from the start. Classes that share a band form candidate
clusters; a cluster is compared inside blocks of bounded size, and a large one block against block, so that no task
holds more than two blocks. A large cluster that is only chained together, class by class, is compared band by band
instead wherever that moves fewer texts; both ways compare all pairs that share a band. A class pair that shares a band is compared on its full sets; links that do not connect
anything new need not be looked at, so that only a spanning forest leaves a task. Components follow by repeated
contraction (``common.components``), over all links of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batches, checked_broadcast, components, documents, saved, small_batches, texts_of

SHINGLE = 5
#: Bands and rows a band. A pair at similarity 0.85 misses all bands with probability (1 - 0.85^4)^24, below 3e-8; at 0.8 it is below 4e-6.
BANDS, ROWS = 24, 4
#: Classes in one block.
BLOCK = 128
_C = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's word shingles; A-Z lower-cased, words parted by ASCII space.

    Fewer words than ``size``: one shingle, the whole sequence. No words: none.
    """
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(size, len(ws))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _C + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signature of every set, as integers 2^32 * step + random; rows of empty sets are all ones.

    At step j an element puts j + r_j at place p_j of its own random permutation. The permutations are drawn place by
    place, for all elements at once, and a document leaves as soon as no place of it holds a value above step j.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    doc = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    picks: list[np.ndarray] = []
    for j in range(m):
        if not len(x):
            break
        r = _mix(x + _U((j + 1) * int(_C) % 2**64))
        place = (j + ((r & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32))).astype(np.int16)
        picks.append(place)
        # which item earlier swaps have brought to that place
        at = place
        for i in range(j - 1, -1, -1):
            at = np.where(at == picks[i], np.int16(i), at)
        np.minimum.at(flat, doc * m + at, (_U(j) << _U(32)) | (r >> _U(32)))
        # a later step only puts values of at least 2^32 * (j + 1)
        open_ = (out >= (_U(j + 1) << _U(32))).any(axis=1)
        keep = open_[doc]
        doc, x, picks = doc[keep], x[keep], [p[keep] for p in picks]
    return out


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), n_bands), np.uint64)
    for b in range(n_bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for i in range(rows):
            h = _mix(h * _C + sig[:, b * rows + i])
        out[:, b] = h
    return out


def _sketch(batch: pa.RecordBatch, size: int, n_bands: int, rows: int) -> pa.RecordBatch:
    sets = [shingles(t, size) for t in texts_of(batch)]
    keys = bands(signatures(sets, n_bands * rows), n_bands, rows).view(np.int64)
    offsets = pa.array(np.arange(0, len(sets) * n_bands + 1, n_bands, dtype=np.int32))
    return arrow_batch(
        doc_id=batch.column(0),
        n_shingles=pa.array([len(s) for s in sets], pa.int64()),
        set_hash=pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
        bands=pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
    )


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: a product of the membership matrix, in slices of its columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    take = shared[col]
    owner, col = owner[take], number[col[take]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((len(sets), len(sets)))
    step = 8192
    for c in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(col, [c, c + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], col[lo:hi] - c] = 1
        out += m @ m.T
    return out


def links_of(sets: list[np.ndarray], keys: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) among sets that share a band.

    side: if given, only sets of different sides need comparing.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], float)
    share = np.zeros((n, n), bool)
    for b in range(keys.shape[1]):
        share |= keys[:, b, None] == keys[None, :, b]
    if side is not None:
        share &= side[:, None] != side[None, :]
    share &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    a, b = np.nonzero(np.triu(share, 1))
    if not len(a):
        return []
    if n <= 8:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], float)
    else:
        both = _common(sets)[a, b]
    ok = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    forest = _Forest(n)
    return [(int(i), int(j)) for i, j in zip(a[ok], b[ok]) if forest.union(int(i), int(j))]


def _verify(it, size: int, percent: int):
    """Batches sorted by group -> links (a, b). A group's rows are kept until it ends; a group is two blocks at most."""
    held, key, out = [], None, []

    def close():
        if len(held) > 1:
            held.sort(key=lambda r: r[0])
            side = np.array([r[3] for r in held])
            found = links_of([shingles(r[1], size) for r in held], np.array([r[2] for r in held], np.int64), percent, side if len(set(side)) > 1 else None)
            out.extend((held[i][0], held[j][0]) for i, j in found)

    def flush():
        cols = list(zip(*out)) or [(), ()]
        return arrow_batch(a=pa.array(cols[0], pa.int64()), b=pa.array(cols[1], pa.int64()))

    for batch in it:
        for group, doc_id, block, keys, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if group != key:
                close()
                held, key = [], group
            held.append((doc_id, text, keys, block))
        if out:
            yield flush()
            out = []
    close()
    if out:
        yield flush()


def _places(member: DataFrame, block: int) -> DataFrame:
    """node, bands, places: where each class is compared, as (of, blocks, block) of its cluster or of each of its bands."""
    whole = member.groupBy("root").agg(F.count("*").alias("n"))
    copies = lambda n: F.col(n) * F.ceil(F.col(n) / block)
    # texts moved by the bands of clusters of more than one block
    large = saved(whole.where(F.col("n") > block), "large")
    in_band = member.join(large, "root").select("node", "root", "n", F.explode("bands").alias("band"))
    band = saved(in_band.groupBy("root", "band").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m > 1"), "bands")
    chained = saved(band.groupBy("root").agg(F.sum(copies("m")).alias("moved"), F.first("n").alias("n")).where(F.col("moved") < copies("n")).select("root"), "chained")
    block_of = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    clusters = member.join(chained, "root", "left_anti").join(whole, "root").select("node", F.col("root").cast("string").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    apart = in_band.join(chained, "root", "left_semi").join(band.select("root", "band", "m"), ["root", "band"])
    apart = apart.select("node", F.concat_ws(":", "root", "band").alias("of"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    at = clusters.unionByName(apart).select("node", F.struct("of", "blocks", block_of).alias("at"))
    return member.select("node", "bands").join(at.groupBy("node").agg(F.collect_list("at").alias("places")), "node")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Null, empty and wordless texts have no shingles and stay alone. Repeated rows of one doc_id count as copies of each
    other; documents without an id are left out. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = documents(docs).where("doc_id is not null")
    sketch = batches(lambda b: _sketch(b, size, n_bands, rows))
    sets = saved(docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "sets")
    first = sets.where("set_hash is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = saved(first.select("set_hash", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")), "classes")
    in_band = classes.select("rep", F.explode("bands").alias("band"))
    lead = in_band.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    near = components(in_band.join(lead, "band").select(F.col("rep").alias("a"), F.col("lead").alias("b")), "candidates")
    # clusters of candidates, or their bands, in blocks
    member = saved(near.join(classes.withColumnRenamed("rep", "node"), "node").select("node", "root", "bands"), "members")
    # ids are few bytes each and go to the tasks up to a bound, so that other documents' texts are not moved
    text = docs.withColumnRenamed("doc_id", "node").join(checked_broadcast(member.select("node")), "node", "left_semi")
    text = text.join(saved(_places(member, block), "places").hint("shuffle_hash"), "node")
    text = text.select("node", "text", "bands", F.explode("places").alias("at")).select("node", "text", "bands", "at.*")
    text = text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.concat_ws(":", "of", F.least("block", "other"), F.greatest("block", "other")).alias("group")
    text = text.select(group, "node", "block", "bands", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text.repartition(parts, "group").sortWithinPartitions("group")
    links = components(text.mapInArrow(lambda it: _verify(it, size, percent), "a long, b long"), "links")
    roots = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("root", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "set_hash").join(roots, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
