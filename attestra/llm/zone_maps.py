"""Nearest-centroid clustering over zone maps along a Hilbert curve.

Vectors are ordered by their place on a Hilbert curve and cut into blocks, each stored once with the least and greatest
value of every component. In a round, a block's box bounds the distance of all its vectors to each centroid from below
and above; only centroids whose lower bound does not exceed the least upper bound can be nearest to any of them, and
the block is compared with these alone, exactly, in whole numbers. A block with one such centroid adds its stored sum.
The centroids, and for each task one sum a cluster, are all that a round moves.

Vectors that are null or not of the asked length, or hold a null, a non-finite component or one of ``LARGEST`` or more (a
squared distance might not fit a long) are left out. Rows that repeat a vec_id have a result each; a null vec_id is
clustered, but never a start. With fewer vectors than clusters there are as many clusters as vectors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batch_rows, batches, saved

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
LARGEST = 2.0**19
#: Vectors in a block, and bits of each component on the curve.
BLOCK, BITS = 256, 4
#: Below this, products of 64 components are exact in doubles.
EXACT = 1 << 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of grid cells (values below 2^bits) -> rows of bytes that sort as their places on the Hilbert curve."""
    x = cells.astype(np.uint32).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for row in x:
            on = (row & q) > 0
            swap = np.where(on, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(on, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, np.uint32(q - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _places(batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    v = _matrix(batch.column(2), len(low))
    cells = (v - low) * (1 << BITS) // (high - low + 1)
    return arrow_batch(place=_binary(hilbert(cells, BITS)), row=batch.column(0), vec_id=batch.column(1), vec=_binary(v.astype(np.int32)))


def _blocks(it, size: int, dims: int):
    """Rows in the curve's order -> a row for each ``size`` of them: their ids, vectors, sum and box."""
    ids, vecs = [], []

    def block():
        v = np.frombuffer(b"".join(vecs), np.int32).reshape(-1, dims).astype(np.int64)
        out = arrow_batch(vec_ids=pa.array([list(ids)], pa.list_(pa.int64())), vecs=pa.array([b"".join(vecs)], pa.binary()), low=_binary(v.min(0)[None]), high=_binary(v.max(0)[None]), total=_binary(v.sum(0)[None]))
        ids.clear(), vecs.clear()
        return out

    for batch in it:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            vecs.append(v)
            if len(ids) == size:
                yield block()
    if ids:
        yield block()


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ascending; ties are kept."""
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest centroid, the first of equals; exact."""
    kind = np.float64 if max(np.abs(v).max(), np.abs(centroids).max()) < EXACT else np.int64
    a, c = v.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at].astype(np.int64)


def _boxes(batch: pa.RecordBatch, dims: int):
    names = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
    box = lambda b: np.frombuffer(b, np.int64)
    for k in range(batch.num_rows):
        v = np.frombuffer(names["vecs"][k], np.int32).reshape(-1, dims).astype(np.int64)
        yield v, box(names["low"][k]), box(names["high"][k]), box(names["total"][k]), names["vec_ids"][k] if "vec_ids" in names else None


def _sums(it, centroids: np.ndarray):
    """A row for each cluster of a task: number and sum of its vectors."""
    n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for batch in it:
        for v, low, high, total, _ in _boxes(batch, centroids.shape[1]):
            near = candidates(low, high, centroids)
            if len(near) == 1:
                n[near[0]] += len(v)
                sums[near[0]] += total
                continue
            at = near[nearest(v, centroids[near])[0]]
            for c in np.unique(at):
                n[c] += (own := at == c).sum()
                sums[c] += v[own].sum(0)
    used = np.flatnonzero(n)
    if len(used):
        yield arrow_batch(cluster=pa.array(used.astype(np.int32)), n=pa.array(n[used]), sums=pa.array(sums[used].tolist(), pa.list_(pa.int64())))


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> pa.RecordBatch:
    ids, cluster, distance = [], [], []
    for v, low, high, _, own in _boxes(batch, centroids.shape[1]):
        near = candidates(low, high, centroids)
        at, d = nearest(v, centroids[near])
        ids += own
        cluster.append(near[at])
        distance.append(d)
    return arrow_batch(vec_id=pa.array(ids, pa.int64()), cluster=pa.array(np.concatenate(cluster).astype(np.int32)), distance=pa.array(np.concatenate(distance)))


def whole(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """row, vec_id and v (whole numbers) of the vectors that are not left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < LARGEST, F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size(x) == dims) & fine)
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array of long) of each vector that is not left out.

    Starts are the vectors with the least SHA-256 of ``2:<vec_id>``. Sums that don't fit a long are null.
    """
    spark = vectors.sparkSession
    rows = saved(whole(vectors, dims), "curve-vectors")
    starts = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "v").select("v").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r[0] for r in starts], np.int64)
    box = rows.agg(*(f(F.get("v", F.lit(i))) for f in (F.min, F.max) for i in range(dims))).first()
    low, high = np.array(box[:dims], np.int64), np.array(box[dims:], np.int64)
    with batch_rows(spark, 4096):
        placed = rows.mapInArrow(batches(partial(_places, low=low, high=high)), "place binary, row long, vec_id long, vec binary")
        # equal vectors are many to a place: the row's number spreads them
        placed = placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row").select("vec_id", "vec")
        blocks = saved(placed.mapInArrow(partial(_blocks, size=block, dims=dims), "vec_ids array<long>, vecs binary, low binary, high binary, total binary"), "curve-blocks")
    with batch_rows(spark, 64):
        for _ in range(rounds):
            own = blocks.select("vecs", "low", "high", "total").mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, sums array<long>")
            sums = own.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")) for i in range(dims))).alias("sums"))
            centroids = centroids.copy()
            for r in sums.collect():  # a row a cluster
                centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
        out = saved(blocks.mapInArrow(batches(partial(_assigned, centroids=centroids)), "vec_id long, cluster int, distance long"), "curve-assigned")
    per = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    known = spark.createDataFrame([(c, fits(d), fits(sum(per.values())), centroids[c].tolist()) for c, d in per.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def report(vectors: DataFrame) -> DataFrame:
    """``cluster`` with the SHA-256 of each centroid's components, comma-joined, in place of the centroid."""
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return cluster(vectors).withColumn("centroid_sha256", digest).drop("centroid")
