"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are ordered by a key of concatenated random-hyperplane signs, cut into blocks, and each block
is compared with itself and the next: a bounded window of neighbours. A run of one and the same key that is longer than
a window is compared block by block in whole, so that a dense group loses no pair for its size. A pair counts in the
first pass that brings it together, which each task sees from the blocks and keys of all passes that a row carries;
links are thus counted without gathering pairs. Equal vectors are one class with a multiplicity from the start.

The number of passes follows from the measured density. Rows of a key's first d bits that all lie in a row's own block
and its neighbours are all compared with it, so a pass misses a link at the threshold with probability 1 - agree^d at
most; d is measured for each row and pass. Rows whose passes together may miss more than ``MISS`` are dense, and dense
rows are compared with each other in whole. Passes are as many as make both together cheapest.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, batches, checked_broadcast, components, saved, small_batches

THRESHOLD = 0.9
BLOCK = 512
MISS = 0.002
LEAST_PASSES = 12
KEY_BITS = 24
#: Rows on either side when dense rows are compared in whole.
DENSE_BLOCK = 1024


def _agree(threshold: float) -> float:
    """Probability that two vectors at the threshold lie on one side of a hyperplane."""
    return 1 - math.acos(threshold) / math.pi


def passes_for(n: int, threshold: float, block: int) -> int:
    """Passes if the vectors were spread evenly; never fewer are made."""
    once = _agree(threshold) ** max(1.0, math.log2(max(2, n) / block))
    return max(LEAST_PASSES, math.ceil(math.log(MISS) / math.log(1 - once)))


def cheapest(needed: dict[int, int], least: int) -> int:
    """Passes, from the number of rows by the passes they need: a pass moves every row, its carried blocks and keys
    twice; rows that need more are moved once for each of their blocks."""
    n = sum(needed.values())

    def cost(p: int) -> float:
        dense = sum(rows for k, rows in needed.items() if k > p)
        return 2 * p * n * (1 + p / 64) + dense * math.ceil(dense / DENSE_BLOCK)

    return min(sorted({least, *(k for k in needed if k > least)}), key=cost)


def _classes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each vector; those that link with nothing have no class."""
    vecs, hashes = [], []
    for v in batch.column(1).to_pylist():
        vecs.append(None)
        hashes.append(None)
        if v is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        big = float(np.abs(x).max())
        if not np.isfinite(x).all() or big == 0:
            continue
        x = x / big  # norms of very large and very small vectors stay finite
        x /= np.linalg.norm(x)
        vecs[-1], hashes[-1] = x.tobytes(), xxhash.xxh3_128_digest(x.tobytes())
    return arrow_batch(vec_id=batch.column(0), cls=pa.array(hashes, pa.binary()), vec=pa.array(vecs, pa.binary()))


def _keys(batch: pa.RecordBatch, n_passes: int, seed: int) -> pa.RecordBatch:
    ids, vecs = batch.column(0).to_pylist(), [np.frombuffer(v) for v in batch.column(1).to_pylist()]
    out = np.zeros((len(ids), n_passes), np.int64)
    for dim in {len(v) for v in vecs}:
        at = [k for k, v in enumerate(vecs) if len(v) == dim]
        planes = np.random.default_rng([seed, dim]).standard_normal((dim, n_passes * KEY_BITS))
        bits = (np.stack([vecs[k] for k in at]) @ planes > 0).reshape(len(at), n_passes, KEY_BITS)
        # vectors of one length stand together
        out[at] = (dim << KEY_BITS) + bits @ (1 << np.arange(KEY_BITS - 1, -1, -1))
    n = len(ids)
    return arrow_batch(rep=pa.array(np.repeat(np.array(ids, np.int64), n_passes)), turn=pa.array(np.tile(np.arange(n_passes, dtype=np.int32), n)), sort_key=pa.array(out.ravel()))


def _number(it):
    """Rows ordered by (turn, key) -> the place of each inside this partition and turn."""
    part, turn, n = TaskContext.get().partitionId(), -1, 0
    for batch in it:
        turns = batch.column(1).to_numpy()
        index = np.arange(len(turns), dtype=np.int64)
        start = np.flatnonzero(np.r_[True, turns[1:] != turns[:-1]]) if len(turns) else index
        first = np.repeat(start, np.diff(np.r_[start, len(turns)]))
        index -= first
        if len(turns) and turns[0] == turn:
            index[: start[1] if len(start) > 1 else len(turns)] += n
        if len(turns):
            turn, n = turns[-1], index[-1] + 1
            yield arrow_batch(rep=batch.column(0), turn=batch.column(1), sort_key=batch.column(2), part=pa.array(np.full(len(turns), part, np.int32)), place=pa.array(index))


def _link(x: dict, y: dict, turn: int, threshold: float, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least the threshold that no earlier pass has compared; pairs of dense rows
    only where these are compared in whole (turn -1)."""
    a, b = np.nonzero(x["vec"] @ y["vec"].T >= threshold)
    take = x["dim"][a] == y["dim"][b]
    if inner:
        take &= a < b
    if turn >= 0:
        take &= ~(x["dense"][a] & y["dense"][b])
    a, b = a[take], b[take]
    for t in range(turn):
        if not len(a):
            break
        seen = (np.abs(x["block"][a, t] - y["block"][b, t]) <= 1) | (x["key"][a, t] == y["key"][b, t])
        a, b = a[~seen], b[~seen]
    return a, b


def _compare(it, threshold: float):
    """Rows sorted by group -> (a, b, null): links that span what is linked here; (a, null, n): links of a, counted."""
    held, group = [], None

    def side(rows: list) -> dict:
        width = max(len(r["vec"]) for r in held) // 8
        vec = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            v = np.frombuffer(r["vec"])
            vec[k, : len(v)] = v
        return {
            "vec": vec, "dim": np.array([len(r["vec"]) for r in rows]), "rep": np.array([r["rep"] for r in rows], np.int64),
            "n": np.array([r["copies"] for r in rows], np.int64), "block": np.array([r["blocks"] for r in rows]), "key": np.array([r["keys"] for r in rows]),
            "dense": np.array([r["dense"] for r in rows]),
        }

    def close():
        own, other = ([r for r in held if r["own"] == k] for k in (True, False))
        turn, within = held[0]["turn"], held[0]["within"]
        if not own:
            return None
        x = side(own)
        rep, n = x["rep"], x["n"]
        pairs = [_link(x, x, turn, threshold, True)] if within else []
        if other:
            y = side(other)
            a, b = _link(x, y, turn, threshold, False)
            pairs.append((a, b + len(own)))
            rep, n = np.r_[rep, y["rep"]], np.r_[n, y["n"]]
        a, b = (np.concatenate(z) for z in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
        if not len(a):
            return None
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        while True:  # least label over links, until nothing changes
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        got, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        return arrow_batch(
            a=pa.array(np.r_[rep[got], rep[tied]]),
            b=pa.array([None] * len(got) + rep[label[tied]].tolist(), pa.int64()),
            n=pa.array(links[got].tolist() + [None] * len(tied), pa.int64()),
        )

    for batch in it:
        for r in batch.to_pylist():
            if r["grp"] != group:
                if held and (out := close()) is not None:
                    yield out
                held, group = [], r["grp"]
            held.append(r)
    if held and (out := close()) is not None:
        yield out


def _placed(reps: DataFrame, n_passes: int, block: int, seed: int, parts: int) -> DataFrame:
    """rep, turn, sort_key, block: blocks numbered along each pass, over all partitions."""
    keys = reps.select("rep", "vec").mapInArrow(batches(partial(_keys, n_passes=n_passes, seed=seed)), "rep long, turn int, sort_key long")
    ordered = keys.repartitionByRange(parts, "turn", "sort_key").sortWithinPartitions("turn", "sort_key", "rep")
    placed = saved(ordered.mapInArrow(_number, "rep long, turn int, sort_key long, part int, place long"), "placed")
    sizes = placed.groupBy("turn", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("turn").orderBy("part")) - F.col("rows")
    placed = placed.join(checked_broadcast(saved(sizes.select("turn", "part", before.alias("before")), "before")), ["turn", "part"])
    return saved(placed.select("rep", "turn", "sort_key", F.floor((F.col("before") + F.col("place")) / block).cast("long").alias("block")), "blocks")


def _missed(placed: DataFrame, threshold: float) -> DataFrame:
    """rep, missed: logarithm of the probability at most that all passes together miss a link of the row at the threshold."""
    edges = placed.groupBy("turn", "block").agg(F.min("sort_key").alias("first"), F.max("sort_key").alias("last"))
    along = Window.partitionBy("turn").orderBy("block")
    edges = saved(edges.select("turn", "block", F.lag("last", 2).over(along).alias("low"), F.lead("first", 2).over(along).alias("high")), "edges")

    def common(edge: str) -> Column:
        """Leading key bits in common with a row beyond the neighbours; -1: none is there, or none of this length."""
        differ = F.col("sort_key").bitwiseXOR(F.col(edge))
        return F.coalesce(F.when(differ == 0, KEY_BITS).otherwise(F.greatest(KEY_BITS - F.length(F.bin(differ)), F.lit(-1))), F.lit(-1))

    # runs of one whole key are compared whatever their length
    bits = F.least(1 + F.greatest(common("low"), common("high")), F.lit(KEY_BITS))
    miss = F.log(F.greatest(1 - F.pow(F.lit(_agree(threshold)), bits), F.lit(1e-12)))
    return placed.join(checked_broadcast(edges), ["turn", "block"]).groupBy("rep").agg(F.sum(miss).alias("missed"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Every row counts as a vector of its own, also where rows repeat a vec_id; rows without an id are
    left out. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(vectors.mapInArrow(batches(_classes), "vec_id long, cls binary, vec binary"), "unit")
    unit = rows.where("cls is not null")
    one = unit.groupBy("cls").agg(F.min(F.struct("vec_id", "vec")).alias("first"), F.count("*").alias("copies"))
    reps = saved(one.select("cls", F.col("first.vec_id").alias("rep"), F.col("first.vec").alias("vec"), "copies"), "reps")
    names = None
    if not reps.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # unlike vectors of one vec_id: classes go by numbers in the order of their ids
        ordered = reps.repartitionByRange("rep", "cls").sortWithinPartitions("rep", "cls")
        reps = saved(ordered.withColumn("name", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()), "reps")
        names, reps = reps.select(F.col("rep").alias("component_id"), "name"), reps.drop("name")
    sample = _missed(_placed(reps, LEAST_PASSES, block, seed + 1, parts), threshold)
    needed = sample.groupBy(F.ceil(LEAST_PASSES * math.log(MISS) / F.col("missed")).cast("int").alias("k")).agg(F.count("*").alias("rows"))
    needed = {r["k"]: r["rows"] for r in needed.collect()}  # a row for each number of passes
    n_passes = cheapest(needed, passes_for(sum(needed.values()), threshold, block))
    placed = _placed(reps, n_passes, block, seed, parts)
    dense = saved(_missed(placed, threshold).where(F.col("missed") > math.log(MISS)).select("rep"), "dense")
    # runs of one key over more than two blocks
    runs = placed.groupBy("turn", "sort_key").agg(F.min("block").alias("run_first"), F.max("block").alias("run_last"))
    runs = saved(runs.where("run_last - run_first > 1"), "runs")
    turns = placed.join(checked_broadcast(runs, 100_000), ["turn", "sort_key"], "left")
    far = F.coalesce(F.filter(F.sequence("run_first", "run_last"), lambda j: F.abs(j - F.col("block")) > 1), F.expr("array()").cast("array<bigint>"))
    # a row's own block with itself, with the block before, and with the far blocks of its run
    group = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    here = F.col("block")
    groups = F.concat(
        F.array(group(here, here + 1)),
        F.when(here == 0, F.expr("array()").cast("array<struct<lo:bigint,hi:bigint>>")).otherwise(F.array(group(here - 1, here))),
        F.transform(far, lambda j: group(F.least(j, here), F.greatest(j, here))),
    )
    turns = turns.select("rep", "turn", "block", "sort_key", groups.alias("groups"))
    row = F.array_sort(F.collect_list(F.struct("turn", "block", "sort_key", "groups")))
    marked = reps.join(checked_broadcast(dense.withColumn("is_dense", F.lit(True))), "rep", "left").withColumn("dense", F.coalesce("is_dense", F.lit(False)))
    carried = turns.groupBy("rep").agg(row.alias("t")).join(marked, "rep")
    carried = carried.select("rep", "vec", "copies", "dense", F.col("t.block").alias("blocks"), F.col("t.sort_key").alias("keys"), F.explode("t").alias("now"))
    carried = carried.select("*", F.explode("now.groups").alias("g")).select(
        F.concat_ws(":", "now.turn", "g.lo", "g.hi").alias("grp"), F.col("now.turn").alias("turn"), (F.col("now.block") == F.col("g.lo")).alias("own"),
        (F.col("g.hi") - F.col("g.lo") == 1).alias("within"), "rep", "vec", "copies", "blocks", "keys", "dense",
    )
    # dense rows: each block with itself and every other
    n_blocks = math.ceil(dense.count() / DENSE_BLOCK)
    if n_blocks:
        whole = marked.where("dense").withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(n_blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        none = F.expr("array()").cast("array<bigint>")
        carried = carried.unionByName(whole.select(
            F.concat_ws(":", F.lit(-1), F.least("h", "j"), F.greatest("h", "j")).alias("grp"), F.lit(-1).alias("turn"), (F.col("h") <= F.col("j")).alias("own"),
            (F.col("h") == F.col("j")).alias("within"), "rep", "vec", "copies", none.alias("blocks"), none.alias("keys"), "dense",
        ))
    carried = carried.repartition(parts, "grp").sortWithinPartitions("grp")
    found = saved(carried.mapInArrow(lambda it: _compare(it, threshold), "a long, b long, n long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"), "links").withColumnRenamed("node", "rep")
    by_class = reps.select("cls", "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left")
    by_class = by_class.select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    if names is not None:
        by_class = by_class.join(names, "component_id").drop("component_id").withColumnRenamed("name", "component_id")
    linked = unit.select("vec_id", "cls").join(by_class, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
