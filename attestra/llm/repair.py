"""Token ids in a binary format, compressed by a Re-Pair grammar for each shard.

The documents are ordered by id over range partitions; each partition writes blocks of about ``BLOCK_IDS`` ids. In a
block all pairs of neighbouring symbols are counted, and those used ``LEAST_USES`` times or more become nonterminals, of
pairs that overlap the more frequent one; the next pass counts the new symbols. Passes end when no pair is frequent
enough, when 16-bit symbols are used up, or after a pass that shortened the block by less than 1 in ``LEAST_GAIN``.
A block holds the rules with the lengths they expand to, the remaining symbols and the documents' ends, so that any
document is decoded alone: running sums of expansion lengths find its symbols.

Block layout (little-endian): "RPG2"; u32 documents, ids, alphabet, rules, passes, symbols, symbol bytes (2 or 4);
i64 document ids; u32 document ends; u32 ids of the alphabet; u32 rules of each pass; u32 expansion length of each rule;
left and right symbol of each rule, then the symbols. Symbols below the alphabet's size stand for its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, checked_broadcast, saved, small_batches
from .tokens import encoder

END_ID = 2
BLOCK_IDS = 1 << 20
#: Uses a rule must have to pay for itself; the last pass saves less than one id in so many.
LEAST_USES, LEAST_GAIN = 6, 64
_HASH_BITS = 20


def _frequent(seq: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times or more (overlaps counted): (pair, uses, and the places of all uses, pair by pair).

    Buckets of pairs are counted first; only pairs in frequent buckets are sorted and counted themselves.
    """
    a, b = seq[:-1], seq[1:]
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - _HASH_BITS)
    inside = ~last[:-1]
    often = np.bincount(bucket[inside], minlength=1 << _HASH_BITS) >= least
    at = np.flatnonzero(often[bucket] & inside)
    if not len(at):
        return np.zeros((0, 2), np.uint32), at, at
    a, b = a[at], b[at]
    if seq.max() < 1 << 16 and len(seq) < 1 << 32:  # pair and place in one number: the faster sort
        packed = np.sort((a.astype(np.uint64) << np.uint64(48)) | (b.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
        key, at = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    else:
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        order = np.argsort(key)
        key, at = key[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    uses = np.diff(np.concatenate([head, [len(key)]]))
    ok = uses >= least
    first = at[head[ok]]
    return np.column_stack([seq[first], seq[first + 1]]), uses[ok], at[np.repeat(ok, uses)]


def _apart(at: np.ndarray, rule: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Which of the uses (in order of place) are replaced: of neighbours that overlap, the pair with more uses, the left
    one of equals; in a run of one pair every other one."""
    touch = np.diff(at) == 1
    begin = np.concatenate([[True], ~touch | (rule[1:] != rule[:-1])])
    start = np.flatnonzero(begin)
    keep = (np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))) & 1 == 0
    weight = np.where(keep, uses[rule], 0)
    good = keep.copy()
    good[1:] &= ~(touch & (weight[1:] <= weight[:-1]))
    good[:-1] &= ~(touch & (weight[:-1] < weight[1:]))
    return good


def compress(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, least: int = LEAST_USES) -> bytes:
    """A block of the documents whose ids end at ``ends``; pairs never cross a document's end."""
    present = np.bincount(ids) > 0 if len(ids) and ids.max() < 1 << 24 else None
    if present is not None:
        alphabet = np.flatnonzero(present).astype(np.uint32)
        seq = (np.cumsum(present) - 1).astype(np.uint32)[ids]
    else:
        alphabet, seq = np.unique(ids.astype(np.uint32), return_inverse=True)
        seq = seq.astype(np.uint32)
    n_symbols = len(alphabet)
    limit = 1 << 16 if n_symbols <= 1 << 16 else 1 << 32  # symbols stay in as many bytes as the alphabet needs
    length = np.ones(n_symbols, np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules, passes = [np.zeros((0, 2), np.uint32)], []
    while n_symbols < limit and len(seq) > 1:
        pair, uses, at = _frequent(seq, last, least)
        if not len(pair):
            break
        if len(pair) > limit - n_symbols:  # the most frequent ones that there are symbols for
            take = np.zeros(len(pair), bool)
            take[np.argpartition(uses, n_symbols - limit)[n_symbols - limit :]] = True
            at, pair, uses = at[np.repeat(take, uses)], pair[take], uses[take]
        rule_at = np.full(len(seq), -1, np.int32)
        rule_at[at] = np.repeat(np.arange(len(pair), dtype=np.int32), uses)
        at = np.flatnonzero(rule_at >= 0)
        rule = rule_at[at]
        good = _apart(at, rule, uses)
        at, rule = at[good], rule[good]
        used = np.bincount(rule, minlength=len(pair)) >= least
        if not used.any():
            break
        good = used[rule]
        at, rule, pair = at[good], rule[good], pair[used]
        seq[at] = n_symbols + (np.cumsum(used) - 1)[rule]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(pair)
        passes.append(len(pair))
        length = np.concatenate([length, length[pair[:, 0]] + length[pair[:, 1]]])
        n_symbols += len(pair)
        if len(at) * LEAST_GAIN < len(ids):
            break
    table = np.concatenate(rules)
    width = 2 if limit == 1 << 16 else 4
    head = struct.pack("<4s7I", b"RPG2", len(doc_ids), len(ids), len(alphabet), len(table), len(passes), len(seq), width)
    parts = (doc_ids.astype("<i8"), ends.astype("<u4"), alphabet.astype("<u4"), np.array(passes, "<u4"), length[len(alphabet) :].astype("<u4"), table.astype(f"<u{width}"), seq.astype(f"<u{width}"))
    return b"".join([head, *(x.tobytes() for x in parts)])


class Block:
    """Random access to a block's documents."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, n_alphabet, n_rules, n_passes, n_seq, width = struct.unpack_from("<4s7I", data)
        if magic != b"RPG2":
            raise ValueError("not a block")
        at = struct.calcsize("<4s7I")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.ends, self.alphabet = take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_alphabet)
        self.passes, self.grown = take("<u4", n_passes), take("<u4", n_rules)
        self.rules, self.seq = take(f"<u{width}", 2 * n_rules).reshape(-1, 2), take(f"<u{width}", n_seq)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Symbols to ids: the rules of the last pass first."""
        seq = seq.astype(np.uint32)
        above = len(self.alphabet) + len(self.rules)
        for n in self.passes[::-1].tolist():
            above -= n
            big = seq >= above
            at = np.arange(len(seq)) + np.cumsum(big) - big
            out = np.repeat(seq, 1 + big.astype(np.int8))
            rule = self.rules[seq[big] - len(self.alphabet)]
            out[at[big]], out[at[big] + 1] = rule[:, 0], rule[:, 1]
            seq = out
        return self.alphabet[seq]

    def lengths(self) -> np.ndarray:
        return np.concatenate([np.ones(len(self.alphabet), np.int64), self.grown])[self.seq]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, decoding its own symbols only (they end where it ends)."""
        sums = np.cumsum(self.lengths())
        lo, hi = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        return self.expand(self.seq[np.searchsorted(sums, lo, "right") : np.searchsorted(sums, hi, "left") + (hi > lo)])

    def all(self) -> np.ndarray:
        return self.expand(self.seq)


FILE_SCHEMA = "part int, block int, n_docs long, n_ids long, payload binary"


def _write(it, path: str, end_id: int, block_ids: int):
    part, block, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
    ids: list[bytes] = []
    docs: list[int] = []
    size = 0

    def close():
        ends = np.cumsum([len(x) // 4 for x in ids])
        data = compress(np.frombuffer(b"".join(ids), "<u4"), np.array(docs, np.int64), ends)
        return arrow_batch(part=pa.array([part], pa.int32()), block=pa.array([block], pa.int32()), n_docs=pa.array([len(docs)], pa.int64()), n_ids=pa.array([int(ends[-1])], pa.int64()), payload=pa.array([data], pa.binary()))

    for batch in it:
        for doc_id, x in zip(batch.column(0).to_pylist(), encoder(path).encode([t or b"" for t in batch.column(1).to_pylist()])):
            ids.append(x + end)
            docs.append(doc_id)
            size += len(x) // 4 + 1
            if size >= block_ids:
                yield close()
                ids, docs, size, block = [], [], 0, block + 1
    if docs:
        yield close()


def write(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The written table of blocks (part, block, n_docs, n_ids, payload), in ascending doc_id order by part and block.

    A null or empty text is its end id alone, repeated rows of one id stand together, documents without an id are left
    out, other columns are ignored. An empty table gives no blocks. Blocks are rows of Parquet files, so any Hadoop
    file system holds them and Spark's commit replaces what a lost executor had written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return saved(ordered.mapInArrow(lambda it: _write(it, path, end_id, block_ids), FILE_SCHEMA), "token-blocks")


def _read(it):
    for batch in it:
        for payload, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block = Block(payload)
            data = block.all().astype("<u4").tobytes()
            ends = block.ends.astype(np.int64)
            starts = np.r_[0, ends[:-1]]
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield arrow_batch(doc_id=pa.array(block.doc_ids), start=pa.array(starts + before), n_tokens=pa.array(ends - starts), ids_crc32=pa.array(crc, pa.int64()))


def read(blocks: DataFrame) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids_crc32, decoded from its block."""
    small_batches(blocks.sparkSession, 8)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    heads = blocks.select("part", "block", "n_ids").join(parts, "part")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*earlier))
    heads = saved(heads.select("part", "block", (F.col("base") + F.coalesce(inside, F.lit(0))).alias("before")), "heads")
    placed = blocks.join(checked_broadcast(heads), ["part", "block"]).select("payload", "before")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
