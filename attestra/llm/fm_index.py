"""Repeated word windows by compressed FM-indexes of shards.

``window_passes`` deals the edges of repeats to shards by content; a shard's segments are indexed block by block: the
Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts. Every window of the shard is streamed
through a backward search; a window whose statistic reaches the threshold (it matches ``length`` words) gets the
interval of its occurrences, and all but the earliest of an interval are reported.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .window_passes import Windows, covered, for_each_text, marks, ranges, with_marks

WINDOW = 20
CORE = 5
_C = np.uint64(0x9E3779B97F4A7C15)


class WaveletMatrix:
    """Rank of a symbol among the first symbols of a sequence, in bit-packed levels."""

    def __init__(self, seq: np.ndarray):
        self.levels = []
        for level in range(max(1, int(seq.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            before = np.r_[0, ones[:-1]].astype(np.int32)
            zeros = len(seq) - int(ones[-1])
            self.levels.append((level, words, before, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the walk for ``symbol`` from position ``i`` ends; differences of such places are ranks."""
        for level, words, before, zeros in self.levels:
            w = i >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i


class FmIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """text: symbols from 0 (which parts segments); suffixes are ordered through at least ``depth`` symbols."""
        n = len(text)
        rank, span = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < depth:
            key = rank * (int(rank.max()) + 2)
            key[: n - span] += rank[span:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            span *= 2
        bwt = text[order - 1]
        self.n = n
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        self.tree = WaveletMatrix(bwt.astype(np.int64))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of the patterns (one a row) that occur at least twice; others leave the search early."""
        row = np.arange(len(patterns))
        lo, hi = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[row, k]
            base = self.first[symbol] - self.tree.place(symbol, np.zeros(len(row), np.int64))
            lo, hi = base + self.tree.place(symbol, lo), base + self.tree.place(symbol, hi)
            more = hi - lo > 1
            row, lo, hi = row[more], lo[more], hi[more]
        return row, lo, hi


def settle(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """Windows of a block that occur earlier in it, as runs."""
    seqs = [np.frombuffer(r[5], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in seqs])
    _, symbol = np.unique(np.concatenate(seqs), return_inverse=True)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(rows), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = symbol + 1
    n = sizes - length + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin, n) + inner
    doc = np.repeat(np.array([r[1] for r in rows], np.int64), n)
    lo = np.repeat(np.array([r[2] for r in rows], np.int64), n) + inner
    row, interval, _ = FmIndex(text, 2 * length).search(text[start[:, None] + np.arange(length)])
    age = np.empty(len(doc), np.int64)
    age[np.lexsort((lo, doc))] = np.arange(len(doc))
    order = np.lexsort((age[row], interval))
    row, interval = row[order], interval[order]
    hit = np.zeros(len(doc), bool)
    hit[row] = True
    hit[row[np.r_[True, interval[1:] != interval[:-1]]] if len(row) else row] = False
    return ranges(doc, lo, hit)


def _units(text: bytes) -> np.ndarray:
    ws = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _order(units: np.ndarray, core: int) -> np.ndarray:
    h = np.zeros(len(units) - core + 1, np.uint64)
    for i in range(core):
        h = (h ^ (h >> np.uint64(29))) * _C + units[i : len(units) - core + 1 + i]
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(32))


def _cut(doc_id: int, text: bytes, runs: list[dict], length: int) -> dict:
    ws = text.split()
    gone = covered(len(ws), runs, length) if runs else np.zeros(len(ws), bool)
    kept = b" ".join(w for w, g in zip(ws, gone.tolist()) if not g) if runs else b" ".join(ws)
    return {"doc_id": doc_id, "n_words": len(ws), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def repeated_windows(docs: DataFrame, length: int = WINDOW, core: int = CORE) -> DataFrame:
    """doc_id, lo, n_windows: runs of windows of ``length`` words that occur earlier (smaller doc_id, or before); docs: unique doc_id, text as bytes."""
    w = Windows(length, core, _units, partial(_order, core=core), True)
    return marks(docs, w, partial(settle, length=length), "fm")


def remove_repeats(docs: DataFrame, length: int = WINDOW, core: int = CORE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words; texts shorter than a window lose nothing. Rows that repeat a doc_id and its text
    are one document, not copies of each other; unlike texts of one doc_id are documents of their own, in the order of
    their SHA-256. Documents without an id are left out; other columns are ignored.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return for_each_text(docs, lambda d: with_marks(d, repeated_windows(d, length, core), partial(_cut, length=length), schema, "fm"), "fm")
