"""Repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are told apart only through ``length`` bytes. The first digit is the window's anchor core
(``window_passes``): suffixes alone with it leave, equal hulls stay together, and the rest goes to shards by that
digit. A shard sorts on, digit by digit of eight bytes: suffixes alone in their group leave at once, groups that agree
in a digit are not moved, and what is still together at full depth are exactly the repeated strings.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .window_passes import Windows, covered, for_each_text, marks, ranges, with_marks

WINDOW = 400
CORE = 100
_C = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as integers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        m = len(out[k::8])
        out[k::8] = np.frombuffer(padded, "<u8", m, k)
    return out


def equal_groups(digits: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, group) of all suffixes that agree with another through ``length`` bytes, grouped.

    digits: eight bytes from each position on; group: what suffixes have in common already.
    """
    row = np.lexsort((group,))
    group = group[row]
    for depth in [None, *range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if depth is not None:
            if not len(row):
                break
            d = digits[start[row] + depth]
            head = np.r_[True, group[1:] != group[:-1]]
            number = np.cumsum(head) - 1
            same = d == d[np.flatnonzero(head)][number]
            if same.all():
                continue
            odd = np.zeros(number[-1] + 1, bool)
            odd[number[~same]] = True
            move = np.flatnonzero(odd[number])
            order = move[np.lexsort((d[move], group[move]))]
            row[move], d[move] = row[order], d[order]
            # the groups keep their places, so only digits tell new groups
            group = np.cumsum(head | np.r_[True, d[1:] != d[:-1]] & odd[number])
        head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        alone = head & np.r_[head[1:], True] if len(group) else head
        if alone.any():
            row, group = row[~alone], group[~alone]
    return row, group


def settle(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """Windows of a block's hulls without copies that occur elsewhere in it, as runs."""
    sizes = np.array([len(r[5]) for r in rows])
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    n = sizes - length + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + inner
    _, key = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    doc = np.repeat(np.array([r[1] for r in rows], np.int64), n)
    lo = np.repeat(np.array([r[2] for r in rows], np.int64), n) + inner
    copies = np.repeat(np.array([r[4] for r in rows], bool), n)
    row, _ = equal_groups(_eights(text), start, np.repeat(key, n), length)
    hit = np.zeros(len(doc), bool)
    hit[row] = True
    return ranges(doc, lo, hit & ~copies)


def _units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _order(units: np.ndarray, core: int) -> np.ndarray:
    h = _eights(units)[: len(units) - core + 1] * _C
    return (h ^ (h >> np.uint64(32))) * _C


def _cut(doc_id: int, text: bytes, runs: list[dict], length: int) -> dict:
    gone = covered(len(text), runs, length) if runs else np.zeros(len(text), bool)
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if runs and len(gone) else 0
    return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def repeated_strings(docs: DataFrame, length: int = WINDOW, core: int = CORE) -> DataFrame:
    """doc_id, lo, n_windows: runs of strings of ``length`` bytes that start anywhere else too; docs: unique doc_id, text as bytes."""
    w = Windows(length, core, _units, partial(_order, core=core), False)
    return marks(docs, w, partial(settle, length=length), "radix")


def remove_repeats(docs: DataFrame, length: int = WINDOW, core: int = CORE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows that repeat a doc_id and its text
    are one document, not copies of each other; unlike texts of one doc_id are documents of their own. Documents without
    an id are left out; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return for_each_text(docs, lambda d: with_marks(d, repeated_strings(d, length, core), partial(_cut, length=length), schema, "radix"), "radix")
