"""Benchmark decontamination by suffix arrays over the training text.

Every Arrow batch of documents is a shard. Its words are numbered by the benchmark's vocabulary (others are 0), the
suffixes that can match are sorted through the window length into a suffix array, and every benchmark suffix is looked
up there by binary search. Neighbouring hits on one diagonal join to the longest verbatim matches with their locations.
No document is shuffled; the benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` bytes of text.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batches, documents, small_batches, texts_of

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Rows that are searched for all blocks together, where there are several.
STRETCH_ROWS = 1 << 14
#: Word bytes after lower-casing A-Z: digits, letters and all non-ASCII bytes; others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCH_SCHEMA = "doc_id long, n_words long, item_id string, doc_start int, item_start int, n_matched int"


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class BenchmarkBlock:
    """Sorted window keys of some benchmark items, searchable in a shard's suffix array."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        keys, sizes, owners, starts = [], [], [], []
        self.ids = []
        for item_id, text in items:
            ws = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if not ws:
                continue
            k = min(window, len(ws))
            for s in range(len(ws) - k + 1):
                keys.append(ws[s : s + k] + [0] * (window - k))
                sizes.append(k)
                owners.append(len(self.ids))
                starts.append(s)
            self.ids.append(item_id)
        self.sizes, self.owners, self.starts = (np.array(x, np.int32) for x in (sizes, owners, starts))
        low = np.array(keys, ">u4").reshape(len(keys), window)
        high = np.where(low == 0, np.uint32(0xFFFFFFFF), low).astype(">u4")
        self.low, self.high = self._strings(low), self._strings(high)
        self.least = int(self.sizes.min()) if len(sizes) else window

    def _strings(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel()

    def search(self, docs: list[list[bytes]]):
        """(document, doc start, benchmark window) of every occurrence of a window in ``docs``."""
        none = np.zeros(0, np.int64)
        w, sizes = self.window, np.array([len(d) for d in docs])
        flat = np.zeros(int(sizes.sum()) + len(docs) * w + w, np.uint32)  # every document ends in ``window`` zeros
        begin = np.concatenate([[0], np.cumsum(sizes + w)[:-1]]) if len(docs) else none
        get = self.vocab.get
        for at, d in zip(begin, docs):
            flat[at : at + len(d)] = np.fromiter(map(get, d, repeat(0)), np.uint32, len(d))
        known = flat > 0
        # number of known words from each position on: distance to the next unknown one
        gaps = np.flatnonzero(~known)
        at = np.flatnonzero(known)
        at = at[gaps[np.searchsorted(gaps, at)] - at >= self.least]
        if not len(at) or not len(self.low):
            return none, none, none
        rows = flat[at[:, None] + np.arange(w)].astype(">u4")
        # a window never runs past an unknown word, so what follows one is cut off
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0
        keys = self._strings(rows)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]  # the shard's suffix array
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        pos = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        doc = np.searchsorted(begin, pos, "right") - 1
        return doc, pos - begin[doc], which


def _matches(block: BenchmarkBlock, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    docs = [words(t) for t in texts]
    doc, start, win = block.search(docs)
    item, item_start, size = block.owners[win], block.starts[win], block.sizes[win]
    order = np.lexsort((start, start - item_start, item, doc))
    doc, start, item, item_start, size = (x[order] for x in (doc, start, item, item_start, size))
    if len(doc):
        diagonal = start - item_start
        new = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(start) > 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(doc)] - 1
        length = start[last] + size[last] - start[first]
    else:
        first = length = np.zeros(0, np.int64)
    rows = [(ids[d], len(docs[d]), block.ids[i], int(s), int(t), int(n)) for d, i, s, t, n in zip(doc[first], item[first], start[first], item_start[first], length)]
    # a row without an item for every document, so that none is lost
    rows += [(i, len(d), None, None, None, None) for i, d in zip(ids, docs)]
    cols = list(zip(*rows))
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = ("doc_id", "n_words", "item_id", "doc_start", "item_start", "n_matched")
    return arrow_batch(**{n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def _digest(batch_rows) -> pa.RecordBatch:
    out = []
    for doc_id, n_words, hits in batch_rows:
        hit, end = 0, 0
        for s, n in sorted((h["doc_start"], h["n_matched"]) for h in hits):
            hit += max(0, s + n - max(s, end))
            end = max(end, s + n)
        items = sorted({h["item_id"] for h in hits})
        out.append((doc_id, n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words))
    cols = list(zip(*out))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return arrow_batch(**{n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of bounded size; items are read partition by partition, block by block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text"))
    out, size = [[]], 0
    for r in items.where("item_id is not null").toLocalIterator():
        if size and size + len(r.text) > block_bytes:
            out, size = [*out, []], 0
        out[-1].append((r.item_id, bytes(r.text)))
        size += len(r.text)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: doc_id, n_words, item_id, doc_start, item_start, n_matched (words); per document also
    a row with null item_id. Null or wordless texts match nothing; repeated items match under each id; other columns
    of either table are ignored."""
    small_batches(docs.sparkSession)
    parts = []
    for items in _blocks(benchmark, block_bytes):
        block = BenchmarkBlock(items, window)
        run = batches(lambda b, block=block: _matches(block, b.column(0).to_pylist(), texts_of(b)))
        parts.append(documents(docs).mapInArrow(run, MATCH_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A map over the documents at every size of the benchmark: stretches of rows are searched for one block after another,
    of which a task holds one at a time, and a row's matches meet by its place. Repeated and null ids stay, each row by
    itself.
    """
    small_batches(docs.sparkSession)
    sent = [docs.sparkSession.sparkContext.broadcast(BenchmarkBlock(items, window)) for items in _blocks(benchmark, block_bytes)]

    def digested(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        rows = [[i, 0, []] for i in ids]
        for block in sent:
            for m in _matches(block.value, list(range(len(ids))), texts).to_pylist():
                rows[m["doc_id"]][1] = m["n_words"]
                if m["item_id"] is not None:
                    rows[m["doc_id"]][2].append(m)
            if len(sent) > 1:
                vars(block).pop("_value", None)  # read again from the executor's copy for the next stretch
        return _digest(rows)

    def run(it):
        ids, texts, size = [], [], 0
        for b in it:
            ids, texts = ids + b.column(0).to_pylist(), texts + texts_of(b)
            size += b.nbytes
            # with several blocks a stretch is longer, as each reads all of them
            if ids and (len(sent) == 1 or size >= BLOCK_BYTES or len(ids) >= STRETCH_ROWS):
                yield digested(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield digested(ids, texts)

    return documents(docs).mapInArrow(run, RESULT_SCHEMA)
