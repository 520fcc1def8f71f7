"""Quality of documents by a support vector machine on naive Bayes features.

A document is the set of its n-grams: three neighbouring bytes, words, and one to three neighbouring word shapes (last
character, capitals, digits, same word as before). Each indicator is scaled by the log-count ratio of its classes; a
linear hinge-loss model is fitted by dual coordinate descent, and a sigmoid fitted on rows kept apart turns margins
into scores. The model is fitted on the driver from a bounded sample of labelled rows (``SAMPLE``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batches, documents, small_batches, texts_of

#: Labelled rows the model is fitted on at most: those of the least hashed ids.
SAMPLE = 4000
GRAM_BITS, WORD_BITS, SHAPE_BITS = 17, 16, 14
N_FEATURES = (1 << GRAM_BITS) + (1 << WORD_BITS) + (1 << SHAPE_BITS)
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12
_U = np.uint64


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - bits)).astype(np.int64)


def indicators(text: bytes, scratch: np.ndarray) -> np.ndarray:
    """Features that occur in the text, each once. scratch: N_FEATURES integers, of any content."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = []
    if len(b) > 2:
        found.append(_slot((b[:-2] << _U(16)) + (b[1:-1] << _U(8)) + b[2:], GRAM_BITS))
    ws = text.split()
    if ws:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
        found.append((1 << GRAM_BITS) + _slot(h, WORD_BITS))
        last = np.fromiter((w[-1] for w in ws), np.uint64, len(ws))
        letter = (last >= 97) & (last <= 122) | (last >= 128)
        capital = np.fromiter((w.isupper() and len(w) > 1 for w in ws), np.uint64, len(ws))
        same = np.r_[False, h[1:] == h[:-1]].astype(np.uint64)
        shape = np.where(letter, _U(97), last) * _U(4) + capital * _U(2) + same
        gram = shape
        for n in range(1, 4):
            found.append((1 << GRAM_BITS) + (1 << WORD_BITS) + _slot(gram + (_U(n) << _U(48)), SHAPE_BITS))
            if len(ws) <= n:
                break
            gram = gram[: len(ws) - n] * _U(1024) + shape[n:]
    if not found:
        return np.zeros(0, np.int64)
    x = np.concatenate(found)
    place = np.arange(len(x))
    scratch[x] = place
    return x[scratch[x] == place]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) + self.bias


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(N_FEATURES, SMOOTHING), np.full(N_FEATURES, SMOOTHING)]
    for x, label in zip(rows, y):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss with squared norm, one dual variable at a time; the bias is a feature of value 1."""
    rng = np.random.default_rng(seed)
    values = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in rows]
    square = np.array([float(v @ v) + 1 for v in values])
    w, bias, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            grad = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), COST)
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[x] += d * v
                bias += d
                alpha[i] = new
    return w, bias


def _margins(rows: list[np.ndarray], w: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float((w[x] * ratio[x]).sum()) / max(1.0, np.sqrt(len(x))) + bias for x in rows])


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on targets drawn in from 0 and 1."""
    up, down = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    s, t = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(s * m + t, -30, 30)))
        g = np.array([((target - p) * m).sum() - 1e-3 * s, (target - p).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        s, t = s + d[0], t + d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(s), float(t)


def fit(rows: list[np.ndarray], labels: list[int], seed: int = 3) -> Model | None:
    """None if the rows do not hold both labels."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return None
    apart = np.arange(len(y)) % 4 == 3  # for the sigmoid
    slope, shift = 1.0, 0.0
    if len(set(y[apart])) == 2 and len(set(y[~apart])) == 2:
        part = [r for r, a in zip(rows, apart) if not a]
        ratio = log_count_ratios(part, y[~apart])
        w, bias = descend(part, y[~apart], ratio, seed)
        slope, shift = sigmoid_fit(_margins([r for r, a in zip(rows, apart) if a], w, ratio, bias), y[apart])
    ratio = log_count_ratios(rows, y)
    w, bias = descend(rows, y, ratio, seed)
    return Model((w * ratio).astype(np.float32), bias, slope, shift)


def _featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
    scratch = np.zeros(N_FEATURES, np.int64)
    rows = [indicators(t, scratch) for t in texts_of(batch)]
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return arrow_batch(doc_id=batch.column(0), quality=batch.column(2), x=pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))


def _score(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    scratch, out = np.zeros(N_FEATURES, np.int64), []
    for t in texts_of(batch):
        x = indicators(t, scratch)
        m = float(model.weights[x].sum()) / max(1.0, np.sqrt(len(x))) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30))))
    score = np.array(out, np.float64)
    return arrow_batch(doc_id=batch.column(0), held_out=batch.column(2), score=pa.array(score), predicted=pa.array((score >= 0.5).astype(np.int32)))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled rows that are not held out; of repeated labels the smallest counts."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    labelled = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    small_batches(docs.sparkSession)
    rows = rows.mapInArrow(batches(_featurise), "doc_id long, quality int, x array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample)
    got = [(np.array(r["x"], np.int64), r["quality"]) for r in rows.toLocalIterator()]
    return fit([x for x, _ in got], [q for _, q in got])


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have no n-gram and get the score of the bias. Repeated rows and null ids are scored row by
    row. If the labels don't show both classes, every score is 0.5. Other columns are ignored.
    """
    model = model or train(docs, labels)
    spark = docs.sparkSession
    small_batches(spark)
    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)  # N_FEATURES weights
    return rows.mapInArrow(batches(lambda b: _score(b, shared.value)), "doc_id long, held_out boolean, score double, predicted int")
