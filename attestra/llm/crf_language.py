"""Language of documents and of their words by a linear-chain conditional random field.

Words (runs of letters) carry affix, character n-gram and lexicon features, hashed into one table of weights per
language; learned transitions link neighbouring words. Forward-backward over the whole text gives every word's
posterior, so a code-switched text gets runs of languages, and the document gets the language with the largest mean
posterior. The field is fitted on the driver from a bounded sample of labelled rows (``SAMPLE``); the weights have a
fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, batches, small_batches

#: Labelled rows the field is fitted on at most, with all their words: those of the least hashed ids among the rows whose
#: text has at most ``SAMPLE_BYTES`` bytes.
SAMPLE, SAMPLE_BYTES = 1200, 1 << 16
#: Words of a sequence in the fit, which takes a text apart into such sequences.
STRETCH = 64
TABLE_BITS = 17
STEPS, RATE, DECAY = 30, 0.15, 1e-4
UNKNOWN = "und"
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_U = np.uint64
#: Affix lengths in bytes; kinds of features, each hashed with its own number.
_AFFIXES = (1, 2, 3, 4)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters; none if there is no letter at all."""
    if not text:
        return []
    out = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    if not any(c < 128 for w in out for c in w[:1]) and not any(c.isalpha() for c in text):
        return []
    return out


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + _U(kind + 1)) * _U(0x9E3779B97F4A7C15)
    return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - TABLE_BITS)).astype(np.int64)


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all features of the words."""
    sizes = np.array([len(w) for w in vocabulary], np.int64)
    data = np.frombuffer(b"^" + b"$^".join(vocabulary) + b"$", np.uint8).astype(np.uint64)
    begin = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    out_w, out_s = [], []

    def put(w, x, kind):
        out_w.append(w)
        out_s.append(_slot(x, kind))

    gram = data
    for n in (2, 3):
        gram = gram[:-1] * _U(256) + data[n - 1 :]
        inside = owner[: len(gram)] == owner[n - 1 :]
        put(owner[: len(gram)][inside], gram[inside], n)
    for n in _AFFIXES:
        fit = np.flatnonzero(sizes >= n)
        prefix = suffix = np.zeros(len(fit), np.uint64)
        for k in range(n):
            prefix = prefix * _U(256) + data[begin[fit] + 1 + k]
            suffix = suffix * _U(256) + data[begin[fit] + 1 + sizes[fit] - n + k]
        put(fit, prefix, 10 + n)
        put(fit, suffix, 20 + n)
    # the lexicon: the word itself
    put(np.arange(len(sizes)), np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(sizes)), 30)
    return np.concatenate(out_w), np.concatenate(out_s)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # slot, language
    moves: np.ndarray  # from, to

    def emissions(self, vocabulary: list[bytes]) -> np.ndarray:
        w, s = features(vocabulary)
        out = np.zeros((len(vocabulary), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(w, self.weights[s, k], len(vocabulary))
        return out


def posteriors(em: np.ndarray, sizes: np.ndarray, moves: np.ndarray, chunk: int = 64, pairs: bool = False):
    """Posterior of every word by forward-backward; em holds the sequences one after another (sizes above 0).

    With ``pairs`` also the expected number of each move (from, to) over all neighbours: sums of their joint posteriors
    forward * transition * emission * backward.

    A sequence is cut into chunks whose transfer matrices are multiplied first; vectors then pass from chunk to chunk
    and at last through all chunks at once. That is the same product, only bracketed otherwise.
    """
    n, k = em.shape
    a = np.exp(moves - moves.max())
    e = np.exp(em - em.max(axis=1, keepdims=True))
    pieces = -(-sizes // chunk)
    first = np.cumsum(pieces) - pieces
    seq = np.repeat(np.arange(len(sizes)), pieces)
    inner = np.arange(pieces.sum()) - first[seq]
    begin = (np.cumsum(sizes) - sizes)[seq] + inner * chunk
    length = np.minimum(sizes[seq] - inner * chunk, chunk)
    total = len(seq)
    at = np.minimum(begin[:, None] + np.arange(chunk), n - 1)
    grid = e[at]
    live = np.arange(chunk) < length[:, None]
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(chunk):
        step = (m @ a) * grid[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = np.where(live[:, t, None, None], step, m)
    ahead, back = np.ones((total, k)), np.ones((total, k))
    for j in range(1, int(pieces.max())):
        on = np.flatnonzero(pieces > j)
        c = first[on] + j
        v = np.einsum("ij,ijk->ik", ahead[c - 1], m[c - 1])
        ahead[c] = v / v.max(axis=1, keepdims=True)
        c = first[on] + pieces[on] - 1 - j
        v = np.einsum("ijk,ik->ij", m[c + 1], back[c + 1])
        back[c] = v / v.max(axis=1, keepdims=True)
    alpha = np.empty((total, chunk, k))
    v = ahead
    for t in range(chunk):
        step = (v @ a) * grid[:, t]
        step /= step.max(axis=1, keepdims=True)
        v = np.where(live[:, t, None], step, v)
        alpha[:, t] = v
    v, expected = back, np.zeros((k, k))
    for t in range(chunk - 1, -1, -1):
        here = grid[:, t] * v
        if pairs:  # with the word before; a sequence's first word has none
            on = live[:, t] & ((inner > 0) | (t > 0))
            joint = (alpha[:, t - 1] if t else ahead)[on][:, :, None] * a * here[on][:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        alpha[:, t] *= v
        step = here @ a.T
        step /= step.max(axis=1, keepdims=True)
        v = np.where(live[:, t, None], step, v)
    out = alpha[live]
    out /= out.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


@dataclass
class Sequences:
    """Labelled sequences of words: a vocabulary and numbers in it."""

    languages: list[str]
    vocabulary: list[bytes]
    word: np.ndarray
    sizes: np.ndarray
    label: np.ndarray  # of each sequence

    def __post_init__(self):
        self.owner, self.slot = features(self.vocabulary)
        self.y = np.repeat(self.label, self.sizes)

    def gradient(self, field: Field) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log-likelihood a word: by weights and by moves. Within a sequence the language stays."""
        n, k = len(self.word), len(self.languages)
        p, expected = posteriors(field.emissions(self.vocabulary)[self.word], self.sizes, field.moves, STRETCH, True)
        off = -p
        off[np.arange(n), self.y] += 1
        by_word = np.stack([np.bincount(self.word, off[:, j], len(self.vocabulary)) for j in range(k)], axis=1)
        weights = np.stack([np.bincount(self.slot, by_word[self.owner, j], 1 << TABLE_BITS) for j in range(k)], axis=1)
        stays = np.bincount(self.label, self.sizes - 1, k)
        # the first word's label has the sum of all moves into it as its weight, which is the same for all only where moves are
        into = np.exp(field.moves - field.moves.max())
        into /= into.sum(axis=0)
        first = np.cumsum(self.sizes) - self.sizes
        return weights / n, (np.diag(stays) - expected + into * off[first].sum(axis=0)) / n


def sequences(rows: list[tuple[list[bytes], str]]) -> Sequences:
    """rows: (words, language). Every word of a row is taken to be of its language; long rows are several sequences."""
    languages = sorted({lang for _, lang in rows})
    code = {x: k for k, x in enumerate(languages)}
    seqs = [(ws[s : s + STRETCH], code[lang]) for ws, lang in rows for s in range(0, len(ws), STRETCH)]
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for ws, _ in seqs for w in ws), np.int64)
    return Sequences(languages, list(number), word, np.array([len(ws) for ws, _ in seqs], np.int64), np.array([y for _, y in seqs], np.int64))


def fit(rows: list[tuple[list[bytes], str]]) -> Field:
    """rows: (words, language)."""
    data = sequences(rows)
    k = len(data.languages)
    field = Field(data.languages, np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k)))
    if not len(data.word):
        return field
    moment = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((k, k)), np.zeros((k, k))]
    for step in range(1, STEPS + 1):
        grad, move = data.gradient(field)
        for x, g, m, v in ((field.weights, grad - DECAY * field.weights / 100, moment[0], moment[1]), (field.moves, move - DECAY * field.moves, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (g != 0)
    field.weights = field.weights.astype(np.float32)
    return field


def _posterior_batch(texts: list[str | None], field: Field) -> list[np.ndarray]:
    """Posteriors (words by languages) of each text."""
    split = [words(t) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = [w for s in split for w in s]
    if not flat:
        return [np.zeros((0, len(field.languages)))] * len(texts)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    em = field.emissions([flat[i] for i in at.tolist()])[word]
    p = posteriors(em, sizes[sizes > 0], field.moves)
    return np.split(p, np.cumsum(sizes)[:-1])


def _predict(batch: pa.RecordBatch, field: Field) -> pa.RecordBatch:
    langs, scores, n_words, mixed = [], [], [], []
    for p in _posterior_batch(batch.column(2).to_pylist(), field):
        n_words.append(len(p))
        if not len(p):
            langs.append(UNKNOWN)
            scores.append(0.0)
            mixed.append(0)
            continue
        mean = p.mean(axis=0)
        best = p.argmax(axis=1)
        langs.append(field.languages[int(mean.argmax())])
        scores.append(min(1.0, float(mean.max())))
        mixed.append(int((np.diff(best) != 0).sum()))
    return arrow_batch(doc_id=batch.column(0), held_out=batch.column(1), lang_pred=pa.array(langs), score=pa.array(scores), n_words=pa.array(n_words, pa.int64()), n_switches=pa.array(mixed, pa.int64()))


def _runs(batch: pa.RecordBatch, field: Field) -> pa.RecordBatch:
    rows = []
    for doc_id, p in zip(batch.column(0).to_pylist(), _posterior_batch(batch.column(2).to_pylist(), field)):
        if len(p):
            best = p.argmax(axis=1)
            cut = np.flatnonzero(np.r_[True, np.diff(best) != 0]).tolist() + [len(best)]
            rows += [(doc_id, s, e - s, field.languages[best[s]], float(p[s:e, best[s]].mean())) for s, e in zip(cut, cut[1:])]
    cols = list(zip(*rows)) or [()] * 5
    names, types = ("doc_id", "word", "n_words", "lang", "posterior"), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
    return arrow_batch(**{n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` rows with text and language that are not held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= SAMPLE_BYTES))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = rows.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text")
    return fit([(words(r["text"]), r["lang"]) for r in picked.limit(sample).collect()])


def _inputs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (mean posterior), n_words, n_switches.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows and null ids are predicted row by
    row. Without any labelled row nothing can be learned: with letters or not, all rows are ``und``. Other columns are
    ignored.
    """
    field = field or train(docs)
    if not field.languages:
        return _inputs(docs).select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a table of fixed size
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    return _inputs(docs).mapInArrow(batches(lambda b: _predict(b, shared.value)), schema)


def keep_identified(docs: DataFrame, least: float, field: Field | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a mean posterior of at least ``least``.

    Null texts and texts without a letter go; if no language could be learned, all rows stay. Nothing is shuffled.
    """
    field = field or train(docs)
    if not field.languages:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [len(p) > 0 and p.mean(axis=0).max() >= least for p in _posterior_batch(batch.column(at).to_pylist(), shared.value)]
        return batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches(run), docs.schema)


def language_runs(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Runs of words of one language: doc_id, word (of the run's start), n_words, lang, posterior (mean)."""
    field = field or train(docs)
    schema = "doc_id long, word long, n_words long, lang string, posterior double"
    if not field.languages:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return _inputs(docs).mapInArrow(batches(lambda b: _runs(b, shared.value)), schema)
