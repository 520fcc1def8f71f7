"""Encoding with a public tokenizer file, one piece of text at a time and each different piece once.

The tokenizers library encodes; what is added is a cut at places that no token can span, and a bounded table of pieces
already encoded. The cut of a byte-level file is a single space between two non-spaces (the space opens the next
piece), that of a lower-casing word file any ASCII white space. A text with other spacing is encoded whole. Most words
are a run of Latin letters, perhaps with some stops behind: normalisation and the first split leave those as they are
(but for case) and part them there. So letters and stops are pieces of their own, and the letters go to the library's
model directly; all other words go through the library's whole chain.

A batch of texts is cut in one go over its bytes. Pieces of up to 15 bytes are two numbers, which say all of them:
equal ones meet by sorting and find their place in a sorted table, so that Python sees each new piece once; longer ones
go through a dictionary. The ids of all pieces are then gathered at once.
"""

from __future__ import annotations

import os
from functools import partial
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of one kind that are held; a full table starts anew.
PIECES = 600_000
#: White space of str.split besides the space.
_OTHER_SPACE = [chr(c).encode() for c in (*range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
#: The first n bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII signs that the first split keeps together, apart from letters; none opens a contraction or an added token.
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?$%&*#+=/@()\"-_~^[]{}")] = True


def _single_spaces(text: bytes) -> bool:
    """Is all white space at the pieces' ends a single space between two pieces?"""
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return False
    return not any(c in text and (b" " + c in text or c + b" " in text) for c in _OTHER_SPACE)


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: b for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b], free = free, free + 1
    return table


_LETTER = _byte_letters()


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are of Latin letters: ASCII, or U+00C0 to U+00FF but for the two signs of arithmetic."""
    out = _ASCII_LETTER[data]
    if (data >= 128).any():
        next_ = data[1:]
        two = (data[:-1] == 0xC3) & (next_ >= 0x80) & (next_ < 0xC0) & (next_ != 0x97) & (next_ != 0xB7)
        out[:-1] |= two
        out[1:] |= two
    return out


def _lower(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[letters & (data >= 65) & (data <= 90)] += 32
    out[1:][letters[1:] & (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)] += 32
    return out


class _Table:
    """Pieces (bytes) -> places; what is not there yet is learned."""

    def __init__(self):
        self.key, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.place = np.zeros(0, np.int64)
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.key) + len(self.long)

    def places(self, blob: bytes, begin: np.ndarray, size: np.ndarray, learn) -> np.ndarray:
        """Places of the pieces blob[begin : begin + size]; 16 more bytes follow the last. learn: new pieces -> places."""
        at, short = np.empty(len(begin), np.int64), size < 16
        if not short.all():
            pieces = [blob[b : b + n] for b, n in zip(begin[~short].tolist(), size[~short].tolist())]
            if new := [p for p in dict.fromkeys(pieces) if p not in self.long]:
                self.long.update(zip(new, learn(new).tolist()))
            at[~short] = [self.long[p] for p in pieces]
            begin, size = begin[short], size[short]
        if len(begin):
            at[short] = self._short(blob, begin, size, learn)
        return at

    def _short(self, blob: bytes, begin: np.ndarray, size: np.ndarray, learn) -> np.ndarray:
        eight = np.ndarray((len(blob) - 7,), "<u8", blob, 0, (1,))  # the eight bytes from each place on
        low = eight[begin] & _MASK[np.minimum(size, 8)]
        high = (eight[begin + 8] & _MASK[np.maximum(size - 8, 0)]) | (size.astype(np.uint64) << np.uint64(56))
        key = (low ^ (high * _P)) * _P
        key = (key ^ (key >> np.uint64(32))) * _P
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        of, one = np.empty(len(key), np.int64), order[new]
        of[order] = np.cumsum(new) - 1
        if ((low != low[one][of]) | (high != high[one][of])).any():  # two pieces with one key
            _, one, of = np.unique(np.column_stack([low, high]), axis=0, return_index=True, return_inverse=True)
        key, low, high = key[one], low[one], high[one]
        near = np.searchsorted(self.key, key)
        inside = np.minimum(near, max(0, len(self.key) - 1))
        hit = (self.key[inside] == key) & (self.low[inside] == low) & (self.high[inside] == high) if len(self.key) else np.zeros(len(key), bool)
        place = np.where(hit, self.place[inside], -1) if len(self.key) else np.full(len(key), -1)
        if not hit.all():
            miss = ~hit
            place[miss] = learn([blob[b : b + n] for b, n in zip(begin[one[miss]].tolist(), size[one[miss]].tolist())])
            order = np.argsort(key[miss], kind="stable")
            at, put = near[miss][order], lambda old, x: np.insert(old, at, x[miss][order])
            self.key, self.low, self.high, self.place = put(self.key, key), put(self.low, low), put(self.high, high), put(self.place, place)
        return place[of]


class PieceEncoder:
    """texts (UTF-8) -> little-endian unsigned 32-bit ids, as the library gives them for the whole text."""

    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = pieces
        self.tokenize = self.library.model.tokenize
        self.words = '"end_of_word_suffix":"</w>"' in self.library.to_str()
        self.prefix = "" if self.words else " "
        self.space = "" if self.words else chr(_LETTER[32])
        self._reset()

    def _reset(self) -> None:
        self.tables = {kind: _Table() for kind in ("letters", "stops", "word")}
        #: ids of all pieces end to end, and where each piece's begin; the last entry is the end
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, letters: bytes) -> list[int]:
        shown = letters.decode("latin-1")
        shown = self.space + (shown if letters.isascii() else shown.translate(_LETTER))
        return [t.id for t in self.tokenize(shown)]

    def _learn(self, pieces: list[bytes], kind: str) -> np.ndarray:
        """The places of new pieces, whose ids are appended."""
        if kind == "letters":
            ids = list(map(self._model, pieces))
        else:
            prefix = self.prefix if kind == "word" else ""
            ids = self._library([prefix + p.decode("utf-8", "replace") for p in pieces])
        ends = self.begin[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.begin = np.concatenate([self.begin, ends])
        return len(self.begin) - 1 - len(pieces) + np.arange(len(pieces))

    def _places(self, blob: bytes, begin: np.ndarray, size: np.ndarray, kind: str) -> np.ndarray:
        return self.tables[kind].places(blob, begin, size, partial(self._learn, kind=kind))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        plain = [True] * len(texts) if self.words else list(map(_single_spaces, texts))
        # the first piece of a byte-level text has no space before it
        heads = None if self.words else [t.partition(b" ")[0].decode("utf-8", "replace") if ok else "" for t, ok in zip(texts, plain)]
        inner = texts if self.words else [t.partition(b" ")[2] if ok else b"" for t, ok in zip(texts, plain)]
        blob = b" ".join([*inner, b" " * 16])
        data = np.frombuffer(blob, np.uint8)
        space = _SPACE[data] if self.words else data == 32
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        begin, end = edge[::2], edge[1::2]
        if max(map(len, self.tables.values())) > self.limit:
            self._reset()
        # simple words: letters, then stops
        letters, stop = _letters(data), np.cumsum(_STOP[data], dtype=np.int32)
        run = np.flatnonzero(np.diff(letters.view(np.int8), prepend=0))
        simple, head_end = letters[begin], begin.copy()
        head_end[simple] = run[1::2][space[run[::2] - 1]]  # runs at a word's head; before the first byte lies the last, a space
        simple &= stop[end - 1] - stop[head_end - 1] == end - head_end
        head_end[~simple] = end[~simple]
        at = np.empty((len(begin), 2), np.int64)
        small = _lower(data, letters).tobytes() if self.words else blob
        at[simple, 0] = self._places(small, begin[simple], (head_end - begin)[simple], "letters")
        at[~simple, 0] = self._places(blob, begin[~simple], (end - begin)[~simple], "word")
        stops = end > head_end
        at[stops, 1] = self._places(blob, head_end[stops], (end - head_end)[stops], "stops")
        at = at[np.column_stack([np.ones(len(begin), bool), stops])]
        n_ids = self.begin[at + 1] - self.begin[at]
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_ids)])
        ids = self.flat[np.repeat(self.begin[at] - first[:-1], n_ids) + np.arange(first[-1])].astype("<u4").tobytes()
        # where each text's pieces end
        pieces = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + stops)])
        ends = 4 * first[pieces[np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in inner]))]]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        packed = lambda x: np.array(x, "<u4").tobytes()
        if not self.words:
            out = [packed(h) + x for h, x in zip(self._library(heads), out)]
        whole = [k for k, ok in enumerate(plain) if not ok]
        for k, x in zip(whole, self._library([texts[k].decode("utf-8", "replace") for k in whole]) if whole else []):
            out[k] = packed(x)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
