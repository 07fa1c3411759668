"""Ids of a public byte-level tokenizer, with a cache of pieces between spaces."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import Rolling, ragged

#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 800_000
_COARSE = re.compile(r"(?<=\S)(?=[ \n]\S)")


#: Byte classes, as bits.
LETTER, C2, C3, C2_LETTER, C3_OTHER, WHITE, ODD, C2_ODD = (np.uint8(1 << k) for k in range(8))


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for bit, values in (
        (LETTER, [*range(65, 91), *range(97, 123)]),
        (C2, [0xC2]),
        (C3, [0xC3]),
        (C2_LETTER, [0xAA, 0xB5, 0xBA]),
        (C3_OTHER, [0x97, 0xB7]),
        (WHITE, [0x20, 0x0A]),
        # apostrophes, further white space, and whatever lies beyond Latin-1
        (ODD, [0x27, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, *range(0xC4, 256)]),
        (C2_ODD, [0x85, 0xA0]),
    ):
        out[values] |= bit
    return out


_CLASS = _classes()


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where to cut texts laid end to end, as the starts of pieces that the tokenizer's pre-tokenization never joins.

    Its pattern keeps letters together, with at most the space before them. So
    plain Latin text is cut around its words; text with an apostrophe, a run of
    white space, the form of a special token or other scripts only before a
    single space or line feed that stands between two other characters.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = np.take(_CLASS, data)
    after = np.append(kind[1:], np.uint8(0))
    letter = (kind & LETTER) != 0
    odd = (kind & ODD) != 0
    if len(lead := np.flatnonzero(kind & (C2 | C3))):
        first, second = kind[lead], after[lead]
        pair = lead[np.where(first & C2, second & C2_LETTER, ~second & C3_OTHER) != 0]
        letter[pair] = True
        letter[pair + 1] = True
        odd[lead[(first & C2 & (second >> np.uint8(6))) != 0]] = True
    odd[:-1] |= (kind[:-1] & after[:-1] & WHITE) != 0
    special = np.flatnonzero(data == 0x3C)
    odd[special[data[np.minimum(special + 1, n - 1)] == 0x7C]] = True
    start = np.zeros(n, bool)
    space = data == 0x20
    np.not_equal(letter[1:], letter[:-1], out=start[1:])
    start[1:] &= ~(letter[1:] & space[:-1])
    start[:-1] |= space[:-1] & letter[1:]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[begins] = True
    counts = np.concatenate([[0], np.cumsum(odd)])
    for k in np.flatnonzero(counts[offsets[1:]] > counts[offsets[:-1]]):
        a, b = offsets[k], offsets[k + 1]
        start[a:b] = False
        start[a] = True
        text = data[a:b].tobytes().decode()
        sizes = [len(x.encode()) for x in _COARSE.split(text)]
        start[a + np.cumsum(sizes)[:-1]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes whole texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does; pieces are cached."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted hashes of pieces
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)  # of their ids in flat
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From texts as UTF-8 laid end to end: their ids end to end, and n + 1 offsets of each text's ids."""
        if len(self.keys) > CACHE_PIECES:
            self._reset()
        starts = pieces(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, at = np.unique(Rolling.over(data).of(starts, ends), return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[where] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, keys)
        where = where[at]
        counts = self.counts[where]
        upto = np.concatenate([[0], np.cumsum(counts)])
        row, place = ragged(counts)
        return self.flat[self.starts[where][row] + place], upto[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
