"""Lossless WebP: a complete decoder in numpy, an encoder, and media columns made from texts.

The decoder reads prefix codes (simple and normal), meta prefix codes,
back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette (colour indexing) transforms. Streams of palette pixels
and back-references, as ``text_streams`` writes them, are encoded and decoded many
at a time, one literal or copy of each stream in each step.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, doc_texts, ragged, utf8

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: Longest prefix code that the encoder writes.
MOST_BITS = 12
#: Bytes of text in a row of pixels, and rows in a tile.
ROW, ROWS = 576, 16
_REVERSED = np.array([int(f"{x:08b}"[::-1], 2) for x in range(256)], np.uint8)


def reverse(code: int, bits: int) -> int:
    """The low bits of ``code`` in the other order."""
    return int(f"{code:0{bits}b}"[::-1], 2) if bits else 0


class Bits:
    """Reads a stream from its lowest bit on."""

    def __init__(self, data: bytes):
        self.value, self.end, self.at = int.from_bytes(data, "little"), 8 * len(data), 0
        self.data = data

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends too early")
        first = self.at >> 3
        out = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return out & ((1 << n) - 1)


class Code:
    """A prefix code from code lengths: canonical, read from its highest bit."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.single = int(used[0]) if len(used) == 1 else None
        order = used[np.lexsort((used, lengths[used]))]
        self.symbols, self.lengths = order, lengths[order].astype(np.int64)
        if self.single is None and int((1 << (15 - self.lengths)).sum()) != 1 << 15:
            raise ValueError("a prefix code that isn't complete")
        self.fixed = int(self.lengths[0]) if self.single is None and self.lengths[0] == self.lengths[-1] else None
        self._lookup: dict[tuple[int, int], int] | None = None

    @classmethod
    def of_one(cls, symbol: int) -> Code:
        """The code of one symbol, which takes no bits."""
        out = cls.__new__(cls)
        out.single, out.fixed, out.symbols, out.lengths = symbol, None, np.array([symbol]), np.array([1])
        return out

    def codes(self) -> np.ndarray:
        """The codes of ``symbols``, highest bit first."""
        firsts = np.cumsum(1 << (15 - self.lengths)) - (1 << (15 - self.lengths))
        return firsts >> (15 - self.lengths)

    def table(self, bits: int) -> np.ndarray:
        """For each next ``bits`` bits as they lie in the stream: the symbol, with its length from bit 12 on."""
        if self.single is not None:
            return np.full(1 << bits, self.single, np.uint16)
        ordered = np.repeat((self.symbols | (self.lengths << 12)).astype(np.uint16), 1 << (bits - self.lengths))
        return ordered[_reversal(bits)]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self._lookup is None:
            self._lookup = {(int(n), int(c)): int(s) for n, c, s in zip(self.lengths, self.codes(), self.symbols, strict=True)}
        code = n = 0
        while n < 15:
            code, n = code << 1 | bits.read(1), n + 1
            if (found := self._lookup.get((n, code))) is not None:
                return found
        raise ValueError("no such code")

    def read_many(self, bits: Bits, n: int) -> np.ndarray | None:
        """The next n symbols at once, where all codes have one length."""
        if self.single is not None:
            return np.full(n, self.single)
        if self.fixed is None:
            return None
        flat = np.frombuffer(bits.read(n * self.fixed).to_bytes((n * self.fixed + 7) // 8, "little"), np.uint8)
        if self.fixed == 8:
            return self.symbols[_REVERSED[flat]]
        rows = np.unpackbits(flat, bitorder="little")[: n * self.fixed].reshape(n, self.fixed)
        return self.symbols[rows @ (1 << np.arange(self.fixed)[::-1])]


_REVERSALS: dict[int, np.ndarray] = {}


def _reversal(bits: int) -> np.ndarray:
    if bits not in _REVERSALS:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((x >> k) & 1) << (bits - 1 - k)
        _REVERSALS[bits] = out
    return _REVERSALS[bits]


@lru_cache(256)
def _length_code(n: int, packed: int) -> Code:
    """The code of code lengths, from n lengths of three bits."""
    of_lengths = np.zeros(19, np.int64)
    for k in range(n):
        of_lengths[CODE_LENGTH_ORDER[k]] = packed >> (3 * k) & 7
    return Code(of_lengths)


def read_code(bits: Bits, alphabet: int) -> Code:
    """One prefix code of the stream."""
    if bits.read(1):
        two = bits.read(1)
        symbol = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code.of_one(symbol)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[symbol, bits.read(8)]] = 1
        return Code(lengths)
    n = 4 + bits.read(4)
    code = _length_code(n, bits.read(3 * n))
    lengths = np.zeros(alphabet, np.int64)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if code.symbols.max() < 16 and (many := code.read_many(bits, min(left, alphabet))) is not None:
        lengths[: len(many)] = many
        return Code(lengths)
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
        else:
            value, n = (before, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3) if symbol == 17 else 11 + bits.read(7))
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + n] = value
            at += n
    return Code(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.read(more) + 1


def _prefixes(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the values from 0 to ``most`` (0 isn't used): prefix symbol, number of extra bits, extra bits."""
    less = np.maximum(np.arange(most + 1) - 1, 0)
    high = np.frexp(np.maximum(less, 1).astype(np.float64))[1] - 1
    more = np.maximum(high - 1, 0)
    symbol = np.where(less < 4, less, 2 * high + (less >> more & 1))
    return symbol, np.where(less < 4, 0, more), np.where(less < 4, 0, less & ((1 << more) - 1))


#: Symbols of copies: number of extra bits, and the value without them.
EXTRA = np.array([0, 0, 0, 0, *[(s - 2) >> 1 for s in range(4, 40)]])
LEAST = np.array([1, 2, 3, 4, *[((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(4, 40)]])
#: Places of the distances that have short codes.
_NEAR_X, _NEAR_Y = np.array(NEAR).T


def _size(n: int, bits: int) -> int:
    return -(-n // (1 << bits))


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as height x width values ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_bits = None, 0
    if main and bits.read(1):
        group_bits = 2 + bits.read(3)
        groups = (read_pixels(bits, _size(width, group_bits), _size(height, group_bits), False) >> 8) & 0xFFFF
    count = int(groups.max()) + 1 if groups is not None else 1
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in alphabets] for _ in range(count)]
    n = width * height
    if groups is None and not cache_bits and codes[0][0].symbols.max() < 256 and all(c.single is not None for c in codes[0][1:4]):
        green, rest = codes[0][0], codes[0][3].single << 24 | codes[0][1].single << 16 | codes[0][2].single
        if (many := green.read_many(bits, n)) is not None:
            return (many.astype(np.int64) << 8 | rest).reshape(height, width)
    out, cache, at = np.zeros(n, np.int64), [0] * (1 << cache_bits), 0

    def remember(argb: int) -> None:
        cache[((CACHE_MULTIPLIER * argb) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < n:
        green, red, blue, alpha, distance = codes[int(groups[(at // width) >> group_bits, (at % width) >> group_bits]) if groups is not None else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = argb = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            if cache_bits:
                remember(argb)
            at += 1
        elif symbol < 280:
            length = _extra(bits, symbol - 256)
            far = _extra(bits, distance.read(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - far]
                if cache_bits:
                    remember(int(out[at]))
                at += 1
        else:
            out[at] = argb = cache[symbol - 280]
            remember(argb)
            at += 1
    return out.reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB values as (…, 4) channels A, R, G, B."""
    return (pixels[..., None] >> np.array([24, 16, 8, 0])) & 255


def _joined(channels: np.ndarray) -> np.ndarray:
    return (channels & 255) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The predicted channels A, R, G, B of a pixel from its neighbours."""
    half = lambda a, b: (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0])
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        estimate = left + top - top_left
        return left if np.abs(estimate - left).sum() < np.abs(estimate - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = half(left, top)
    step = mean - top_left
    return np.clip(mean + np.where(step < 0, -(-step >> 1), step >> 1), 0, 255)


def _neighbours(c: np.ndarray, y: int, x: int) -> tuple[np.ndarray, ...]:
    width = c.shape[1]
    right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
    return c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1]


def _mode(modes: np.ndarray, y: int, x: int, bits: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(modes[y >> bits, x >> bits] >> 8) & 15


def _predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) the predictions."""
    c = _channels(pixels)
    out = c.copy()
    known = out if sign > 0 else c
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            mode = _mode(modes, y, x, bits)
            near = (known[y, x - 1] if x else None, known[y - 1, x] if y else None, None, None) if y == 0 or x == 0 else _neighbours(known, y, x)
            out[y, x] = (c[y, x] + sign * predict(mode, *near)) & 255
    return _joined(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what red and blue share with green and red."""
    height, width = pixels.shape
    block = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width]
    a, red, green, blue = np.moveaxis(_channels(pixels), -1, 0)
    green_red, green_blue, red_blue = _signed(block), _signed(block >> 8), _signed(block >> 16)
    delta = lambda t, c: (t * _signed(c)) >> 5
    new_red = (red + sign * delta(green_red, green)) & 255
    new_blue = (blue + sign * (delta(green_blue, green) + delta(red_blue, new_red if sign > 0 else red))) & 255
    return _joined(np.stack([a, new_red, green, new_blue], -1))


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _joined(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


@dataclass
class Header:
    """What precedes the pixels of a stream."""

    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    coded_width: int = 0


def read_header(bits: Bits) -> Header:
    """Size and transforms of a stream."""
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless stream")
    out = Header(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width = out.width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = bits.read(3) + 2
            out.transforms.append((kind, n, read_pixels(bits, _size(width, n), _size(out.height, n), False), width))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(read_pixels(bits, colours, 1, False)[0]), 0))
            out.transforms.append((kind, _bundle_bits(colours), table, width))
            width = _size(width, _bundle_bits(colours))
        else:
            out.transforms.append((kind, 0, None, width))
    out.coded_width = width
    return out


def invert(pixels: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    """Pixels without their transforms, the last one first."""
    for kind, bits, values, width in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _predictor(pixels, values, bits, 1)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, values, bits, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            index, each = (pixels >> 8) & 255, 8 >> bits
            if bits:
                index = ((index[..., None] >> (each * np.arange(1 << bits))) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
            pixels = np.append(values, np.zeros(256 - len(values), np.int64))[index]
    return pixels


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L stream as a height x width x 4 array of bytes A, R, G, B."""
    bits = Bits(data)
    header = read_header(bits)
    return _channels(invert(read_pixels(bits, header.coded_width, header.height, True), header.transforms)).astype(np.uint8)


def streams(media: bytes) -> list[bytes]:
    """The VP8L streams of a WebP file: one, or one for each frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    found, at, end = [], 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"VP8L":
            found.append(media[at + 8 : at + 8 + size])
        at += 8 + (16 if name == b"ANMF" else size + (size & 1))
    return found


def decode(media: bytes) -> list[np.ndarray]:
    """The images of a WebP file, one for each frame."""
    return [decode_stream(x) for x in streams(media)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def container(tiles: list[tuple[int, int, bytes]]) -> bytes:
    """A WebP file of (width, height, stream): still, or with a frame for each tile."""
    if len(tiles) == 1:
        body = _chunk(b"VP8L", tiles[0][2])
    else:
        size = lambda n: struct.pack("<I", n)[:3]
        width, height = max(t[0] for t in tiles) - 1, max(t[1] for t in tiles) - 1
        body = _chunk(b"VP8X", struct.pack("<I", 2) + size(width) + size(height)) + _chunk(b"ANIM", struct.pack("<IH", 0, 1))
        for w, h, stream in tiles:
            body += _chunk(b"ANMF", size(0) + size(0) + size(w - 1) + size(h - 1) + size(100) + b"\2" + _chunk(b"VP8L", stream))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; with a single symbol, length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parents = [0] * (2 * len(weights) - 1)
        for node in range(len(weights), len(parents)):
            a = heapq.heappop(heap)
            b = heap[0]
            parents[a[1]] = parents[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
        depth = [0] * len(parents)
        for node in range(len(parents) - 2, -1, -1):
            depth[node] = depth[parents[node]] + 1
        if max(depth[: len(weights)]) <= most:
            out[used] = depth[: len(weights)]
            return out
        weights = [(w + 1) // 2 + sum(weights) // (1 << most) for w in weights]


class Writer:
    """Writes a stream from its lowest bit on."""

    def __init__(self) -> None:
        self.value = self.at = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def put_single(out: Writer, symbol: int) -> None:
    """A prefix code of one symbol below 256."""
    out.put(0b101 if symbol > 1 else 0b001, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def put_lengths(out: Writer, lengths: np.ndarray) -> None:
    """A prefix code by its lengths, four bits each; trailing zeros are left out."""
    n = int(np.flatnonzero(lengths)[-1]) + 1
    out.put(0, 1)
    out.put(15, 4)
    for symbol in CODE_LENGTH_ORDER:
        out.put(4 if symbol < 16 else 0, 3)
    if n < 2:
        lengths, n = np.append(lengths, 0), 2
    out.put(1, 1)
    out.put(4, 3)
    out.put(n - 2, 10)
    packed = _REVERSED[lengths[:n].astype(np.uint8)] >> 4
    nibbles = np.append(packed, np.zeros(n & 1, np.uint8)).reshape(-1, 2)
    out.put(int.from_bytes((nibbles[:, 0] | nibbles[:, 1] << 4).tobytes(), "little"), 4 * n)


def put_start(out: Writer, width: int, height: int) -> None:
    """Signature and size."""
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)


def put_grey_palette(out: Writer, values: np.ndarray) -> None:
    """A palette whose entries have these green values, over 16 of them so that pixels aren't bundled."""
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(values) - 1, 8)
    out.put(0, 1)
    out.put(0, 1)
    out.put(8, 4)  # code-length codes up to that of length 8, the only one
    for symbol in CODE_LENGTH_ORDER[:12]:
        out.put(1 if symbol == 8 else 0, 3)
    out.put(1, 1)
    out.put(3, 3)
    out.put(254, 8)
    for _ in range(4):
        put_single(out, 0)
    steps = np.diff(values.astype(np.int64), prepend=0) & 255
    out.put(int.from_bytes(_REVERSED[steps].tobytes(), "little"), 8 * len(steps))


#: Lengths of copies: a shorter one takes more bits than its literals.
LEAST_COPY, MOST_COPY = 6, 4096
#: Prefix symbols of lengths and of distance codes; the distance code of each distance in rows of ROW.
_OF_VALUE = _prefixes(ROW * ROWS + len(NEAR))
_DISTANCE_CODE = np.arange(ROW * ROWS + 1) + len(NEAR)
for _code in range(len(NEAR), 0, -1):
    if 0 < (_far := int(_NEAR_X[_code - 1] + _NEAR_Y[_code - 1] * ROW)) <= ROW * ROWS:
        _DISTANCE_CODE[_far] = _code


def _alike(x: np.ndarray) -> np.ndarray:
    """How many bytes two groups of eight share from the first on, by their exclusive or."""
    lowest = (x & (~x + np.uint64(1))).astype(np.float64)
    return np.where(x == 0, 8, (np.frexp(lowest)[1] - 1) >> 3)


def references(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies in tiles of a text, by place: place, length, distance. What they leave are literals.

    Each tile is read greedily: where the last place before with the same hash has
    the same LEAST_COPY bytes, it is copied from as far as the bytes agree. All tiles
    go forward together, a copy of each in a step.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,)).copy()
    first = np.uint64((1 << 8 * LEAST_COPY) - 1)
    hashed = (((eight[:-1] & first) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(hashed, kind="stable").astype(np.int32)  # places of one hash by rising place, so tile after tile
    sorted_hashes, before = hashed[order], np.full(len(data), -1, np.int32)
    before[order[1:]] = np.where(sorted_hashes[1:] == sorted_hashes[:-1], order[:-1], -1)
    sizes = np.asarray(ends - starts, np.int64)
    good = before >= np.repeat(starts.astype(np.int32), sizes)
    good &= ((eight[:-1] ^ eight[before]) & first) == 0
    for cut in range(1, LEAST_COPY):
        good[ends - cut] = False
    following = np.full(len(data) + 1, len(data), np.int64)
    following[:-1][good] = np.flatnonzero(good)
    following = np.minimum.accumulate(following[::-1])[::-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, end = following[starts], np.asarray(ends, np.int64)
    while True:
        live = at < end
        at, end = at[live], end[live]
        if not len(at):
            break
        b, most = before[at].astype(np.int64), np.minimum(end - at, MOST_COPY)
        length = _alike(eight[at] ^ eight[b])
        on = np.flatnonzero((length == 8) & (most > 8))
        while len(on):
            more = _alike(eight[at[on] + length[on]] ^ eight[b[on] + length[on]])
            length[on] += more
            on = on[(more == 8) & (length[on] < most[on])]
        length = np.minimum(length, most)
        found.append((at, length, at - b))
        at = following[at + length]
    if not found:
        return (np.empty(0, np.int64),) * 3
    places, lengths, distances = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(places)
    return places[order], lengths[order], distances[order]


def text_streams(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, bytes]]]:
    """For payloads laid end to end, each a multiple of ROW bytes: tiles of palette pixels and back-references, in Huffman codes of each payload's own."""
    n = len(offsets) - 1
    tiles_of = -(-np.diff(offsets) // (ROW * ROWS))
    owner, place = ragged(tiles_of)
    starts = np.asarray(offsets, np.int64)[owner] + place * (ROW * ROWS)
    ends = np.minimum(starts + ROW * ROWS, offsets[owner + 1])
    copied, lengths_of, far = references(data, starts, ends)
    tile_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.cumsum(np.bincount(copied, minlength=len(data) + 1) - np.bincount(copied + lengths_of, minlength=len(data) + 1))[:-1] > 0
    literal = np.flatnonzero(~inside)
    long_symbol, long_bits, long_extra = (x[lengths_of] for x in _OF_VALUE)
    far_symbol, far_bits, far_extra = (x[_DISTANCE_CODE[far]] for x in _OF_VALUE)
    literal_owner, copy_owner = owner[tile_of[literal]], owner[tile_of[copied]]
    counts = np.bincount(literal_owner * 280 + data[literal], minlength=n * 280) + np.bincount(copy_owner * 280 + 256 + long_symbol, minlength=n * 280)
    counts, far_counts = counts.reshape(n, 280), np.bincount(copy_owner * 40 + far_symbol, minlength=n * 40).reshape(n, 40)
    code, bits = np.zeros((n, 280), np.uint32), np.zeros((n, 280), np.uint8)
    far_code, far_length = np.zeros((n, 40), np.uint32), np.zeros((n, 40), np.uint8)
    outs: list[Writer] = []
    for k in range(n):
        values = np.flatnonzero(counts[k][:256])
        palette = np.append(values, np.zeros(max(0, 17 - len(values)), np.int64))
        symbols = np.zeros(280, np.int64)
        symbols[: len(values)], symbols[256:] = counts[k][values], counts[k][256:]
        lengths = code_lengths(symbols)
        out = Writer()
        put_grey_palette(out, palette)
        out.put(0, 3)  # no further transform, no colour cache, no meta prefix codes
        put_lengths(out, lengths)
        for _ in range(3):
            put_single(out, 0)
        made = Code(lengths)
        if made.single is None:
            where = np.where(made.symbols < 256, np.append(values, np.zeros(280 - len(values), np.int64))[made.symbols], made.symbols)
            code[k, where] = _reversal(15)[made.codes() << (15 - made.lengths)]
            bits[k, where] = made.lengths
        if far_counts[k].any():
            lengths = code_lengths(far_counts[k])
            put_lengths(out, lengths)
            made = Code(lengths)
            if made.single is None:
                far_code[k, made.symbols] = _reversal(15)[made.codes() << (15 - made.lengths)]
                far_length[k, made.symbols] = made.lengths
        else:
            put_single(out, 0)
        outs.append(out)
    # a literal is one item of bits, a copy two: its length and its distance
    first = np.zeros(len(data), np.int8)
    first[literal], first[copied] = 1, 2
    upto_items = np.cumsum(first, dtype=np.int64) - first
    items = int(first.sum(dtype=np.int64))
    used, values, tile = np.zeros(items, np.int64), np.zeros(items, np.int64), np.zeros(items, np.int64)
    at = upto_items[literal]
    used[at], values[at], tile[at] = bits[literal_owner, data[literal]], code[literal_owner, data[literal]], tile_of[literal]
    at = upto_items[copied]
    plain = bits[copy_owner, 256 + long_symbol].astype(np.int64)
    used[at], values[at], tile[at] = plain + long_bits, code[copy_owner, 256 + long_symbol] | long_extra << plain, tile_of[copied]
    plain = far_length[copy_owner, far_symbol].astype(np.int64)
    used[at + 1], values[at + 1], tile[at + 1] = plain + far_bits, far_code[copy_owner, far_symbol] | far_extra << plain, tile_of[copied]
    upto = np.concatenate([[0], np.cumsum(used)])
    begin = upto_items[starts]
    past = np.append(begin[1:], items)
    head_bits = np.array([40 + outs[k].at for k in owner.tolist()], np.int64)
    sizes = (head_bits + upto[past] - upto[begin] + 7) // 8
    bases = np.cumsum(sizes) - sizes
    at = upto[:-1] + (bases * 8 + head_bits - upto[begin])[tile]
    shifted = values << (at & 7)
    byte = at >> 3
    total = int(sizes.sum()) + 4
    flat = sum(np.bincount(byte + k, (shifted >> (8 * k)) & 255, total) for k in range(4)).astype(np.uint8)
    files: list[list[tuple[int, int, bytes]]] = [[] for _ in range(n)]
    for k, base, size, a, b in zip(owner.tolist(), bases.tolist(), sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        start, out = Writer(), outs[k]
        height = (b - a) // ROW
        put_start(start, ROW, height)
        head = np.frombuffer((start.value | out.value << 40).to_bytes((47 + out.at) // 8, "little"), np.uint8)
        flat[base : base + len(head)] |= head
        files[k].append((ROW, height, flat[base : base + size].tobytes()))
    return files


def decode_green(found: list[bytes]) -> list[np.ndarray]:
    """The green channel of each stream. Streams of palette pixels and back-references go forward together, a literal or a copy of each in a step."""
    out: list[np.ndarray | None] = [None] * len(found)
    tables, far_tables, places, sizes, widths, which = [], [], [], [], [], []
    for k, data in enumerate(found):
        bits = Bits(data)
        header = read_header(bits)
        here = bits.at
        quick = None
        if [t[0] for t in header.transforms] == [PALETTE] and header.transforms[0][1] == 0 and bits.read(2) == 0:
            codes = [read_code(bits, n) for n in (280, 256, 256, 256, 40)]
            if all(c.lengths.max() <= MOST_BITS for c in (codes[0], codes[4])) and all(c.single is not None for c in codes[1:4]):
                quick = codes
        if quick is None:
            bits.at = here
            out[k] = _channels(invert(read_pixels(bits, header.coded_width, header.height, True), header.transforms))[..., 2].astype(np.uint8).ravel()
            continue
        colours = np.zeros(280, np.uint16)
        colours[: len(header.transforms[0][2])] = (header.transforms[0][2] >> 8) & 255
        colours[256:] = np.arange(256, 280)
        entries = quick[0].table(MOST_BITS)
        tables.append(colours[entries & 0xFFF] | (entries & np.uint16(0xF000)))
        far_tables.append(quick[4].table(MOST_BITS))
        places.append(bits.at)
        sizes.append(header.width * header.height)
        widths.append(header.width)
        which.append(k)
    if not which:
        return out
    lookups, far_lookups, sizes, width = np.concatenate(tables), np.concatenate(far_tables), np.array(sizes), np.array(widths)
    lengths = np.array([len(found[k]) for k in which])
    flat = b"".join(found[k] for k in which) + b"\0" * 8
    window = np.ndarray(len(flat) - 3, "<u4", flat, 0, (1,)).astype(np.int64)
    at = (np.cumsum(lengths) - lengths) * 8 + np.array(places)
    base, mask = np.arange(len(which)) << MOST_BITS, (1 << MOST_BITS) - 1
    ends, limit = np.cumsum(sizes), np.cumsum(lengths) * 8
    end, which_lane = ends, np.arange(len(which))
    pixels, place = np.zeros(int(ends[-1]), np.uint8), ends - sizes
    copies: list[tuple[np.ndarray, ...]] = []
    look = lambda where: window.take(where >> 3) >> (where & 7)
    left = int(sizes.min())  # steps until the first stream can end
    while len(at):
        entry = lookups.take(base + (look(at) & mask))
        symbol = entry & 0xFFF
        pixels[place] = symbol
        at += entry >> 12
        place += 1
        left -= 1
        copy = np.flatnonzero(symbol > 255)
        if len(copy):
            now, kind = at[copy], symbol[copy] - 256
            extra = EXTRA.take(kind)
            length = LEAST.take(kind) + (look(now) & ((1 << extra) - 1))
            now += extra
            entry = far_lookups.take(base[copy] + (look(now) & mask))
            now += entry >> 12
            kind = entry & 0xFFF
            copies.append((which_lane[copy], place[copy] - 1, length, kind, look(now)))
            now += EXTRA.take(kind)
            at[copy] = now
            place[copy] += length - 1
            left = min(left, int((end[copy] - place[copy]).min()))
        if left <= 0:
            live = place < end
            if (at > limit).any():
                raise ValueError("the stream ends too early")
            if (place > end).any():
                raise ValueError("a back-reference leaves the image")
            at, limit, base, place, end, which_lane = (x[live] for x in (at, limit, base, place, end, which_lane))
            left = int((end - place).min(initial=1 << 40))
    if copies:
        lane, where, length, kind, after = (np.concatenate(x) for x in zip(*copies, strict=True))
        far = LEAST[kind] + (after & ((1 << EXTRA[kind]) - 1))
        near = np.minimum(far, len(NEAR)) - 1
        far = np.where(far > len(NEAR), far - len(NEAR), np.maximum(_NEAR_X[near] + _NEAR_Y[near] * width[lane], 1))
        if (far > where - (ends - sizes)[lane]).any():
            raise ValueError("a back-reference leaves the image")
        row, more = ragged(length)
        to = where[row] + more
        origin = np.arange(len(pixels), dtype=np.int32)
        origin[to] = to - far[row]
        left = to
        while len(left):  # the origin of an origin: a chain of copies halves with each turn
            once = origin[left]
            twice = origin[once]
            changed = once != twice
            left = left[changed]
            origin[left] = twice[changed]
        pixels[to] = pixels[origin[to]]
    for k, a, b in zip(which, (ends - sizes).tolist(), ends.tolist(), strict=True):
        out[k] = pixels[a:b]
    return out


def feature(payload: np.ndarray) -> str:
    """What the pixels of one document look like: mean, deviation, distinct values, and a 64-bit average hash of 64 stripes."""
    x = payload.astype(np.float64)
    stripes = x.reshape(64, -1).mean(1)
    bits = int.from_bytes(np.packbits(stripes > x.mean()).tobytes(), "big")
    return f"{x.mean():.4f}:{x.std():.4f}:{len(np.unique(payload))}:{bits:016x}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text of each row as a lossless WebP file.

    The text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple
    of ROW become palette pixels, a byte each, in rows of ROW, and back-references
    to equal bytes before; every ROWS rows are a frame. Repeated rows stay; equal texts give equal files.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=4 << 20):
            data, offsets = utf8(batch.column("text"))
            lengths = np.diff(offsets)
            padded = np.maximum(-(-lengths // ROW), 1) * ROW
            places = np.concatenate([[0], np.cumsum(padded)])
            flat = np.full(int(places[-1]), 255, np.uint8)
            row, place = ragged(lengths)
            flat[places[:-1][row] + place] = data
            files = [container(tiles) for tiles in text_streams(flat, places)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return doc_texts(docs).mapInArrow(make, "doc_id long, n_bytes long, media binary")


def payloads(stored: DataFrame) -> DataFrame:
    """Reads media columns back: the pixels' bytes digested, and the feature string of the pixel array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", 4 << 20):
            files = batch.column("media").to_pylist()
            parts = [streams(x) for x in files]
            decoded = iter(decode_green([s for p in parts for s in p]))
            rows = []
            for file, p in zip(files, parts, strict=True):
                payload = np.concatenate([next(decoded) for _ in p])
                raw = payload.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(payload)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
