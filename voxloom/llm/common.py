"""Helpers that the corpus operators share: tables, shared storage, Arrow text, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

#: Text bytes that a Python worker works on at once.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker: either side holds a few of them for each task.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Python workers of the session get BATCH_BYTES at once from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, text (null: empty) and further columns; what else ``docs`` has isn't read."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def release() -> None:
    """Gives what a worker has freed back to the machine: workers live as long as executors, and keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch, cut so that a part has ``most`` bytes of text or one row; memory is given back after each."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
        release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 64 random bits for each byte value, and the odd base of the polynomial hashes.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)
#: The base of a second hash, over codes mixed once more.
SECOND_BASE = np.uint64(0xA24BAED4963EE407)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest table yet is kept."""
    if len(_POWERS.get(int(base), ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[int(base)] = np.multiply.accumulate(out)
    return _POWERS[int(base)][:n]


class Rolling:
    """Prefix sums of codes times powers of a base: the hash of any range in constant time."""

    def __init__(self, codes: np.ndarray, base: np.uint64 = BASE):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        np.cumsum(codes * powers(base, len(codes)), out=self.sums[1:])

    @classmethod
    def second(cls, codes: np.ndarray) -> Rolling:
        """A hash of its own, so that both together have 128 bits."""
        return cls(mix(codes), SECOND_BASE)

    @classmethod
    def over(cls, data: np.ndarray) -> Rolling:
        """Over bytes."""
        return cls(BYTE_CODES[data])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of codes[start:end], alike wherever the range lies."""
        return mix((self.sums[end] - self.sums[start]) * powers(self.inverse, len(self.sums))[start])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: starts, ends, and n + 1 offsets of each text's words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths: the row of each element, and its place in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - start[row]


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
