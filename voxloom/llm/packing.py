"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

Each task packs the documents of its partition as they come, so nothing is
shuffled. A document longer than a window is cut into full windows and a rest.
The rest goes where the sum of squares of the level array, which counts the
partly filled windows of each fill level, becomes smallest. When the partition
ends, documents of the emptiest open windows are cut to fill the fullest, so
that each partition leaves at most one window that needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, doc_texts, utf8
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task are its partition's number times this, and on.
PER_TASK = 1 << 33


def best_level(levels: np.ndarray, size: int) -> int:
    """The fill level (0: a new window) to which ``size`` tokens are best added.

    ``levels`` has the number of open windows of each level. Moving a window
    from h to h + size changes the sum of squares by 2 (N[h + size] - N[h]) + 2,
    without the first term's part where the window becomes full. Ties go to the
    fullest level.
    """
    capacity = len(levels) - 1
    open_at = np.flatnonzero(levels[1 : capacity - size + 1]) + 1
    best, cost = 0, 2 * int(levels[size]) + 1
    if len(open_at):
        change = 2 * (levels[open_at + size] - levels[open_at]) + 2
        if open_at[-1] == capacity - size:
            change[-1] = 1 - 2 * levels[open_at[-1]]
        k = len(change) - 1 - int(change[::-1].argmin())
        if change[k] <= cost:
            best = int(open_at[k])
    return best


class Packer:
    """Windows of one partition."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}  # by level: windows, each a list of pieces
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """One document with its end id."""
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._emit([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        size = len(ids) - full
        if not size:
            return
        level = best_level(self.levels, size)
        window = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        window.append((doc_id, full, ids[full:], len(ids)))
        self._put(window, level + size)

    def _put(self, window: list[tuple], level: int) -> None:
        if level == self.capacity:
            self._emit(window)
        else:
            self.open.setdefault(level, []).append(window)
            self.levels[level] += 1

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def close(self) -> None:
        """Fills the fullest open windows with pieces cut from the emptiest."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        first, last = 0, len(left) - 1
        while first <= last:
            window = left[first]
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and last > first:
                doc_id, start, ids, total = left[last].pop()
                if len(ids) > room:
                    left[last].append((doc_id, start, ids[:-room], total))
                    start, ids = start + len(ids) - room, ids[-room:]
                window.append((doc_id, start, ids, total))
                room -= len(ids)
                if not left[last]:
                    last -= 1
            self._emit(window)
            first += 1
        self.open = {}

    def taken(self) -> pa.RecordBatch:
        """The pieces of windows that are done."""
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Packs every document; a row for each piece.

    Null texts count as empty (their end id is packed), repeated rows are packed
    each. Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32, doc_tokens, sequence_id, offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(capacity, TaskContext.get().partitionId() * PER_TASK)
        for batch in chunks(batches):
            ids, offsets = encode(*utf8(batch.column("text")))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)))
            yield packer.taken()
        packer.close()
        yield packer.taken()

    return doc_texts(docs).mapInArrow(run, SCHEMA)
