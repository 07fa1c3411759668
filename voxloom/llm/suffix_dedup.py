"""Removal of long byte strings that occur more than once, with a logarithmic family of suffix arrays.

The suffixes kept are those that begin at the anchors of ``repeats`` (a few in
each hundred bytes, chosen by content, so that every window of 400 bytes holds
one and equal windows the same one). An array of suffixes is a table of their
first bytes' fingerprints in order of fingerprint, with how often each occurs:
only equality matters here, so that order serves as well as that of the bytes.

New documents come in batches. The array of a batch is merge-scanned against
the array of every level: a fingerprint in both marks a possible long match.
Then the batch becomes a level; two levels of equal size merge into one of twice
the size, so that each suffix is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, utf8, written
from .repeats import BYTES, Shape, keyed, marks, range_arrays, repeated, with_ranges

#: Batches into which a table that comes as a whole is cut.
BATCHES = 4


class SuffixLevels:
    """The arrays of all batches so far: level k, where there is one, holds 2 ** k batches."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    @staticmethod
    def array(suffixes: DataFrame) -> DataFrame:
        """The array of suffixes given by ``core`` and ``times``, in order in each of its parts."""
        return suffixes.groupBy("core").agg(F.sum("times").alias("times")).sortWithinPartitions("core")

    def add(self, suffixes: DataFrame) -> list[DataFrame]:
        """Adds a batch (core); returns tables of the cores that it repeats: within itself, and from each level."""
        batch = written(self.array(suffixes.select("core", F.lit(1).cast("long").alias("times"))), "suffixes")
        found = [batch.where("times > 1").select("core")]
        found += [batch.join(level, "core", "left_semi").select("core") for level in self.levels.values()]
        level = 0
        while level in self.levels:
            batch = written(self.array(batch.unionByName(self.levels.pop(level))), "suffixes")
            level += 1
        self.levels[level] = batch
        return found


def _shared(runs: DataFrame) -> DataFrame:
    index, found = SuffixLevels(), []
    for k in range(BATCHES):
        found += index.add(runs.where(F.pmod("rid", F.lit(BATCHES)) == k))
    shared = found[0]
    for more in found[1:]:
        shared = shared.unionByName(more)
    return shared.distinct()


def remove_repeats(spark: SparkSession, docs: DataFrame, shape: Shape = BYTES) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes.

    Every byte of a 400-byte string that also starts anywhere else goes, in the
    same document too; strings overlap freely and are judged on the input. Null
    texts count as empty; rows alike in doc_id and text are copies of each other.
    """
    texts = keyed(docs)
    found = with_ranges(texts, repeated(texts, shape, False, _shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            row, at, n, _ = range_arrays(batch.column("ranges"))
            gone = marks(offsets, row, at, n, shape.window)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            begins[inner] = gone[inner]
            removed, spans = np.concatenate([[0], np.cumsum(gone)])[offsets], np.concatenate([[0], np.cumsum(begins)])[offsets]
            left, bounds = data[~gone].tobytes(), (offsets - removed).tolist()
            kept = [left[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
