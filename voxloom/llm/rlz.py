"""Removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

The reference of a document is all text with a smaller doc_id. Its blocks are
the stretches of words around anchors (see ``repeats``), indexed by fingerprint
and spread over the cluster, so a document is only compared with blocks that
share an anchor with it. Where a stretch of a document equals a block, it is
copied as a whole; where it doesn't, at the ends of what both have in common,
single windows of 50 words are looked up. Adjacent copies from one source join
into a factor. A word belongs to a duplicate span if a window of 50 words that
the reference has covers it, which also holds across the ends of factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, utf8, words
from .repeats import WORDS, Shape, keyed, marks, range_arrays, repeated, with_ranges


def parse(spark: SparkSession, docs: DataFrame, shape: Shape = WORDS, keep: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, factors (start, length, source), kept text.

    Words are ``[^\\x20\\x09-\\x0D]+``; the kept ones are joined by one space.
    Null texts have no words. A null doc_id is neither smaller nor larger than
    another: nothing is removed from such rows, nor because of them. Rows with
    one doc_id don't remove each other's words. With ``keep`` all columns of
    ``docs`` follow as the struct ``row``.
    """
    texts = keyed(docs)
    text = F.coalesce("text", F.lit(""))
    if keep:  # the row moves with its text in it; what is read from it is taken out afterwards
        found = with_ranges(docs.select(F.xxhash64(F.col("doc_id"), text).alias("rid"), F.struct(*docs.columns).alias("row")), repeated(texts, shape, True))
        found = found.select("rid", "row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "ranges", "row")
    else:
        found = with_ranges(texts, repeated(texts, shape, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            starts, ends, of_text = words(data, offsets)
            row, at, n, source = range_arrays(batch.column("ranges"))
            gone = marks(of_text, row, at, n, shape.window)
            removed = np.concatenate([[0], np.cumsum(gone)])[of_text]
            raw, stay = data.tobytes(), np.flatnonzero(~gone)
            bounds = (of_text - removed).tolist()
            pieces = [raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]
            kept = [b" ".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (at[1:] > at[:-1] + n[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1 if len(first) else first
            lengths = at[last] + n[last] - 1 + shape.window - at[first]
            factors = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row[first], np.arange(batch.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(at[first], pa.int64()), pa.array(lengths, pa.int64()), pa.array(source[first], pa.int64())], ["start", "length", "source"]),
            )
            more = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(of_text)), pa.array(np.diff(removed)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), factors, pa.array([x.decode() for x in kept], pa.string()), *more],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept"] + ["row"] * keep,
            )

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, length: long, source: long>>, kept string")
    return found.mapInArrow(run, schema.add(found.schema["row"]) if keep else schema)
