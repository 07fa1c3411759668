"""Windows of a fixed length that occur more than once, found exactly without shipping every window.

A window is ``window`` consecutive units (bytes or words) of one document. Its
anchor is the gram of ``gram`` units inside it with the smallest hash (the last
of equals), so equal windows have equal anchors at equal places. Consecutive
windows with one anchor are a run, and a run is what is compared first:

- its core, which lies in each of its windows (at first the anchor itself); a
  core that occurs once means that no window of the run occurs twice;
- its context, all that its windows cover; equal contexts settle all windows of
  all but one of the runs that have it;
- what is left, one run for each context of a core with several contexts, is
  cut into shorter runs, at last into single windows, and compared again. Where
  only earlier documents count, these are all runs of the context's first
  document, as none of them covers another.

Cores and contexts are compared by 64-bit fingerprints of two independent
hashes, so that what is removed is equal in 128 bits. They are grouped with partial sums, and joined back, so a core that a third of all documents share is
aggregated before it moves and its rows are dealt out anew by adaptive joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, Rolling, chunks, mix, ragged, utf8, words, written

RUN = "core long, ctx long, rid long, doc_id long, at long, n long, anchor long"
#: Units of one document that are looked at together; longer ones go in pieces that overlap.
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)

Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def byte_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each byte, and where each text starts."""
    data, offsets = utf8(column)
    return BYTE_CODES[data], offsets


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and where each text's words start."""
    data, offsets = utf8(column)
    starts, ends, of_text = words(data, offsets)
    return Rolling.over(data).of(starts, ends) if len(starts) else np.empty(0, np.uint64), of_text


@dataclass(frozen=True)
class Shape:
    """Lengths in units, and how many bytes of text a worker takes at once."""

    window: int
    gram: int
    steps: tuple[int, ...]  # lengths of the shorter runs, the last one 1
    units: Units
    chunk: int


BYTES = Shape(400, 200, (16, 1), byte_units, 1 << 20)
WORDS = Shape(50, 25, (1,), word_units, 1 << 20)


def keyed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and text (null: empty); rows alike in both share their rid."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("rid"), "doc_id", text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def runs_of(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of texts laid end to end: text, at, n, anchor (in units of the text), core, context."""
    lengths = np.diff(offsets)
    text, place = ragged(np.maximum(lengths - window + 1, 0))
    if not len(text):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    start = offsets[text] + place
    rolling = Rolling(codes)
    at = np.arange(len(codes) - gram + 1)
    least = (rolling.of(at, at + gram) & ~_PLACE) | (_PLACE - at.astype(np.uint64))
    span, most = 1, window - gram + 1
    while span < most:
        step = min(span, most - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    text, begin, anchor = text[first], start[first], anchor[first]
    core = rolling.of(anchor, anchor + gram)
    ctx = mix(Rolling.second(codes).of(begin, begin + n - 1 + window) ^ mix((anchor - begin) * (window + 1) + n))
    return text, begin - offsets[text], n, anchor - offsets[text], core, ctx


def cut_runs(rolling: Rolling, second: Rolling, first: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, window: int, step: int) -> tuple[np.ndarray, ...]:
    """Runs of ``step`` windows at most, aligned to the anchor: row, at, n, core, context. ``first`` is where a run's text starts."""
    low, high = (anchor - at - n + 1) // step, (anchor - at) // step
    row, k = ragged(high - low + 1)
    block = low[row] + k
    last = np.minimum(anchor[row] - step * block, at[row] + n[row] - 1)
    begin = np.maximum(anchor[row] - step * block - step + 1, at[row])
    inner = first[row] + anchor[row] - step * block
    core = mix(rolling.of(inner, inner - step + 1 + window) ^ mix(block + 1))
    ctx = mix(second.of(first[row] + begin, first[row] + last + window) ^ mix((anchor[row] - begin) * (window + 1) + last - begin + 1))
    return row, begin, last - begin + 1, core, ctx


def first_runs(keyed_docs: DataFrame, shape: Shape) -> DataFrame:
    """The runs of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", shape.chunk):
            codes, offsets = shape.units(batch.column("text"))
            rid, doc_id = batch.column("rid"), batch.column("doc_id")
            lengths = np.diff(offsets)
            long = lengths > SEGMENT
            for k in np.flatnonzero(long):
                for start in range(0, int(lengths[k]), SEGMENT):
                    piece = codes[offsets[k] + start : min(offsets[k + 1], offsets[k] + start + SEGMENT + shape.window - 1)]
                    text, at, n, anchor, core, ctx = runs_of(piece, np.array([0, len(piece)]), shape.window, shape.gram)
                    yield _runs(rid, doc_id, text + k, at + start, n, anchor + start, core, ctx)
            if long.any():
                codes, offsets = codes[np.repeat(~long, lengths)], np.append(0, np.cumsum(lengths[~long]))
            text, *rest = runs_of(codes, offsets, shape.window, shape.gram)
            yield _runs(rid, doc_id, np.flatnonzero(~long)[text], *rest)

    return keyed_docs.mapInArrow(make, RUN)


def _runs(rid: pa.Array, doc_id: pa.Array, text: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, core: np.ndarray, ctx: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(text)
    return pa.RecordBatch.from_arrays([_signed(core), _signed(ctx), rid.take(rows), doc_id.take(rows), pa.array(at), pa.array(n), pa.array(anchor)], [x.split()[0] for x in RUN.split(", ")])


def shorter_runs(keyed_docs: DataFrame, left: DataFrame, shape: Shape, step: int) -> DataFrame:
    """The runs of ``left``, cut to ``step`` windows."""
    per_text = left.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("runs"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", shape.chunk):
            codes, offsets = shape.units(batch.column("text"))
            runs = batch.column("runs")
            text = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            at, n, anchor = (runs.flatten().field(k).to_numpy() for k in range(3))
            row, begin, length, core, ctx = cut_runs(Rolling(codes), Rolling.second(codes), offsets[text], at, n, anchor, shape.window, step)
            yield _runs(batch.column("rid"), batch.column("doc_id"), text[row], begin, length, anchor[row], core, ctx)

    return keyed_docs.join(per_text, "rid").mapInArrow(make, RUN)


def settle(runs: DataFrame, shared: DataFrame, earlier: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """What equal contexts settle: covered runs (with the source of each), and the runs that need a closer look.

    ``shared`` has the cores that count. With ``earlier``, only a smaller doc_id
    covers a run, and all runs of a context's smallest doc_id are looked at again;
    otherwise any other run covers it, and one run for each context is.
    """
    counted = written(shared.select("core"), name)  # so that both sides of each join are dealt out for it alone, and large keys can be split
    here = written(runs.join(counted, "core", "left_semi"), name)
    per = written(here.groupBy("core", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "rid", "at", "n", "anchor")).alias("one")), name)
    covering = F.col("one.doc_id") < F.col("doc_id") if earlier else F.lit(True)
    covered = here.join(per.where("times > 1").select("core", "ctx", "one"), ["core", "ctx"]).where(covering)
    several = written(per.groupBy("core").agg(F.count("*").alias("contexts")).where("contexts > 1").select("core"), name)
    left = per.join(several, "core", "left_semi")
    if earlier:
        least = left.select("core", "ctx", F.col("one.doc_id").alias("doc_id"))
        left = here.join(least, ["core", "ctx", "doc_id"], "left_semi").select("doc_id", "rid", "at", "n", "anchor").distinct()  # rows alike share their runs
    else:
        left = left.select("one.*")
    return covered.select("rid", "at", "n", F.col("one.doc_id").alias("source")), left


def shared_cores(runs: DataFrame, earlier: bool) -> DataFrame:
    """Cores that occur more than once; with ``earlier``, in more than one document."""
    if earlier:
        return runs.groupBy("core").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return runs.groupBy("core").agg(F.count("*").alias("times")).where("times > 1")


def repeated(keyed_docs: DataFrame, shape: Shape, earlier: bool, shared: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranges of window starts (rid, at, n, source) whose windows also start elsewhere, or in an earlier document.

    ``shared`` finds the cores of the first runs that count; the default groups
    them all at once.
    """
    if earlier:
        keyed_docs = keyed_docs.where("doc_id is not null")
    runs = written(first_runs(keyed_docs, shape), "runs")
    covered, left = settle(runs, shared(runs) if shared else shared_cores(runs, earlier), earlier, "settled")
    if earlier:
        left = written(left, "left")
    if len(shape.steps) > 1:
        keyed_docs = written(keyed_docs.join(left.select("rid").distinct(), "rid", "left_semi"), "texts")  # the few that are looked at again
    for step in shape.steps:
        runs = written(shorter_runs(keyed_docs, left, shape, step), "runs")
        more, left = settle(runs, shared_cores(runs, earlier), earlier, "settled")
        covered = covered.unionByName(more)
    return covered


def with_ranges(keyed_docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every document with its ranges (null: none)."""
    per_text = ranges.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("at", "n", "source"))).alias("ranges"))
    return keyed_docs.join(per_text, "rid", "left")


def range_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of a batch: row, at, n, source."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without null rows
    at, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    source = flat.field(2).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), counts), at, n, source


def marks(offsets: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which units of texts laid end to end lie in a window that starts in a range."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(edge, offsets[row] + at, 1)
    np.add.at(edge, offsets[row] + at + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
