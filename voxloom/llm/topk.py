"""Exact nearest vectors by integer inner product, with Fagin's threshold algorithm.

Vectors are cut into blocks of a few thousand. A block's index has its vectors and,
for each dimension, its rows in order of that component. A query walks down the
lists of all its dimensions at once, from the large end where its own component
is positive and from the small end where it is negative. Each vector met for the
first time is scored in full. What hasn't been met can't score more than the sum
of the query's components times those at which the lists stand; when that sum is
below the query's k-th score, the block holds nothing more.

The k-th score of a first block of its own goes along with a query, so that in
further blocks the walk ends as soon as nothing there can beat it. Where
dimensions are many and alike (random unit vectors of 64 dimensions) the bound
falls slowly and most vectors are met; it then costs as much as scoring all.

Equal vectors stand in a block once, with as many of their ids as can be asked
for, so that a large group of copies costs one comparison.

A task of the search has a few blocks and a few groups of queries, both bounded
in bytes. Queries are copied once for some blocks that stand together, not for
each, and always by a shuffle: what goes to all blocks grows with the square of
the table and must not be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block and queries of a group.
BLOCK, GROUP = 4096, 256
#: Components of the blocks and of the queries that a task holds at most, and tasks that a search is cut into where there is enough to cut.
BLOCK_SHARE, QUERY_SHARE, TASKS = 1 << 22, 1 << 22, 64
#: Entries of each list that are read between two looks at the bound, at first and at most; it doubles.
STRIDE, LONGEST = 16, 512
#: Components are kept within this bound, far beyond which doubles aren't exact integers.
LARGEST = 2.0**62
_RESULT = "query long, ids array<long>, scores array<long>, same array<boolean>"


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(embedding, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long"))


def usable(embedding: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(embedding, finite), F.lit(False))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _packed(values: np.ndarray, *kinds: type) -> bytes:
    """Whole numbers in the first of the kinds that holds them all."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return np.ascontiguousarray(values, kind).tobytes()


def _unpacked(raw: np.ndarray, n: int, *kinds: type) -> np.ndarray:
    """The n numbers that ``_packed`` was given."""
    return raw.view(next(k for k in kinds if np.dtype(k).itemsize * n == len(raw))) if n else np.empty(0, kinds[-1])


#: Kinds of components and of places in a block.
_COMPONENTS, _PLACES = (np.int16, np.int32, np.int64), (np.uint16, np.int32)


def index(vectors: DataFrame, blocks: int, width: int) -> DataFrame:
    """From distinct vectors (v, ids) a row for each block: block, n, vectors, lists (rows by rising component, a list for each dimension), ids and their number for each row."""

    def build(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        x = _matrix(column("v"), width)
        lists = np.argsort(x, axis=0, kind="stable").T
        ids = column("ids")
        values = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
        row = [[column("block")[0].as_py()], [len(x)], [_packed(x, *_COMPONENTS)], [_packed(lists, *_PLACES)], [values.astype(np.int64).tobytes()], [np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()]]
        return pa.table([pa.array(r, t) for r, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "n", "vectors", "lists", "ids", "counts"])

    placed = vectors.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block").applyInArrow(build, "block int, n long, vectors binary, lists binary, ids binary, counts binary")


class Best:
    """The k best (score, smaller id first) that a query has met; scores at or above a floor only."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.id, self.row = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score, ids, row = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, row])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id, self.row = score[order], ids[order], row[order]

    @property
    def least(self) -> int:
        """What a vector must reach to count."""
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.k else self.floor


class Block:
    """Distinct vectors with their sorted lists, and what all queries need of them."""

    def __init__(self, x: np.ndarray, lists: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.x, self.lists, self.ids, self.counts = x, lists, ids, counts
        self.starts = np.cumsum(counts) - counts
        self.peak = np.abs(x.astype(np.float64)).max(0, initial=0)
        self.places = np.empty(lists.shape, np.int16 if len(x) < 1 << 15 else np.int32)
        np.put_along_axis(self.places, lists.astype(np.int64), np.arange(len(x), dtype=self.places.dtype)[None], 1)
        self._as: dict[type, np.ndarray] = {}

    def components(self, largest: float) -> np.ndarray:
        """The vectors in numbers that hold whole numbers up to this one exactly."""
        kind = np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else np.int64
        if kind not in self._as:
            self._as[kind] = self.x.astype(kind)
        return self._as[kind]

    def search(self, q: np.ndarray, best: Best, base: int = 0) -> int:
        """Adds to ``best`` what the block has for a query, its rows numbered from ``base`` on; gives the number of vectors that were scored."""
        n, counts = len(self.x), self.counts
        used = np.flatnonzero(q)
        if not len(used):
            used = np.arange(min(1, self.x.shape[1]))
        weights, down = q[used], q[used] >= 0
        x = self.components(float(self.peak[used].max(initial=0)) * float(np.abs(weights.astype(np.float64)).sum()))
        exact, weights = x.dtype != np.int64, weights.astype(x.dtype)
        whole = len(used) == x.shape[1]
        ends = np.where(down, n - 1, 0).astype(self.places.dtype)[:, None]
        met = np.abs((self.places if whole else self.places[used]) - ends).min(0)  # how far down a list each vector is first met
        scored, depth, stride = 0, 0, STRIDE
        while depth < n:
            end = min(depth + stride, n)
            rows = np.flatnonzero((met >= depth) & (met < end))
            scored += len(rows)
            some = x.take(rows, 0)
            score = ((some if whole else some[:, used]) @ weights).astype(np.int64)
            good = score >= best.least
            rows, score = rows[good], score[good]
            if len(rows) > best.k:  # each has an id, so that less than the k-th largest is of no use
                good = score >= np.partition(score, len(score) - best.k)[len(score) - best.k]
                rows, score = rows[good], score[good]
            if len(rows):
                each = np.repeat(np.arange(len(rows)), counts[rows])
                place = np.arange(len(each)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
                best.add(score[each], self.ids[self.starts[rows][each] + place], base + rows[each])
            if scored == n:
                break
            at = x[self.lists[used, np.where(down, n - end, end - 1)], used]
            bound = int(at @ weights) if exact else sum(int(a) * int(b) for a, b in zip(at, weights, strict=True))
            if bound < best.least:
                break
            depth, stride = end, min(stride * 2, LONGEST)
        return scored


def threshold_search(x: np.ndarray, lists: np.ndarray, ids: np.ndarray, counts: np.ndarray, q: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what a block has for a query; gives the number of vectors that were scored."""
    return Block(x, lists, ids, counts).search(q, best)


def _searched(k: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def bytes_of(table: pa.Table, *names: str) -> list[list[np.ndarray]]:
        """Rows of binary columns as arrays of bytes."""
        columns = [table.column(c).to_pylist() for c in names]
        return [[np.frombuffer(cell, np.uint8) for cell in row] for row in zip(*columns, strict=True)]

    def run(part: pa.Table, groups: pa.Table) -> pa.Table:
        blocks, bases = [], [0]
        for vectors, lists, ids, counts in bytes_of(part, "vectors", "lists", "ids", "counts"):
            n = len(counts) // 4
            x = _unpacked(vectors, n * width, *_COMPONENTS).reshape(-1, width)
            blocks.append(Block(x, _unpacked(lists, n * width, *_PLACES).reshape(width, -1), ids.view(np.int64), counts.view(np.int32)))
            bases.append(bases[-1] + n)
        out: list[tuple] = []
        for asked, floors, queries in bytes_of(groups, "asked", "floors", "queries") if blocks else []:
            asked = asked.view(np.int64)
            matrix = _unpacked(queries, len(asked) * width, *_COMPONENTS).reshape(-1, width).astype(np.int64)
            for number, q, floor in zip(asked.tolist(), matrix, floors.view(np.int64).tolist(), strict=True):
                best = Best(k, floor)
                for block, base in zip(blocks, bases, strict=False):
                    block.search(q, best, base)
                if len(best.id):
                    of = np.searchsorted(bases, best.row, "right") - 1
                    same = [bool((blocks[b].x[r - bases[b]] == q).all()) for b, r in zip(of.tolist(), best.row.tolist(), strict=True)]
                    out.append((number, best.id.tolist(), best.score.tolist(), same))
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate(types)], names=["query", "ids", "scores", "same"])

    return run


def _groups(queries: DataFrame, width: int) -> DataFrame:
    """Queries (query, v, floor) in groups: group, asked, queries, floors, each as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        row = [column("group")[0].as_py(), *[column(c).to_numpy().astype(np.int64).tobytes() for c in ("query", "floor")], _packed(_matrix(column("v"), width), *_COMPONENTS)]
        return pa.table([pa.array([r], t) for r, t in zip(row, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["group", "asked", "floors", "queries"])

    return queries.groupBy("group").applyInArrow(pack, "group long, asked binary, floors binary, queries binary")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks: query, place, vec_id, score, same."""
    rows = found.select("query", F.inline(F.arrays_zip("ids", "scores", "same"))).toDF("query", "vec_id", "score", "same")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def nearest(spark: SparkSession, embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """For each row whose vec_id ``every`` divides, the ``k`` other rows of highest score: query_id, rank, vec_id, score.

    The score is the inner product of floor(scale * x); ties go to the smaller
    vec_id. Rows without vec_id or with a vector that is null or has null or
    non-finite components take no part. A shorter vector counts as if it ended in
    zeros; an empty one scores 0. A row isn't compared with itself, but with other
    rows of the same vec_id. Scores that don't fit into 64 bits aren't defined.
    Rows without any other give none.
    """
    rows = written(embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", quantised(F.col("embedding"), scale).alias("v")), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.withColumn("place", first).where(F.col("place") <= k + 1)
    distinct = written(distinct.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = written(asked.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    n, width = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    m = queries.count()
    if not m:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    width = max(width, 1)
    blocks = -(-n // block)
    table = written(index(distinct, blocks, width), "index")
    lowest = F.lit(-(1 << 63)).cast("long")
    groups = -(-m // group)

    def search(part: DataFrame, q: DataFrame, count: int) -> DataFrame:
        per = max(min(count // TASKS, BLOCK_SHARE // (block * width)), 1)
        slots = -(-count // per)
        chunks = min(max(-(-TASKS // slots), groups * group * width // QUERY_SHARE + 1), groups)
        each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        dealt = lambda rows: rows.repartition(2 * slots * chunks, "slot", "chunk").groupBy("slot", "chunk")
        blocks = part.select(F.pmod(F.col("block"), F.lit(slots)).alias("slot"), each("chunk", chunks), "vectors", "lists", "ids", "counts")
        asked = _groups(q.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups))), width)
        asked = asked.select(F.pmod(F.col("group"), F.lit(chunks)).cast("int").alias("chunk"), each("slot", slots), "asked", "floors", "queries")
        return written(dealt(blocks).cogroup(dealt(asked)).applyInArrow(_searched(k + 1, width), _RESULT), "found")

    found = search(table.where("block = 0"), queries.withColumn("floor", lowest), 1)
    if blocks > 1:
        floors = _merged(found, k + 1).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k + 1)
        raised = queries.join(floors, "query", "left").select("query", "v", F.coalesce("least", lowest).alias("floor"))
        found = found.unionByName(search(table.where("block > 0"), raised, blocks - 1))
    best = _merged(found, k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("best"))
    answers = written(queries.join(lists, "query").select("v", "best"), "answers")
    own = F.array_min(F.transform(F.filter("best", lambda x: x["same"] & (x["vec_id"] == F.col("vec_id"))), lambda x: x["place"]))
    joined = asked.join(answers, "v").select("vec_id", "best", own.alias("own"))
    others = F.slice(F.filter("best", lambda x: ~x["place"].eqNullSafe(F.col("own"))), 1, k)
    return joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
