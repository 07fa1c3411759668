"""An index of calls that grows by batches: pieces in hash buckets, and manifests that say which of them count.

A batch leaves one piece for each bucket that it changes. Where ``every`` pieces
of one tier have come together in a bucket, they and all smaller ones there
become a piece of the next tier, so a row is written again as often as there are
tiers: bytes written follow the changes, not the index, and buckets without
changes aren't touched. A batch counts from the moment its manifest is there,
which is written aside and renamed; a crash before that leaves the index as it
was. Pieces that a batch has replaced are deleted by the next one, so a reader may
go on during one batch.

    <index>/manifest/<batch>.json           buckets, schema, pieces (bucket, tier, batch, rows), those replaced
    <index>/pieces/batch=<n>/{new,merged}/vx_tier=<t>/vx_bucket=<b>/*.parquet
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _file(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that it is on."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    found, fs = _file(spark, path)
    return fs.exists(found)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        found, fs = _file(spark, path)
        fs.delete(found, True)


def _manifests(spark: SparkSession, index: str) -> list[int]:
    """Batches that are in the index and whose manifests are still there."""
    folder, fs = _file(spark, f"{index}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, index: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{index}/manifest/{number}.json", wholetext=True).first()[0])


def newest(spark: SparkSession, index: str) -> dict | None:
    """The manifest of the last batch, None if there is none."""
    found = _manifests(spark, index)
    return _manifest(spark, index, found[-1]) if found else None


def _commit(spark: SparkSession, index: str, number: int, manifest: dict) -> None:
    aside, fs = _file(spark, f"{index}/manifest/{number}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(aside, _file(spark, f"{index}/manifest/{number}.json")[0]):
        raise OSError(f"manifest {number} of {index} wasn't renamed")


def _path(index: str, piece: list[int]) -> str:
    bucket, tier, batch, _ = piece
    return f"{index}/pieces/batch={batch}/{'merged' if tier else 'new'}/vx_tier={tier}/vx_bucket={bucket}"


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each call the row of highest version, ties to the later batch, then to the larger other values in order."""
    names = [f"`{c}`" for c in rows.columns if c not in ("call_id", "version", "_came", *keys)]
    best = rows.groupBy(*keys, "call_id").agg(F.max(F.struct("version", "_came", *names)).alias("_best"))
    return best.select(*[c if c in ("call_id", *keys) else F.col(f"_best.`{c}`").alias(c) for c in rows.columns])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int")


def _stored(schema: StructType) -> StructType:
    """The columns of a piece: those of the index and the batch that a row came in."""
    return StructType([*schema.fields, StructField("_came", LongType())])


def _write(rows: DataFrame, folder: str, number: int) -> list[list[int]]:
    """Rows written by tier and bucket, and the pieces that they are: one row of figures for each comes to the driver."""
    rows.write.partitionBy("vx_tier", "vx_bucket").mode("overwrite").parquet(folder)
    counted = rows.sparkSession.read.schema(rows.schema).parquet(folder).groupBy("vx_bucket", "vx_tier").count()
    return [[r["vx_bucket"], r["vx_tier"], number, r["count"]] for r in counted.collect()]


def _grown(pieces: list[list[int]], every: int) -> dict[int, int]:
    """Buckets in which ``every`` pieces of a tier have come together, and the tier that they and the smaller ones go to."""
    of = {}
    for bucket, tier, _, _ in pieces:
        of.setdefault(bucket, Counter())[tier] += 1
    goals = {}
    for bucket, tiers in of.items():
        tier = 0
        while tiers[tier] >= every:
            tier += 1
            tiers[tier] += 1
        if tier:
            goals[bucket] = tier
    return goals


def add(batch: DataFrame, index: str, number: int, every: int = 8, buckets: int = 64) -> None:
    """Takes batch ``number`` (call_id, version, others of types with an order) into the index, once.

    Rows without call_id are left out; a null version is below all others. A batch
    that the index already has changes nothing, so batches may be replayed.
    ``buckets`` holds for the first batch and then stays. Buckets, tiers and
    ``every`` bound the manifest. The names _came, vx_tier and vx_bucket are taken.
    """
    if every < 2 or buckets < 1:
        raise ValueError("every must be 2 or more, buckets 1 or more")
    if taken := {"_came", "vx_tier", "vx_bucket"} & {c.lower() for c in batch.columns}:
        raise ValueError(f"columns of these names can't be kept: {sorted(taken)}")
    spark = batch.sparkSession
    known = _manifests(spark, index)
    if known and number <= known[-1]:
        return
    last = _manifest(spark, index, known[-1]) if known else {"buckets": buckets, "schema": None, "pieces": []}
    buckets, schema = last["buckets"], batch.schema
    if known and StructType.fromJson(json.loads(last["schema"])).simpleString() != schema.simpleString():
        raise ValueError(f"columns of batch {number} aren't those of {index}")
    folder = f"{index}/pieces/batch={number}"
    _delete(spark, [folder])  # what a crash has left
    came = _latest(batch.where(F.col("call_id").isNotNull()).withColumn("_came", F.lit(number).cast("long")))
    placed = came.withColumns({"vx_tier": F.lit(0), "vx_bucket": _bucket(buckets)}).repartition("vx_bucket")
    pieces = last["pieces"] + _write(placed, f"{folder}/new", number)
    goals, old = _grown(pieces, every), []
    if goals:
        old = [p for p in pieces if p[1] < goals.get(p[0], 0)]
        rows = spark.read.schema(_stored(schema)).parquet(*[_path(index, p) for p in old])
        tier = F.coalesce(*[F.when(F.col("vx_bucket").isin([b for b, t in goals.items() if t == goal]), goal) for goal in sorted(set(goals.values()))])
        merged = _latest(rows.withColumn("vx_bucket", _bucket(buckets)).repartition("vx_bucket"), "vx_bucket")
        pieces = [p for p in pieces if p not in old] + _write(merged.withColumn("vx_tier", tier), f"{folder}/merged", number)
    _commit(spark, index, number, {"buckets": buckets, "schema": schema.json(), "pieces": pieces, "replaced": old})
    for n in known:  # what the batch before and, after a crash, earlier ones have replaced
        _delete(spark, [_path(index, p) for p in _manifest(spark, index, n)["replaced"]])
    _delete(spark, [f"{index}/manifest/{n}.json" for n in known[:-1]])


def read(spark: SparkSession, index: str) -> DataFrame:
    """The index as of its last batch, one row for each call. Buckets of one piece are read as they are; only those of several are grouped."""
    manifest = newest(spark, index)
    if manifest is None:
        raise FileNotFoundError(f"no batch is in {index}")
    schema, pieces = StructType.fromJson(json.loads(manifest["schema"])), manifest["pieces"]
    several = Counter(p[0] for p in pieces)
    found = spark.createDataFrame([], schema)
    for alone in (True, False):
        paths = [_path(index, p) for p in pieces if (several[p[0]] == 1) == alone]
        if paths:
            rows = spark.read.schema(_stored(schema)).parquet(*paths)
            found = found.union((rows if alone else _latest(rows)).drop("_came"))
    return found
