"""Benchmark items inside documents, with DataFrame functions only.

Items are partitioned by the size of their shingle sets. The signature of an
item are the k shingles with the smallest hashes, where k follows from the upper
size u of its partition: a document with a share t of an item's shingles lacks
fewer than k = floor((1 - t) u) + 1 of them, so it holds one of the signature for
certain, however long it is. (Signatures of minima over whole documents can't
find a short item in a long document: their similarity falls with its length.)
Pairs with a shingle of the signature are verified on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
#: Upper sizes of the partitions: this, and its multiples by powers of two.
FIRST_SIZE = 16
#: Signature rows that are sent to all executors; beyond them both sides are shuffled.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; none for null."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _windows(words: str, width: int) -> Column:
    """The first places of all runs of ``width`` words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1)))


def shingles(words: str, width: int) -> Column:
    """All runs of ``width`` words as strings."""
    return F.transform(_windows(words, width), lambda i: F.array_join(F.slice(words, i, width), " "))


def hashes(words: str, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words."""
    return F.transform(_windows(words, width), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """key, item_id, width, shingle, hash and n (the item's distinct shingles). Each pair of item_id and text is an item with a key of its own. An item of fewer words is one shingle of them all; one without words is left out."""
    words = benchmark.select("item_id", "text").distinct().select(F.xxhash64("item_id", "text").alias("key"), "item_id", words_of(F.col("text")).alias("w"))
    parts = []
    for width in range(1, SHINGLE + 1):
        fits = F.size("w") >= width if width == SHINGLE else F.size("w") == width
        both = F.arrays_zip(shingles("w", width).alias("shingle"), hashes("w", width).alias("hash"))
        parts.append(words.where(fits).select("key", "item_id", F.lit(width).alias("width"), F.array_distinct(both).alias("s")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select("key", "item_id", "width", F.size("s").alias("n"), F.inline("s"))


def signature(items: DataFrame, percent: int) -> DataFrame:
    """key, width and hash of each item's signature."""
    upper = FIRST_SIZE * F.pow(2.0, F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / FIRST_SIZE))))
    sketch = F.floor((100 - percent) * upper / 100).cast("int") + 1
    per_item = items.groupBy("key", "width", "n").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    return per_item.select("key", "width", F.explode(F.slice("all", F.lit(1), sketch)).alias("hash"))


def containments(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs doc_id, item_id where 100 * (item's shingles in the document) >= percent * (item's shingles).

    Columns: n_found, n_shingles and containment besides. Null and empty texts
    contain nothing; rows of one doc_id are judged each, and a pair found more
    more than once is listed once, with the largest containment (of equals, the
    most shingles found). Null doc_ids are left out. Each text of an item_id is
    searched by itself; texts without an item_id are listed under null.
    """
    items = written(item_shingles(benchmark), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_found long, n_shingles long, containment double")
    few = items.count() <= BROADCAST_ROWS
    sketch = signature(items, percent).select("width", "hash").distinct()
    text = F.coalesce("text", F.lit(""))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", text).alias("rid"), text.alias("text"))
    worded = texts.select("rid", "doc_id", words_of(F.col("text")).alias("w"))

    def placed(rows: DataFrame, made: object, name: str) -> DataFrame:
        """A row for each shingle of each width that items have."""
        parts = [rows.select("rid", "doc_id", F.lit(width).alias("width"), F.explode(made("w", width)).alias(name)) for width in widths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    found = placed(worded, hashes, "hash").join(F.broadcast(sketch) if few else sketch, ["width", "hash"], "left_semi")
    candidates = written(found.select("rid").distinct(), "candidates")
    near = placed(texts.join(candidates, "rid", "left_semi").select("rid", "doc_id", words_of(F.col("text")).alias("w")), lambda w, k: F.array_distinct(shingles(w, k)), "shingle")
    known = items.select("key", "item_id", "width", "shingle", "n")
    counted = near.join(F.broadcast(known) if few else known, ["width", "shingle"]).groupBy("rid", "doc_id", "key", "item_id", "n").agg(F.count("*").alias("n_found"))
    enough = counted.where(100 * F.col("n_found") >= percent * F.col("n"))
    most = F.max(F.struct(F.col("n_found") / F.col("n"), "n_found", F.col("n").cast("long").alias("n_shingles")))
    best = enough.groupBy("doc_id", "item_id").agg(most.alias("most")).select("doc_id", "item_id", "most.n_found", "most.n_shingles")
    return best.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))
