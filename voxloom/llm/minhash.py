"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each of 64 permutations of the shingles yields two signature values, the
smallest and the largest, which halves the hashing for 128 values. They form 32
bands of four, each band from four different permutations, so that two
documents of similarity s share a band with probability 1 - (1 - s**4)**32:
all but five in a million pairs at 0.75.

Documents with equal sets stand for one another. In a band's bucket every
document is compared with the one of smallest id, which resolves a group of
copies with as many comparisons as it has members. Where a bucket still holds
different components afterwards, its documents are compared by one-bit sketches,
in blocks of bounded size, and only pairs whose sketches allow the similarity
(all but a few in a million of those that have it) are confirmed on full sets.
Where a block has more such pairs than its size bounds, those that agree best join
each component with others first; what is one component then needs no more pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, chunks, mix, ragged, utf8, words, written

SHINGLE = 5
PERMUTATIONS, ROWS = 64, 4
#: Documents of a bucket in a block, and bits of a sketch (two for each of further permutations).
BLOCK, SKETCH = 2048, 8192
#: Documents of a block that are compared with another block at once.
STRIP = 128
#: Pairs of a group for each of its documents that are confirmed at once; of more, the TRIES of each component that agree best. After ROUNDS such rounds, or one that joins nothing, all that are left.
SPARE, TRIES, ROUNDS = 4, 4, 6
_XOR = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
_TIMES = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
_SKETCH_XOR = mix(np.arange(5001, 5001 + SKETCH // 2, dtype=np.uint64))
_SKETCH_TIMES = mix(np.arange(9001, 9001 + SKETCH // 2, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From texts as UTF-8 laid end to end: the sorted hashes of each text's distinct shingles, and n + 1 offsets.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A shingle is five
    words in a row; a text with fewer words has one shingle of them all, a text
    without words none.
    """
    data = LOWER[data]
    starts, ends, of_text = words(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    rolling = Rolling(Rolling.over(data).of(starts, ends))
    counts = np.diff(of_text)
    text, place = ragged(np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0))
    first = of_text[text] + place
    hashes = rolling.of(first, np.minimum(first + SHINGLE, of_text[text + 1]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(n + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima and maxima under each permutation: a row of 2 * PERMUTATIONS values for each non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        permuted = (hashes ^ _XOR[k]) * _TIMES[k]
        permuted ^= permuted >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(permuted, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    bands = signature.reshape(len(signature), -1, ROWS)
    key = np.broadcast_to(mix(np.arange(bands.shape[1], dtype=np.uint64)), bands.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ bands[:, :, k])
    return key


def sketch(elements: np.ndarray) -> np.ndarray:
    """A bit of the minimum and of the maximum of a set under each further permutation, as 64-bit words.

    Elements are taken in parts, so that a very long text needs no more memory than a short one.
    """
    low, high = np.full(SKETCH // 2, ~np.uint64(0)), np.zeros(SKETCH // 2, np.uint64)
    for part in range(0, len(elements), 1 << 11):
        some = elements[part : part + (1 << 11), None]
        for k in range(0, SKETCH // 2, 64):
            permuted = (some ^ _SKETCH_XOR[k : k + 64]) * _SKETCH_TIMES[k : k + 64]
            permuted ^= permuted >> np.uint64(32)
            np.minimum(low[k : k + 64], permuted.min(0), out=low[k : k + 64])
            np.maximum(high[k : k + 64], permuted.max(0), out=high[k : k + 64])
    return np.packbits(np.stack([low, high]) & np.uint64(1) > 0).view(np.uint64)


def least_agreement(percent: int) -> float:
    """Sketch bits that agree, 4.5 deviations below the mean of a pair of exactly this similarity."""
    p = 0.5 + percent / 200
    return SKETCH * p - 4.5 * (SKETCH * p * (1 - p)) ** 0.5


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets, offsets[1:], strict=False)]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), digest of the set (null if empty), and its band keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            hashes, offsets = shingle_sets(*utf8(batch.column("text")))
            counts = np.diff(offsets)
            some = np.flatnonzero(counts)
            bands = 2 * PERMUTATIONS // ROWS
            keys = band_keys(signatures(hashes, offsets)) if len(some) else np.empty((0, bands), np.uint64)
            places = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(_digests(hashes, offsets), pa.binary()), lists], ["doc_id", "n", "digest", "bands"])

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(make, "doc_id long, n long, digest binary, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """digest and elements: the sorted shingle hashes of each document, and their digest as ``features`` has it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            hashes, offsets = shingle_sets(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(hashes, offsets), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))], ["digest", "elements"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(make, "digest binary, elements array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs a, b whose sets have 100 * intersection >= percent * union.

    Sets stay in the JVM and are compared one pair at a time; pairs whose sizes
    rule the similarity out go before the second set is fetched.
    """
    pairs = pairs.select("a", "b", *[c for c in ("n",) if c in pairs.columns])
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a")
    if "n" in pairs.columns:
        left = left.where(_fitting(F.col("n"), F.size("left"), percent))
    both = left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node of the links a, b.

    Labels go to neighbours and then to the label's own label, so their number
    of rounds grows with the logarithm of a component's width; each round is
    written to the shared folder.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(stepped.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def joined_on(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links a, b: only links between different components count, once for each two of them."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    between = ends.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    more = components(between)
    known = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return written(known.unionByName(more.join(labels, "node", "left_anti")), "labels")


def _fitting(n: F.Column, m: F.Column, percent: int) -> F.Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _tied(texts: DataFrame) -> DataFrame:
    """Links a, b between the texts (doc_id, id) of one doc_id, each with the one of smallest id."""
    first = written(texts.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").drop("last"), "repeated")
    return texts.join(first, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, itself included;
    kept says that it is the document's own. Documents without words (null or
    empty text) are linked with nothing. Rows of one doc_id are one document to
    the links: what is linked with one of its texts is linked with all. A null
    doc_id is linked with nothing: component_id null, kept.

    Links are between different sets, each with a number of its own that the
    written table ``alike`` fixes.
    """
    made = written(features(docs), "features")
    named = made.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    alike = written(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "alike")
    rows = named.join(alike, ["digest", "doc_id"]).dropDuplicates(["id"]).select("id", "n", "bands")
    banded = rows.select("id", "n", F.posexplode("bands").alias("band", "key"))
    centres = banded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    shared = written(banded.join(centres, "key"), "buckets")  # only buckets with company
    nodes = written(alike.join(shared.select("id").distinct(), "id", "left_semi"), "nodes")
    text = docs.select("doc_id", "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = written(sets_of(text).dropDuplicates(["digest"]).join(nodes.select("digest", "id"), "digest").select("id", "elements"), "sets")
    star = shared.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), "n").distinct()
    texts = named.select("doc_id", "digest").distinct().join(alike.select("digest", "id"), "digest").select("doc_id", "id")
    texts = written(texts, "texts")
    links = written(confirmed(star, sets, percent).unionByName(_tied(texts)), "links")
    labels = components(links)
    labels = _settled(shared, sets, labels, percent)
    joined = written(texts.join(labels.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("label", "id").alias("label")).distinct(), "joined")
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = joined.join(least, "label").select("doc_id", "component_id")
    out = made.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _settled(shared: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` after all links between documents of different components that share a bucket."""
    members = _open_members(shared, labels)
    about = _about(members, sets)
    for _ in range(ROUNDS):
        pairs = written(_open_pairs(members, about, percent, False), "pairs")
        links = written(confirmed(pairs, sets, percent), "links")
        linked = not links.isEmpty()
        labels = joined_on(labels, links) if linked else labels
        if pairs.where("more").isEmpty():
            return labels
        members = _open_members(shared, labels)
        if not linked:
            break
    pairs = written(_open_pairs(members, about, percent, True), "pairs")
    return joined_on(labels, written(confirmed(pairs, sets, percent), "links"))


def _open_members(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of buckets that hold different components, with their label and the bucket's size."""
    named = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = written(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size"), "mixed")
    return written(named.join(mixed, "key"), "members")


def _about(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id, sketch and the keys of all bands of documents, for a bucket without others a number that equals none."""
    keys = members.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("keys"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("elements").offsets.to_numpy()
            elements = batch.column("elements").values.to_numpy().view(np.uint64)
            words = [sketch(elements[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.binary())], ["id", "sketch"])

    drawn = sets.join(keys.select("id"), "id", "left_semi").mapInArrow(draw, "id long, sketch binary")
    bands = 2 * PERMUTATIONS // ROWS
    ordered = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.element_at("keys", k), F.col("id") * bands + k))  # buckets without company equal none
    return written(keys.join(drawn, "id").select("id", "sketch", ordered.alias("bands")), "about")


def _open_pairs(members: DataFrame, about: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs a, b of fitting size and sketch that share a bucket and lie in different components, each in the first bucket they share; ``more`` where a group has others.

    A bucket of more than BLOCK documents is dealt out as pairs of blocks. Unless
    ``every`` is set, a group gives so many pairs at most as are in proportion to
    its documents.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(about, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "id", "n", "label", "bands", "sketch")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(percent, every), "a long, b long, more boolean")


def _best(labels: np.ndarray, p: np.ndarray, q: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Which pairs are among the TRIES of a component, at either end, that agree best."""
    ends, pair = np.concatenate([labels[p], labels[q]]), np.tile(np.arange(len(p)), 2)
    order = np.lexsort((-agree[pair], ends))
    new = np.ones(len(order), bool)
    new[1:] = ends[order][1:] != ends[order][:-1]
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.unique(pair[order[place < TRIES]])


def _compare(percent: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares all documents of each group of rows in order of key, i, j."""
    enough = least_agreement(percent)

    def group(rows: dict[str, np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = {k: v[first:last] for k, v in rows.items()}
        left = np.flatnonzero(r["block"] == r["i"])
        right = left if r["i"][0] == r["j"][0] else np.flatnonzero(r["block"] == r["j"])
        m, most, more = r["n"][right], SPARE * (last - first), False
        found = [np.empty((3, 0), np.int64)]  # places of both, and how many bits agree
        for strip in range(0, len(left), STRIP):
            some = left[strip : strip + STRIP]
            n = r["n"][some, None]
            fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (r["label"][some, None] != r["label"][right])
            if right is left:
                fits &= some[:, None] < right
            x, y = np.nonzero(fits)
            for start in range(0, len(x), 1 << 12):
                p, q = some[x[start : start + (1 << 12)]], right[y[start : start + (1 << 12)]]
                agree = SKETCH - np.bitwise_count(r["sketch"][p] ^ r["sketch"][q]).sum(1, dtype=np.int64)
                p, q, agree = p[agree >= enough], q[agree >= enough], agree[agree >= enough]
                own = (r["bands"][p] == r["bands"][q]).argmax(1) == r["band"][0]
                found.append(np.stack([p, q, agree])[:, own])
                if not every and sum(f.shape[1] for f in found) > most:
                    pairs = np.concatenate(found, 1)
                    found, more = [pairs[:, _best(r["label"], *pairs)]], True
        p, q, _ = np.concatenate(found, 1)
        p, q = r["id"][p], r["id"][q]
        return np.minimum(p, q), np.maximum(p, q), np.full(len(p), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "band", "id", "n", "label")}
            rows["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            rows["sketch"] = utf8(table.column("sketch"))[0].view(np.uint64).reshape(table.num_rows, -1)
            new = np.ones(table.num_rows, bool)
            new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
            bounds = np.append(np.flatnonzero(new), table.num_rows)
            found = [group(rows, a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["a", "b", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [batch.column(c)[-1].as_py() for c in ("key", "i", "j")]
            last = np.ones(batch.num_rows, bool)
            for c, end in zip(("key", "i", "j"), ends, strict=True):
                last &= batch.column(c).to_numpy() == end
            cut = batch.num_rows - int(last.sum())
            if cut or not waiting or [waiting[0].column(c)[0].as_py() for c in ("key", "i", "j")] != ends:
                yield from pairs(pa.Table.from_batches([*waiting, batch.slice(0, cut)])) if waiting or cut else ()
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from pairs(pa.Table.from_batches(waiting))

    return run
