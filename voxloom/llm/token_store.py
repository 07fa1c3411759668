"""Token ids in sorted-string-table files, a shard for each range of doc_id.

A shard holds its documents in order of key: the doc_id as eight big-endian
bytes with the sign bit flipped (null: no bytes, first of all). Entries stand in
blocks; each gives how many bytes of the key before it it shares, the rest, the
number of ids, and the ids as little-endian unsigned integers of 16 bits (32,
where an id of the block needs them). Blocks are compressed. After the blocks
come the sparse index (last key, place and size of each block), a Bloom filter
of all keys, and a footer of fixed size; a lookup reads the footer, asks the
filter, searches the index for its block, and reads that one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_texts, shared_dir, utf8, written
from .tokens import encoder

MAGIC = b"VXSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """The key of a document; keys sort as doc_ids do, null first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    """The document of a key."""
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    first = np.array([zlib.crc32(k) for k in keys], np.int64)
    second = np.array([zlib.crc32(k, 0x5BD1E995) | 1 for k in keys], np.int64)
    return (first[:, None] + np.arange(BLOOM_HASHES) * second[:, None]) % bits


class TableWriter:
    """Writes one shard; keys must come in order."""

    def __init__(self, out) -> None:  # noqa: ANN001
        self.out, self.at, self.docs, self.ids = out, 0, 0, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.pending: list[tuple[bytes, np.ndarray]] = []
        self.pending_bytes = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        """One document."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        self.keys.append(key)
        self.pending.append((key, ids))
        self.pending_bytes += 2 * len(ids) + 12
        self.docs += 1
        self.ids += len(ids)
        if self.pending_bytes >= BLOCK_BYTES:
            self._block()

    def _block(self) -> None:
        if not self.pending:
            return
        wide = any(len(ids) and int(ids.max()) > 0xFFFF for _, ids in self.pending)
        kind, before, parts = "<u4" if wide else "<u2", b"", [b"\4" if wide else b"\2"]
        for key, ids in self.pending:
            same = next((k for k, (a, b) in enumerate(zip(before, key, strict=False)) if a != b), min(len(before), len(key)))
            parts += [_varint(same), _varint(len(key) - same), _varint(len(ids)), key[same:], ids.astype(kind).tobytes()]
            before = key
        raw = b"".join(parts)
        packed = pa.Codec("zstd", 1).compress(raw, asbytes=True)
        self.out.write(packed)
        self.index.append((before, self.at, len(packed), len(raw)))
        self.at += len(packed)
        self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        """Writes index, filter and footer."""
        self._block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", *place) for k, *place in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7) // 8 * 8
        filled = np.zeros(bits, bool)
        if self.keys:
            filled[_bloom_places(self.keys, bits).ravel()] = True
        bloom = np.packbits(filled).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, MAGIC))


class TableReader:
    """Reads one shard: all of it, or one key."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file
        file.seek(file.size() - FOOTER.size)
        at, size, bloom, self.bits, self.docs, self.ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no token table")
        file.seek(at)
        index = file.read(size)
        self.filter = np.frombuffer(file.read(self.bits // 8), np.uint8)
        self.index, place = [], 0
        while place < len(index):
            n, place = _read_varint(index, place)
            self.index.append((index[place : place + n], *struct.unpack_from("<QII", index, place + n)))
            place += n + 16

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, raw_size = self.index[k]
        self.file.seek(at)
        raw = pa.Codec("zstd").decompress(self.file.read(size), raw_size, asbytes=True)
        width, place, key = raw[0], 1, b""
        while place < len(raw):
            same, place = _read_varint(raw, place)
            rest, place = _read_varint(raw, place)
            n, place = _read_varint(raw, place)
            key = key[:same] + raw[place : place + rest]
            place += rest
            yield key, np.frombuffer(raw, f"<u{width}", n, place)
            place += n * width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def may_have(self, key: bytes) -> bool:
        """Whether the filter allows that the key is here."""
        places = _bloom_places([key], self.bits)[0]
        return bool((self.filter[places >> 3] >> (7 - (places & 7)) & 1).all())

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        found: list[np.ndarray] = []
        if not self.may_have(key):
            return found
        for k in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            rows = list(self._block(k))
            found += [ids for key_, ids in rows if key_ == key]
            if rows[-1][0] > key:
                break
        return found


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes every whole text, adds ``end_id``, and writes shards in order of doc_id; returns their list.

    Null texts count as empty; repeated rows are all kept (those of one doc_id
    in order of text). A shard's name is new for every attempt, and the list
    names those whose tasks were committed, so a lost executor does no harm.
    Columns: path, first_key, n_docs, n_ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        table = path = first = None
        for batch in chunks(batches):
            if table is None:
                where, base = _opened(folder)
                path = f"shard-{uuid.uuid4().hex}.sst"
                where.create_dir(base, recursive=True)
                out = where.open_output_stream(f"{base}/{path}")
                table = TableWriter(out)
            ids, offsets = encode(*utf8(batch.column("text")))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                key = key_of(doc_id)
                first = key if first is None else first
                table.add(key, np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)))
        if table is not None:
            table.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "first_key": first, "n_docs": table.docs, "n_ids": table.ids}], pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "path string, first_key binary, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver only sees one row for each shard.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = sorted(shards.collect(), key=lambda r: bytes(r["first_key"]))
    if not listed:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([r["n_ids"] for r in listed])]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = _opened(row["path"])
                rows: list[tuple] = []
                start = row["start"]
                with where.open_input_file(path) as file:
                    for key, ids in TableReader(file):
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    places = spark.createDataFrame([(r["path"], s) for r, s in zip(listed, before, strict=False)], "path string, start long")
    return places.repartition(len(listed)).mapInArrow(read, schema)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents to shards in the shared folder and reads them back."""
    shards = written(write_tokens(docs, tokenizer, end_id, shared_dir(spark, "tokens")), "shards")
    return read_tokens(spark, shards)
