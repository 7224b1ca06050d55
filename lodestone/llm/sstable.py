"""Sorted-string-table shards of token ids.

File: data blocks, then the block index, the Bloom filter and a footer of
fixed size.  Entries of a block are in key order; each stores how many key
bytes it shares with the entry before it, the rest of the key, and its value
(little-endian unsigned 32-bit ids).  Blocks are compressed one by one.  The
index has the last key, place and size of each block, so a lookup asks the
Bloom filter, then searches the index, then reads one block.

Files are written with ``pyarrow.fs`` to the shared folder under a name of
their own attempt and then moved into place, so a task that runs again or
twice leaves one whole file.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import store, tokens

MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QQQQQQQ8s")
#: Bytes of a block before compression.
BLOCK = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Least bytes of text in a shard; larger tables get larger shards, at most MAX_SHARDS of them.
SHARD_BYTES = 16 << 20
MAX_SHARDS = 65_536


def key_bytes(doc_id: int | None) -> bytes:
    """Byte order of keys is numeric order; null comes first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = zlib.crc32(key) | zlib.crc32(key, 0x9E3779B9) << 32
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Takes keys in order; holds one block, the index and the keys' Bloom hashes."""

    def __init__(self, out, block: int = BLOCK):
        import zstandard

        self.out, self.block, self.zip = out, block, zstandard.ZstdCompressor(level=1)
        self.buf, self.last, self.at = [], b"", 0
        self.size = self.rows = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.rows and key < self.last:
            raise ValueError("keys must come in order")
        shared = 0
        if self.buf:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.buf += (entry, value)
        self.size += len(entry) + len(value)
        self.last = key
        self.rows += 1
        self.ids += len(value) // 4
        self.keys.append(key)
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.buf:
            raw = b"".join(self.buf)
            data = struct.pack("<I", zlib.crc32(raw)) + self.zip.compress(raw)
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.buf, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.index), self.rows, self.ids, MAGIC))


class Reader:
    """Random access and scans of one shard; ``file`` is open for reading and seeking."""

    def __init__(self, file):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - FOOTER.size)
        index_at, index_len, bloom_at, self.bits, blocks, self.rows, self.ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(index_at)
        raw, at = file.read(index_len), 0
        self.index: list[tuple[bytes, int, int]] = []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            place, at = _read_varint(raw, at + n)
            size, at = _read_varint(raw, at)
            self.index.append((key, place, size))
        self.lasts = [k for k, _, _ in self.index]
        file.seek(bloom_at)
        self.bloom = file.read((self.bits + 7) // 8)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size = self.index[k]
        self.file.seek(place)
        data = self.file.read(size)
        raw = self.zip.decompress(data[4:])
        if zlib.crc32(raw) != struct.unpack("<I", data[:4])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + n]
            at += n
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with that identifier; none if there is none."""
        key = key_bytes(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out, k = [], bisect.bisect_left(self.lasts, key)
        while k < len(self.index):
            for other, value in self._block(k):
                if other == key:
                    out.append(np.frombuffer(value, "<u4"))
                elif other > key:
                    return out
            k += 1
        return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """Tokenize ``docs`` and write them in ascending ``doc_id`` order; (file, rows, ids) per shard, in order.

    Ranges of rows are cut at quantiles of ``doc_id`` and the text's first
    characters, which Spark samples, so neither far identifiers nor one that
    many rows share make a shard large.  One shuffle brings each range to the
    task that sorts and writes it, entry by entry.  Null texts are empty (only
    the end id); a null id sorts first; rows with the same id are all kept, in
    order of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return []
    shards = min(MAX_SHARDS, size // shard_bytes + 1)
    by = F.asc_nulls_first("doc_id")
    dealt = docs.repartitionByRange(shards, by, F.substring("text", 1, 64)).sortWithinPartitions(by, "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = tokens.encoder(path)
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        writer = out = name = None
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = encode.batch(part.column(1).to_pylist())
                for doc_id, value in zip(part.column(0).to_pylist(), ids, strict=True):
                    if writer is None:
                        name = f"{root}/.{uuid.uuid4().hex}"
                        out = system.open_output_stream(name)
                        writer = Writer(out)
                    writer.add(key_bytes(doc_id), value + end)
        if writer is not None:
            writer.close()
            out.close()
            final = f"{root}/shard-{shard:06d}.sst"
            if system.get_file_info(final).type == fs.FileType.NotFound:
                system.move(name, final)
            else:  # another attempt of this task was done first
                system.delete_file(name)
            done.append((shard, final, writer.rows, writer.ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["shard", "file", "n_rows", "n_ids"],
        )

    rows = dealt.mapInArrow(write, "shard int, file string, n_rows bigint, n_ids bigint").collect()  # one row a shard
    return [(f"{folder}/{r['file'].rsplit('/', 1)[1]}", r["n_rows"], r["n_ids"]) for r in sorted(rows, key=lambda r: r["shard"])]


def read_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """Rows of shards in order: ``doc_id, start`` (ids before it in all shards), ``n_tokens, ids``."""
    listed, start = [], 0
    for k, (file, _, n) in enumerate(shards):
        listed.append((k, file, start))
        start += n
    table = spark.createDataFrame(listed, "k int, file string, start bigint")
    if listed:
        table = table.repartitionById(len(listed), F.col("k"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for uri, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                system, file = _open(uri)
                with system.open_input_file(file) as handle:
                    rows, size = [], 0
                    for key, value in Reader(handle).scan():
                        n = len(value) // 4
                        rows.append((key_value(key), start, n, value))
                        start += n
                        size += len(value)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return table.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def sstable(docs: DataFrame, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back; see the two functions."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, store.fresh(spark, "sstable"), path, end_id, shard_bytes))
