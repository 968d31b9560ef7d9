"""Token ids in sorted string tables: immutable shards of documents ordered by their identifier.

Layout of a shard (all integers little-endian):

    blocks    entries: u16 shared key bytes, u16 own key bytes, u32 value bytes, own key bytes, value
    index     for each block: u32 offset, u32 size, u16 key length, its first key
    bloom     bits of a Bloom filter over the keys
    footer    u64 index offset, u32 blocks, u64 bloom offset, u32 bloom bits, u32 probes, u64 entries,
              u64 ids, 8 bytes magic

A key has 13 bytes: 0 for a null identifier, else 1; the identifier as 8 bytes, big-endian with the sign bit
flipped; and a u32, big-endian, that numbers rows of the same identifier. So byte order is the order of
identifiers; neighbours share most bytes and only the rest is stored, anew at each block's start. A value is u16 ids, or u32 ids behind a leading
marker entry size when an id needs it: the value's first byte says which (2 or 4).

Lookup reads, by ranges of the file, the footer, then Bloom filter and index, finds the block by binary
search and reads only it.

Writing: rows are range-partitioned by identifier, sorted inside the partition and streamed to shards
below the shared folder; a shard is written under a name of its own attempt, and only what successful
tasks report in the manifest is read, so lost or repeated attempts leave no trace in the result. To read
all, the manifest's rows are dealt out and each task opens its own shards: stored bytes are never shuffled.
Row offsets are running sums of the manifest: within a partition's shards, and over partitions.

Defined results: a null text counts as empty and yields just the end id; rows whose identifier is null
come first, under the smallest key of all; rows that share an identifier are kept and ordered by text.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import tokenizer_of
from .common import materialise, shared_folder, shuffle_partitions

MAGIC = b"SLSST\x00\x01\n"
FOOTER = struct.Struct("<QIQIIQQ8s")
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<IIH")
PROBES = 7
BITS_PER_KEY = 10


def key_of(doc_id: int | None, nth: int) -> bytes:
    """Byte order is the order of (identifier with null first, nth)."""
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">I", nth)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(prefix: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(prefix, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(PROBES)]


class Shard:
    """Builds one table in memory; the caller bounds its size."""

    def __init__(self, block_bytes: int):
        self.block_bytes = block_bytes
        self.out, self.index, self.prefixes = bytearray(), [], []
        self.start, self.last, self.entries, self.ids = 0, b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and len(self.out) - self.start >= self.block_bytes:
            self._close()
        if len(self.out) == self.start:
            self.index.append([self.start, 0, key])
            self.last = b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()
        self.out += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        if not self.prefixes or self.prefixes[-1] != key[:9]:
            self.prefixes.append(key[:9])
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)

    def _close(self) -> None:
        if self.index:
            self.index[-1][1] = len(self.out) - self.start
        self.start = len(self.out)

    def finish(self) -> bytes:
        self._close()
        at = len(self.out)
        for offset, size, key in self.index:
            self.out += INDEX.pack(offset, size, len(key)) + key
        bits = max(64, BITS_PER_KEY * len(self.prefixes))
        bloom, bloom_at = bytearray((bits + 7) // 8), len(self.out)
        for p in self.prefixes:
            for b in _probes(p, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        self.out += bloom + FOOTER.pack(at, len(self.index), bloom_at, bits, PROBES, self.entries, self.ids, MAGIC)
        return bytes(self.out)


class Table:
    """Reads a shard, either its bytes or an open file of which only the needed ranges are read."""

    def __init__(self, data: bytes | pa.NativeFile):
        if isinstance(data, bytes):
            view, size = memoryview(data), len(data)
            self.read = lambda at, n: view[at : at + n]
        else:
            size = data.size()
            self.read = lambda at, n: memoryview(data.read_at(n, at))
        if size < FOOTER.size:
            raise ValueError("not a shard of this format")
        index_at, blocks, bloom_at, self.bits, self.probes, self.entries, self.ids, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index = self.read(index_at, bloom_at - index_at)
        self.bloom = self.read(bloom_at, size - FOOTER.size - bloom_at)
        self.blocks, self.firsts, at = [], [], 0
        for _ in range(blocks):
            offset, size, n = INDEX.unpack_from(index, at)
            self.firsts.append(bytes(index[at + INDEX.size : at + INDEX.size + n]))
            self.blocks.append((offset, size))
            at += INDEX.size + n

    def scan(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.read(*self.blocks[block]), 0, b""
        while at < len(data):
            shared, own, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + bytes(data[at : at + own])
            value = data[at + own : at + own + n]
            yield key, np.frombuffer(value[1:], "<u2" if value[0] == 2 else "<u4")
            at += own + n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.scan(k)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key_of(doc_id, 0)[:9], self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of one identifier: Bloom filter, then binary search of the index, then a block."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        low, found = key_of(doc_id, 0), []
        k = max(0, bisect.bisect_right(self.firsts, low) - 1)
        while k < len(self.blocks) and self.firsts[k][:9] <= low[:9]:
            found += [v for key, v in self.scan(k) if key[:9] == low[:9]]
            k += 1
        return found


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 16 << 20, block_bytes: int = 16 << 10, partitions: int | None = None) -> DataFrame:
    """Encode, append `end_id`, write shards below `folder`; returns the manifest, a row per shard.

    One shuffle: the range partitioning of (id, text). A task holds one open shard of `shard_bytes`.
    """
    spark = df.sparkSession
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        shard, first, last, nth, end = None, b"", None, 0, struct.pack("<I", end_id)

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield from zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1).to_pylist()), strict=True)

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.sst"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(shard.finish())
            return pa.RecordBatch.from_pylist([{"part": task, "name": name, "first_key": first, "entries": shard.entries, "ids": shard.ids}])

        for batch in batches:
            for doc_id, blob in encoded(batch):
                nth = nth + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                if shard is None:
                    shard, first = Shard(block_bytes), key_of(doc_id, nth)
                ids = np.frombuffer(blob + end, "<u4")
                shard.add(key_of(doc_id, nth), ids)
                if len(shard.out) >= shard_bytes:
                    yield close()
                    shard = None
        if shard is not None:
            yield close()

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.mapInArrow(work, "part bigint, name string, first_key binary, entries bigint, ids bigint")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, from the files alone.

    `manifest` must be a stored table: it names the shards that count.
    """
    zero, before = F.lit(0), (W.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"), F.min("first_key").alias("least"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("least").rowsBetween(*before)), zero).alias("ahead"))
    own = F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("first_key").rowsBetween(*before)), zero)
    offsets = manifest.withColumn("own", own).join(parts, "part").select("name", (F.col("ahead") + F.col("own")).cast("bigint").alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    table = Table(f.read())
                found: tuple[list, list, list, list] = ([], [], [], [])
                for key, ids in table:
                    for c, v in zip(found, (id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return offsets.repartition(shuffle_partitions(spark)).mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(folder: str, manifest_rows: list, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one identifier: binary search of the shards' first keys, then inside the shard.

    `manifest_rows`: (name, first_key) of each shard, in ascending order of first_key.
    """
    store, root = fs.FileSystem.from_uri(folder)
    firsts = [bytes(k) for _, k in manifest_rows]
    k, found = max(0, bisect.bisect_right(firsts, key_of(doc_id, 0)) - 1), []
    while k < len(firsts) and firsts[k][:9] <= key_of(doc_id, 0)[:9]:
        with store.open_input_file(f"{root}/{manifest_rows[k][0]}") as f:
            found += Table(f).get(doc_id)
        k += 1
    return found


def op4_sstable(spark, sf_dir: str) -> DataFrame:
    """Every document's ids through the shards, as digests."""
    import public_tokenizers

    from .common import documents

    folder = shared_folder(spark, "shards")
    manifest = materialise(write_shards(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json")), "manifest")
    return read_shards(spark, folder, manifest)
