"""Token ids in sorted-string-table files: prefix-compressed blocks, a sparse index, a Bloom filter and a footer.

File layout, all integers little-endian::

    block*      zstd frame of: entry* restart_offset:u32* n_restarts:u32
                entry = shared:u32 rest:u32 n_ids:u32, the key's last `rest` bytes, n_ids ids of u32
                (the first of every RESTART entries shares nothing with its predecessor)
    index       zstd frame of: (key_length:u32 last_key offset:u64 length:u32 tokens_before:u64)* per block
    bloom       bits of the Bloom filter over the keys
    footer      index_offset:u64 index_length:u32 bloom_offset:u64 bloom_bytes:u32 hashes:u32 entries:u64
                tokens:u64 magic:8s

A key is 1 byte (0 for a null identifier, else 1), the identifier as 8 bytes big-endian with its sign bit flipped,
and a 4-byte big-endian number that tells equal identifiers apart; so keys sort as the identifiers do.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import only_encoder
from .shared import filesystem, fresh_dir, parts_for, publish, text_bytes

MAGIC = b"SLSSTv01"
RESTART = 16
BLOCK_BYTES = 256 << 10
#: Bytes of text in a shard, about.
SHARD_BYTES = 128 << 20
#: Characters of a text by which rows of one id are dealt over shards.
FRONT = 64
BITS_PER_KEY, HASHES = 10, 7
_FOOTER = struct.Struct("<QIQIIQQ8s")


def key_of(identifier: int | None, number: int = 0) -> bytes:
    if identifier is None:
        return struct.pack(">BQI", 0, 0, number)
    return struct.pack(">BQI", 1, (identifier + (1 << 63)) & (1 << 64) - 1, number)


def identifier_of(key: bytes) -> int | None:
    there, bits, _ = struct.unpack(">BQI", key)
    return bits - (1 << 63) if there else None


def _bloom_hash(key: bytes) -> bytes:
    """Two 64-bit numbers of a key, of which all its bits in the filter follow."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _bloom_bits(pairs: np.ndarray, n_bits: int, hashes: int) -> np.ndarray:
    """Bits of the filter, a row for each row of two numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(hashes, dtype=np.uint64) * (pairs[:, 1:] | np.uint64(1))
        return (pairs[:, :1] + steps) % np.uint64(n_bits)


class Writer:
    """Writes entries in ascending key order to a stream; holds one block, the sparse index and 16 bytes per key."""

    def __init__(self, out):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=1).compress
        self.at, self.tokens, self.entries, self.block_from = 0, 0, 0, 0
        self.block, self.size, self.restarts, self.in_block, self.last = [], 0, [], 0, b""
        self.index: list[bytes] = []
        self.hashed = bytearray()

    def add(self, key: bytes, ids: bytes) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = struct.pack("<III", shared, len(key) - shared, len(ids) // 4) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.in_block += 1
        self.entries += 1
        self.tokens += len(ids) // 4
        self.last = key
        self.hashed += _bloom_hash(key)
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        raw = b"".join([*self.block, struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))])
        data = self.pack(raw)
        self.index.append(struct.pack("<I", len(self.last)) + self.last + struct.pack("<QIQ", self.at, len(data), self.block_from))
        self.out.write(data)
        self.at += len(data)
        self.block, self.size, self.restarts, self.in_block, self.block_from = [], 0, [], 0, self.tokens

    def close(self) -> None:
        if self.block:
            self._end_block()
        index = self.pack(b"".join(self.index))
        pairs = np.frombuffer(bytes(self.hashed), "<u8").reshape(-1, 2)
        n_bytes = max(8, len(pairs) * BITS_PER_KEY + 7 >> 3)
        filled = np.zeros(n_bytes, np.uint8)
        for a in range(0, len(pairs), 65_536):
            bits = _bloom_bits(pairs[a : a + 65_536], n_bytes * 8, HASHES).ravel()
            np.bitwise_or.at(filled, bits >> np.uint64(3), np.left_shift(1, bits & np.uint64(7)).astype(np.uint8))
        bloom = filled.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), n_bytes, HASHES, self.entries, self.tokens, MAGIC))


class Reader:
    """Reads a file by key (filter, binary search of index and restarts) or from front to end."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        index_at, index_length, bloom_at, bloom_bytes, self.hashes, self.entries, self.tokens, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.bloom = self._read(bloom_at, bloom_bytes)
        self.last, self.blocks, raw, at = [], [], self.unpack(self._read(index_at, index_length)), 0
        while at < len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            self.last.append(raw[at + 4 : at + 4 + n])
            self.blocks.append(struct.unpack_from("<QIQ", raw, at + 4 + n))
            at += 4 + n + 20

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        (n_restarts,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end, key = len(raw) - 4 * (n_restarts + 1), b""
        while at < end:
            shared, rest, n = struct.unpack_from("<III", raw, at)
            key = key[:shared] + raw[at + 12 : at + 12 + rest]
            at += 12 + rest
            yield key, raw[at : at + 4 * n]
            at += 4 * n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for at, length, _ in self.blocks:
            yield from self._entries(self.unpack(self._read(at, length)), 0)

    def get(self, key: bytes) -> bytes | None:
        n_bits = len(self.bloom) * 8
        bits = _bloom_bits(np.frombuffer(_bloom_hash(key), "<u8").reshape(1, 2), n_bits, self.hashes)[0].tolist()
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bits):
            return None
        k = bisect.bisect_left(self.last, key)
        if k == len(self.last):
            return None
        raw = self.unpack(self._read(*self.blocks[k][:2]))
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        restarts = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 * (n + 1))
        low, high = 0, n - 1
        while low < high:
            mid = (low + high + 1) // 2
            _, rest, _ = struct.unpack_from("<III", raw, restarts[mid])
            low, high = (mid, high) if raw[restarts[mid] + 12 : restarts[mid] + 12 + rest] <= key else (low, mid - 1)
        for found, ids in self._entries(raw, restarts[low]):
            if found >= key:
                return ids if found == key else None
        return None


def _writer(folder: str, tokenizer_path: str, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, shard = only_encoder(tokenizer_path), TaskContext.get().partitionId()
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        head = next(rows, None)
        if head is None:
            return
        info = {}

        def write(out):
            table, last, number = Writer(out), None, -1
            for i, text in (x for part in ((head,), rows) for x in part):
                number = number + 1 if number >= 0 and i == last else 0
                last = i
                table.add(key_of(i, number), encode.ids(text) + end)
            table.close()
            info.update(entries=table.entries, tokens=table.tokens, first=head[0], last=last)

        name = f"shard-{shard:06d}.sst"
        publish(folder, name, write)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((shard, pa.int64()), (name, pa.string()), *((info[k], pa.int64()) for k in ("entries", "tokens", "first", "last")))], names=["shard", "name", "entries", "tokens", "first", "last"])

    return run


def write_token_tables(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write every document's ids as sorted-string-table shards in ascending id order; returns the manifest.

    Documents are dealt by ranges of their id into shards of about SHARD_BYTES of text and sorted, so shards follow one
    another and each is one task's stream. Rows of one id are dealt on by the front of their texts, so an id that
    many rows share (or null) fills no shard. The manifest (one line per shard with its first and last id, also
    written to the folder) is the only thing the driver sees. Null texts are empty ones; a null id comes first;
    repeated ids follow in the order of their texts, and their numbers within the key begin anew in each shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(spark, text_bytes(rows, "text"), SHARD_BYTES)
    first = F.col("id").asc_nulls_first()
    dealt = rows.withColumn("front", F.substring("text", 1, FRONT)).repartitionByRange(parts, first, "front").sortWithinPartitions(first, "text")
    found = dealt.select("id", "text").mapInArrow(_writer(folder, tokenizer_path, end_id), "shard long, name string, entries long, tokens long, first long, last long").collect()
    manifest, before = [], 0
    for r in sorted(found, key=lambda r: r.shard):
        manifest.append({"name": r.name, "entries": r.entries, "tokens": r.tokens, "tokens_before": before, "first": r.first, "last": r.last})
        before += r.tokens
    publish(folder, "MANIFEST.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def _scan(folder: str):
    def run(batches):
        import pyarrow as pa

        store, path = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    rows = []
                    for key, ids in Reader(source, source.size()):
                        rows.append((identifier_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 10_000:
                            yield _rows(pa, rows)
                            rows = []
                    if rows:
                        yield _rows(pa, rows)

    return run


def _rows(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "crc"])


def read_token_tables(spark: SparkSession, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per document of the folder's shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    store, path = filesystem(folder)
    with store.open_input_file(f"{path}/MANIFEST.json") as f:
        manifest = json.loads(f.read())
    shards = spark.createDataFrame([(m["name"], m["tokens_before"]) for m in manifest], "name string, start long")
    if manifest:
        shards = shards.repartition(len(manifest))
    found = shards.mapInArrow(_scan(folder), "id long, start long, n_tokens long, crc long")
    return found.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def lookup(folder: str, identifiers: list[int]) -> dict[int, np.ndarray]:
    """Ids of single documents: the manifest names the shards to ask; there a Bloom test, two binary searches, one block."""
    store, path = filesystem(folder)
    with store.open_input_file(f"{path}/MANIFEST.json") as f:
        manifest = json.loads(f.read())
    found = {}
    for m in manifest:
        wanted = [] if m["last"] is None else [i for i in identifiers if i not in found and (m["first"] is None or m["first"] <= i) and i <= m["last"]]
        if not wanted:
            continue
        with store.open_input_file(f"{path}/{m['name']}") as source:
            reader = Reader(source, source.size())
            for i in wanted:
                if (ids := reader.get(key_of(i))) is not None:
                    found[i] = np.frombuffer(ids, "<u4")
    return found


def token_tables(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids (each with `end_id` behind) as shards and read them back; see the two halves.

    Shards are whole files moved into place, so a retried task replaces its own and no other. An empty table
    writes an empty manifest and gives no rows. Columns beside id and text are not read.
    """
    folder = folder or fresh_dir(docs.sparkSession, "token-tables")
    write_token_tables(docs, folder, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return read_token_tables(docs.sparkSession, folder, id_col=id_col)
