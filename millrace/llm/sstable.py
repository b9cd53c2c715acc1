"""Operator 1, token-ID output: documents as sorted-string-table shards.

A shard holds entries in ascending key order. A key is a tag byte (0: null id, 1: id), the id and
the hash of the text as 8 big-endian bytes each with the sign bit flipped, and 4 big-endian bytes
that number rows of the same id and text; so byte order is id order, nulls first, and no two rows of
any shards share a key. A value is the document's token ids as fixed-width little-endian integers.

File: data blocks, index, Bloom filter, footer.
* block: entries (shared key bytes, own key bytes, value bytes as varints; key suffix; value), then
  the offsets of restart entries (whole keys, every RESTART entries) and their number as u32;
  zstd-compressed, with a crc32 behind it.
* index (sparse: one entry a block): last key, offset, length, documents before, tokens before.
* Bloom filter over the tags and ids of keys.
* footer: fixed 80 bytes with the places of the other parts, counts, id width and a magic number.

A lookup reads the footer, asks the Bloom filter, finds the block by binary search in the index
and the entry by binary search over the block's restarts.

Every attempt of a task writes files of its own names. The driver lists those of the attempts that
Spark counted in a manifest, written last, and deletes the rest; so a task that runs again after a
lost executor, or twice at once, does no harm, and nothing is ever renamed or overwritten.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, open_fs, parts
from millrace.llm.tokens import default_tokenizer, encoder

MAGIC = b"MILLSST1"
FOOTER = struct.Struct("<QQQQQQIIQ8s8s")
RESTART, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 16, 1 << 16, 10, 7
SHARD_BYTES, MANIFEST = 256 << 20, "_SHARDS.json"


def key_prefix(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + _ordered(doc_id)


def _ordered(n: int) -> bytes:
    return struct.pack(">Q", (int(n) + (1 << 63)) & (2**64 - 1))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bloom_places(prefix: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(prefix)
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; add() wants ascending keys."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=1).compress
        self.at = self.docs = self.tokens = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.prefixes: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.body, self.restarts, self.last, self.n, self.before = bytearray(), [], b"", 0, (self.docs, self.tokens)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.body))
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.body += value
        if not self.prefixes or self.prefixes[-1] != key[:9]:
            self.prefixes.append(key[:9])
        self.last, self.n, self.docs, self.tokens = key, self.n + 1, self.docs + 1, self.tokens + len(value) // self.width
        if len(self.body) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.n:
            raw = bytes(self.body) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = self.pack(raw)
            packed += struct.pack("<I", zlib.crc32(packed))
            self.out.write(packed)
            self.index.append((self.last, self.at, len(packed), *self.before))
            self.at += len(packed)
        self._open()

    def close(self) -> None:
        self._close_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        bits = max(64, -(-len(self.prefixes) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits // 8, dtype=np.uint8)
        for p in self.prefixes:
            for i in _bloom_places(p, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, zlib.crc32(index), len(self.index), b"\0" * 8, MAGIC))
        self.at += len(index) + len(bloom) + FOOTER.size
        self.out.close()


class Reader:
    """Reads one shard: whole, block by block, or by id."""

    def __init__(self, path: str):
        fs, p = open_fs(path)
        self.f = fs.open_input_file(p)
        size = self.f.size()
        index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens, self.width, crc, blocks, _, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard")
        raw = self.f.read_at(index_n, index_at)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: damaged index")
        self.bloom = self.f.read_at(bloom_n, bloom_at)
        self.dtype = np.dtype(f"<u{self.width}")
        self.index, at = [], 0
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQQQ", raw, at + n)))
            at += n + 32
        self.last_keys = [x[0] for x in self.index]

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        import zstandard

        packed = self.f.read_at(self.index[k][2], self.index[k][1])
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError("damaged block")
        raw = zstandard.ZstdDecompressor().decompress(packed[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 * (n + 1)
        return raw[:end], list(struct.unpack_from(f"<{n}I", raw, end))

    @staticmethod
    def _scan(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._scan(self._block(k)[0], 0):
                yield key_id(key), np.frombuffer(value, dtype=self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of that document id; empty: none."""
        prefix, out = key_prefix(doc_id), []
        bits = len(self.bloom) * 8
        if not all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_places(prefix, bits)):
            return out
        for k in range(bisect.bisect_left(self.last_keys, prefix), len(self.index)):
            raw, restarts = self._block(k)
            first = bisect.bisect_left(restarts, True, key=lambda at: next(self._scan(raw, at))[0] >= prefix)
            for key, value in self._scan(raw, restarts[max(0, first - 1)]):
                if key[:9] > prefix:
                    return out
                if key[:9] == prefix:
                    out.append(np.frombuffer(value, dtype=self.dtype))
        return out


@dataclass
class Shards:
    """What write_shards() left: the folder and its shards in key order (path, docs, tokens, first key, last key)."""

    path: str
    shards: list[tuple[str, int, int, bytes, bytes]]

    @classmethod
    def open(cls, path: str) -> Shards:
        """The shards of a folder, by its manifest."""
        fs, root = open_fs(path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return cls(path, [(f"{path}/{name}", docs, tokens, bytes.fromhex(a), bytes.fromhex(b)) for name, docs, tokens, a, b in json.loads(f.read())])

    def commit(self) -> None:
        """Writes the manifest and deletes what is not in it."""
        from pyarrow.fs import FileSelector

        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names = [p.rsplit("/", 1)[1] for p, *_ in self.shards]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([(name, docs, tokens, a.hex(), b.hex()) for name, (_, docs, tokens, a, b) in zip(names, self.shards)]).encode())
        for info in fs.get_file_info(FileSelector(root)):
            if info.base_name.endswith(".sst") and info.base_name not in set(names):
                fs.delete_file(info.path)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        prefix = key_prefix(doc_id)
        return [x for p, _, _, a, b in self.shards if a[:9] <= prefix <= b[:9] for x in Reader(p).get(doc_id)]

    def read(self, spark: SparkSession) -> DataFrame:
        """Each document from the files: doc_id, start, n_tokens, ids_crc32."""
        starts, at = [], 0
        for k, (p, _, tokens, _, _) in enumerate(self.shards):
            starts.append((k, p, at))
            at += tokens
        todo = spark.createDataFrame(starts, "shard long, path string, start long").repartition(max(1, len(starts)), "shard")
        return todo.mapInArrow(_read_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for path, at in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
            rows: list[tuple] = []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

            for doc_id, ids in Reader(path):
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(rows) == 20_000:
                    yield out()
                    rows = []
            if rows:
                yield out()


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 0, shard_bytes: int = SHARD_BYTES) -> Shards:
    """Encodes every text and writes the shards in ascending order of id_col.

    One range shuffle of the texts on (id, hash of text); each range becomes one shard, or several
    of about shard_bytes. Nulls: a null text is empty, a null id comes first. Rows that repeat an
    id are all kept, in the order of their texts' hashes. An empty table gives no shard. Other
    columns are left alone. The driver gets one line a shard.
    """
    spark = docs.sparkSession
    path, model = path or fresh_path(spark, "sst"), tokenizer or default_tokenizer()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from millrace.llm.common import open_fs

        enc, part = encoder(model), TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        done, writer, last, seq, attempt = [], None, None, 0, uuid.uuid4().hex
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)

        def begin():
            nonlocal writer, name, first
            name, first = f"shard-{part:06d}-{len(done):04d}-{attempt}.sst", None
            writer = Writer(fs.open_output_stream(f"{root}/{name}"), enc.dtype.itemsize)

        def finish():
            nonlocal writer
            writer.close()
            done.append((part, len(done), f"{path}/{name}", writer.docs, writer.tokens, first, end, writer.at))
            writer = None

        name = first = end = None
        for batch in batches:
            for doc_id, h, text in zip(*(batch[c].to_pylist() for c in ("k", "h", "t"))):
                prefix = key_prefix(doc_id) + _ordered(h)
                seq = seq + 1 if prefix == last else 0
                last = prefix
                if writer is None:
                    begin()
                end = prefix + struct.pack(">I", seq)
                first = first or end
                writer.add(end, enc.ids(text) + tail)
                if writer.at >= shard_bytes:
                    finish()
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["part", "n", "path", "docs", "tokens", "first", "last", "bytes"])

    keyed = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ranged = keyed.repartitionByRange(parts(spark), "k", "h").sortWithinPartitions("k", "h").select("k", "h", "t")
    rows = ranged.mapInArrow(write, "part long, n long, path string, docs long, tokens long, first binary, last binary, bytes long").collect()
    shards = Shards(path, [(r.path, r.docs, r.tokens, bytes(r.first), bytes(r.last)) for r in sorted(rows)])
    shards.commit()
    return shards


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as shards and read back: doc_id, start, n_tokens, ids_crc32."""
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).read(spark)
