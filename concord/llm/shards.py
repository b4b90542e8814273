"""Token shards as sorted string tables (operator 1).

Documents are range-partitioned and sorted by (doc_id, hash of the text); each task encodes its texts and
writes shards, a new one whenever the last has reached ``shard_bytes``, so neither files nor a task's memory grow with the data.
A shard holds blocks of prefix-compressed keys with their token ids, then a sparse index of
the blocks' first keys, a Bloom filter of the keys and a footer of fixed size. A key is the identifier in eight
big-endian bytes with the sign bit turned, so bytes sort as numbers do; a null identifier is the empty key and
sorts first. A lookup reads footer, filter and index, searches the index in halves and decodes one block.

Tasks write to a file of their own and rename it when it is complete, so a task that is run again after an
executor was lost leaves whole shards only; rows of the manifest name the files that count.

Defined results: a null or empty text has the end id alone; repeated identifiers give one entry each, in the
order of the texts' hashes; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, in_small_batches, materialise, partitions, shared_dir

MAGIC = b"CSST0001"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 256 << 20
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
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
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key + b"filter") | 1
    return [(a + i * b * 0x9E3779B1) % bits for i in range(PROBES)]


class ShardWriter:
    """Takes keys in ascending order."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last, self.tokens = bytearray(), b"", b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u4").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            import zstandard

            packed = zstandard.ZstdCompressor(level=3).compress(bytes(self.block))
            self.index.append((self.first, self.at, len(packed)))
            self.sink.write(packed)
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> int:
        """Writes what closes the file; its length."""
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.tokens, zlib.crc32(index + bytes(bloom)), MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Of any seekable binary file; reads the footer, and the filter and index when first needed."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - FOOTER.size)
        self.index_at, self.index_len, self.bloom_at, self.bits, self.n_docs, self.n_tokens, self.check, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("this is no complete shard")
        source.seek(self.index_at)
        raw = source.read(size - FOOTER.size - self.index_at)
        if zlib.crc32(raw) != self.check:
            raise ValueError("the shard's index is damaged")
        self.bloom, self.index, at = raw[self.index_len :], [], 0
        while at < self.index_len:
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQ", raw, at + n)))
            at += n + 16

    def _block(self, place: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        _, at, n = self.index[place]
        self.source.seek(at)
        data, at, key = zstandard.ZstdDecompressor().decompress(self.source.read(n)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield key, np.frombuffer(data, "<u4", size // 4, at + more)
            at += more + size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for place in range(len(self.index)):
            yield from self._block(place)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of all entries of one identifier."""
        key, out = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return out
        low, high = 0, len(self.index)
        while low < high:
            middle = (low + high) // 2
            if self.index[middle][0] < key:
                low = middle + 1
            else:
                high = middle
        for place in range(max(0, low - 1), len(self.index)):
            if self.index[place][0] > key:
                break
            out += [ids for k, ids in self._block(place) if k == key]
        return out


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards below ``folder`` (shared by all executors); one row for each: part, shard (in order within the
    part), file, n_docs, n_tokens, n_bytes."""
    spark = docs.sparkSession
    n = shards or partitions(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
    ordered = ordered.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .span_tokens import encoder

        encode, part, made = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        run, writer, sink = uuid.uuid4().hex[:12], None, None

        def name() -> str:
            return f"shard-{part:06d}-{made:04d}-{run}.sst"

        def close() -> pa.RecordBatch:
            size = writer.close()
            sink.close()
            fs.move(f"{base}/.{name()}", f"{base}/{name()}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([made], pa.int32()), "file": [name()], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens], "n_bytes": [size]})

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, ids, offsets in encode.encode(batch.column("text")):
                for i in range(len(offsets) - 1):
                    if writer is None:
                        sink = fs.open_output_stream(f"{base}/.{name()}")
                        writer = ShardWriter(sink)
                    writer.add(key_of(keys[first + i]), np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)))
                    if writer.at >= shard_bytes:
                        yield close()
                        writer, made = None, made + 1
        if writer is not None:
            yield close()

    return materialise(in_small_batches(ordered).mapInArrow(write, "part int, shard int, file string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, file, start and the ids (little-endian, 32 bits each) of each entry. ``start`` counts from the manifest's column
    ``base``, the ids of all shards before this one; without that column from the shard's own beginning."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    rows, held = [], 0
                    for key, ids in ShardReader(source).scan():
                        rows.append((id_of(key), name, start, ids.tobytes()))
                        start, held = start + len(ids), held + len(ids)
                        if held > 1 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    first = F.col("base") if "base" in manifest.columns else F.lit(0).cast("long")
    return manifest.select("file", first.alias("base")).repartition(max(1, partitions(manifest.sparkSession))).mapInArrow(read, "doc_id long, file string, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "file", "start", "ids"])


def shard_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of each document, from the files as read back."""
    folder = shared_dir(docs.sparkSession, "shards")
    manifest = write_shards(docs, tokenizer_path, folder, end_id, shard_bytes=shard_bytes)
    # shards of a part are summed in the part, parts over their totals: one row for each part
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # the bases go with the files' names: the documents read are joined to nothing, so Spark has no side to misjudge and broadcast
    based = manifest.join(parts, "part").select("file", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    return read_shards(based, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "file")
