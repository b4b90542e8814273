"""Media columns with content-defined chunking of payloads (operator 6).

A text becomes 8-bit mono PCM in a WAVE container; that medium is cut where a rolling gear hash over its bytes
has twelve zero bits, with least and greatest lengths. Each task writes the chunks it sees for the first time,
compressed, to a pack file of its own in the shared folder and returns one row for each chunk: its SHA-256 and its
place. Spark joins the digests of all tasks: of equal chunks one place counts, and a document's ordered chunk
list names those places only. Reading back follows the lists, checks every digest and parses the container.
``compact`` rewrites the packs without the chunks that no list names.

No payload is shuffled. A pack gets its name when complete, and only files named by finished tasks are read.

Defined results: a null text counts as empty, and an empty one has 64 zero bytes; repeated rows share all
chunks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, in_small_batches, materialise, partitions, shared_dir
from .wordbytes import slices

UNIT, RATE, HEADER = 64, 8000, 44
LEAST, MOST, MASK = 1024, 16384, np.uint64(0xFFF << 52)
_GEAR = np.random.default_rng(6).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Digests that a task remembers in order not to write a chunk twice; later ones are left to the join.
REMEMBERED = 500_000


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of the last 64 bytes' gear numbers, each shifted by its age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint64(step)
    return h


def cuts(n: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of a medium of n bytes; ``places`` are the ends that the hash allows."""
    out, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > MOST:
            at += MOST
            out.append(at)
        if p - at >= LEAST:
            at = p
            out.append(at)
    if at < n:
        out.append(n)
    return out


def to_media(payload: bytes) -> bytes:
    """WAVE, PCM, one channel of 8 bits."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_media(media: bytes) -> bytes:
    head = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (head[0], head[2], head[10], head[11]) != (b"RIFF", b"WAVE", 8, b"data") or head[12] != len(media) - HEADER:
        raise ValueError("this is no medium of 8-bit samples")
    return media[HEADER:]


def features(payload: bytes) -> str:
    """Mean square around the middle level, crossings of it, peaks and the number of silent frames of 64 samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    silent = int(np.count_nonzero((x.reshape(-1, UNIT) == -128).all(1)))
    return f"ms={int((x * x).sum(dtype=np.int64) // len(x))};zc={crossings};min={int(x.min())};max={int(x.max())};silent={silent}"


def chunk_media(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the packs; one row for each chunk: row, doc_id, n_bytes, seq, digest, length, pack, place, packed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        pack, squeeze = f"{part}-{uuid.uuid4().hex[:10]}", zstandard.ZstdCompressor(level=3)
        sink, at, row, seen = None, 0, part << 40, {}
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                out, media, sizes = [], [], []
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    sizes.append(len(text))
                    media.append(to_media(text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))))
                whole = np.frombuffer(b"".join(media), np.uint8)
                allowed = np.flatnonzero((gear(whole) & MASK) == 0) + 1
                start = 0
                for i, medium in enumerate(media):
                    low, high = np.searchsorted(allowed, (start + LEAST, start + len(medium)))
                    last = 0
                    for seq, end in enumerate(cuts(len(medium), allowed[low:high] - start)):
                        chunk = medium[last:end]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in seen:
                            if sink is None:
                                sink = fs.open_output_stream(f"{base}/.{pack}")
                            packed = squeeze.compress(chunk)
                            sink.write(packed)
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[digest] = (at, len(packed))
                            at += len(packed)
                        out.append((row, names[first + i], sizes[i], seq, digest, end - last, pack, *seen[digest]))
                        last = end
                    row, start = row + 1, start + len(medium)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["row", "doc_id", "n_bytes", "seq", "digest", "length", "pack", "place", "packed"])
        if sink is not None:
            sink.close()
            fs.move(f"{base}/.{pack}", f"{base}/{pack}")

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "row long, doc_id long, n_bytes long, seq int, digest binary, length int, pack string, place long, packed int"
    return materialise(in_small_batches(given).mapInArrow(write, schema), "chunks")


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes and the ordered list of (seq, digest, length, pack, place, packed) of each document,
    one place for equal chunks. A list is as long as its document has chunks."""
    where = F.struct("pack", "place", "packed")
    known = chunks.groupBy("digest").agg(F.min(where).alias("at"))
    named = chunks.drop("pack", "place", "packed").join(known, "digest")
    entry = F.struct("seq", "digest", "length", "at.pack", "at.place", "at.packed")
    lists = named.repartitionByRange(partitions(chunks.sparkSession), "row").groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(entry)).alias("chunks"))
    return lists


class _Packs:
    """Open packs of a task, read in stretches; the last few stretches stay in memory."""

    STRETCH, KEPT = 1 << 20, 24

    def __init__(self, folder: str):
        self.fs, self.base = file_system(folder)
        self.open: OrderedDict = OrderedDict()
        self.held: OrderedDict = OrderedDict()

    def _file(self, pack: str):
        if pack not in self.open:
            if len(self.open) >= 16:
                self.open.popitem(last=False)[1].close()
            self.open[pack] = self.fs.open_input_file(f"{self.base}/{pack}")
        self.open.move_to_end(pack)
        return self.open[pack]

    def read(self, pack: str, place: int, n: int) -> bytes:
        out = []
        while n:
            stretch = place // self.STRETCH
            key = (pack, stretch)
            if key not in self.held:
                if len(self.held) >= self.KEPT:
                    self.held.popitem(last=False)
                self.held[key] = self._file(pack).read_at(self.STRETCH, stretch * self.STRETCH)
            self.held.move_to_end(key)
            part = self.held[key][place % self.STRETCH :][:n]
            if not part:
                raise ValueError(f"pack {pack} is too short")
            out.append(part)
            place, n = place + len(part), n - len(part)
        return b"".join(out)

    def chunk(self, entry: dict) -> bytes:
        import zstandard

        found = zstandard.ZstdDecompressor().decompress(self.read(entry["pack"], entry["place"], entry["packed"]), max_output_size=MOST)
        if hashlib.sha256(found).digest() != entry["digest"]:
            raise ValueError(f"a chunk of pack {entry['pack']} is damaged")
        return found


def read_media(lists: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes and media (the container's bytes) of each chunk list."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                media = b"".join(map(packs.chunk, batch.column("chunks")[i].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("n_bytes").slice(i, 1), pa.array([media], pa.binary())], ["doc_id", "n_bytes", "media"])

    return lists.select("doc_id", "n_bytes", "chunks").mapInArrow(read, "doc_id long, n_bytes long, media binary")


def compact(lists: DataFrame, folder: str) -> DataFrame:
    """Copies the chunks that lists name, one task for each pack's share, to new packs; the lists with their new places."""
    named = lists.select("row", "doc_id", "n_bytes", F.explode("chunks").alias("c")).select("row", "doc_id", "n_bytes", "c.*")
    once = named.select("digest", "pack", "place", "packed").distinct().repartition("pack").sortWithinPartitions("pack", "place")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, name, sink, at = _Packs(folder), f"c-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                sink = sink or packs.fs.open_output_stream(f"{packs.base}/.{name}")
                sink.write(packs.read(x["pack"], x["place"], x["packed"]))
                out.append((x["digest"], name, at, x["packed"]))
                at += x["packed"]
            if out:
                kinds = (pa.binary(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["digest", "pack", "place", "packed"])
        if sink is not None:
            sink.close()
            packs.fs.move(f"{packs.base}/.{name}", f"{packs.base}/{name}")

    moved = materialise(once.mapInArrow(copy, "digest binary, pack string, place long, packed int"), "compacted")
    return chunk_lists(named.drop("pack", "place", "packed").join(moved, "digest"))


def media_report(docs: DataFrame) -> DataFrame:
    """Digests and features of each document's medium as read back from the store."""
    folder = shared_dir(docs.sparkSession, "packs")
    lists = materialise(chunk_lists(chunk_media(docs, folder)), "chunk-lists")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(folder)
        for batch in batches:
            out = []
            for name, n, entries in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("chunks")):
                media = b"".join(map(packs.chunk, entries.as_py()))
                payload = from_media(media)
                out.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), len(entries)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _REPORT)], _NAMES)

    return lists.mapInArrow(report, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int")


_REPORT = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
