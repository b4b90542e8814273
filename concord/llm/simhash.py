"""SimHash near-duplicates by segment popcounts (operator 7).

A fingerprint's 64 bits fall into 32 segments of two bits; the popcounts of the segments embed it in a grid in
which the Manhattan distance of two points is at most their Hamming distance. Of two fingerprints at three or fewer
differing bits one half (16 segments) is at distance one at most, so its grid points are equal or differ by
one in one segment. Each distinct fingerprint goes to its own grid point and to those one step up, for each half;
whatever meets there is verified on all bits.

A grid point may hold very many fingerprints. Points with more than ``block`` are split into blocks, and every pair
of blocks is compared in a group of its own. A group gives a spanning forest of its links, never all pairs: at most
as many links as it has fingerprints, which keeps every component. Copies share a fingerprint and meet only as
one row. Components come from rounds of large and small stars over those links.

Defined results: texts without a word (null and empty ones too) have fingerprint zero and link like any other;
repeated rows give repeated rows; a null doc_id has a fingerprint and never names a component that has another
id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .wordbytes import _SPACE, rows_of, slices, words

SHINGLE, DISTANCE, SEED, BLOCK = 3, 3, 42, 2048

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span: spans of one length below 32 bytes at a time, longer ones one by one."""
    out, lengths = np.zeros(len(starts), np.uint64), ends - starts
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(34))
    for n in range(32):
        rows = order[bounds[n] : bounds[n + 1]]
        if not len(rows):
            continue
        at = starts[rows]
        h = np.full(len(rows), (seed + int(_P5) + n) & ((1 << 64) - 1), np.uint64)
        left = n
        while left >= 8:
            h = _rotate(h ^ (_rotate(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotate(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = _rotate(h ^ (padded[at].astype(np.uint64) * _P5), 11) * _P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[rows] = h ^ (h >> np.uint64(32))
    rows = order[bounds[32] :]
    out[rows] = [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The SimHash of each row of a slice."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    starts, ends = words(data, offsets)
    if not len(starts):
        return out
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    # words with one blank after each: the first white space behind a word stays, and rows get a blank between them
    keep = ~_SPACE[data]
    room = ends[ends < len(data)]
    keep[room] = True
    data[room[_SPACE[data[room]]]] = 32
    new = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, dense = new[starts], new[ends], data[keep].tobytes()
    row = rows_of(new[offsets], starts)
    # rows whose last word meets the next row's first: equal starts of rows without a word are passed over above
    counts = np.bincount(row, minlength=len(out))
    first = np.cumsum(counts) - counts
    each = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    which = np.repeat(np.arange(len(out)), each)
    begin = np.repeat(first, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    stop = np.minimum(begin + size, (first + counts)[which]) - 1
    h = xxh64(dense, starts[begin], ends[stop])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    held = np.flatnonzero(each)
    sums = np.add.reduceat(bits, (np.cumsum(each) - each)[held], axis=0, dtype=np.int64)
    over = (2 * sums > each[held][:, None]).astype(np.uint8)
    out[held] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and fp of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(data, offsets) for _, data, offsets in slices(batch.column("text"))]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp)], ["doc_id", "h", "fp"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text"))
    return in_small_batches(given).mapInArrow(run, "doc_id long, h long, fp long")


def _differing(a: np.ndarray, b) -> np.ndarray:
    """Differing bits (numpy counts those of the absolute value, so signs go first)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints within the distance."""
    left, out = np.sort(fp), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _differing(left, at) <= distance
            if near.any():
                out += [(int(at), x) for x in left[near].tolist()]
                front += list(left[near])
                left = left[~near]
    return out


def _links(keys: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Of sorted keys: the forest of each run of one key; runs of two or three at once."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, int)
    ends = np.append(starts[1:], len(keys))
    out: list[tuple[int, int]] = []
    small = ends - starts <= 3
    for gap in (1, 2):
        a = np.concatenate([starts[small & (ends - starts == n)] + i for n in (2, 3) for i in range(n - gap) if n > gap] or [np.zeros(0, int)])
        near = a[(_differing(fp[a], fp[a + gap]) <= distance) & (fp[a] != fp[a + gap])]
        out += zip(fp[near].tolist(), fp[near + gap].tolist())
    for a, b in zip(starts[~small].tolist(), ends[~small].tolist()):
        out += forest(np.unique(fp[a:b]), distance)
    return out


def near_links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """fp of distinct fingerprints -> a, b: links that join what is within the distance (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("the grid covers distances up to 3")
    points = []
    for half in (0, 1):
        x = F.shiftrightunsigned("fp", 32) if half else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        own = x - F.shiftright(x, 1).bitwiseAND(F.lit(0x55555555))  # 16 counts of 0 to 2, two bits each
        steps = [F.when(F.shiftright(own, 2 * i).bitwiseAND(F.lit(3)) < 2, own + F.lit(1 << (2 * i))) for i in range(16)]
        points += [(p * 2 + half) for p in [own, *steps]]
    spread = distinct.select("fp", F.explode(F.array_compact(F.array(*points))).alias("point"))
    crowded = materialise(spread.groupBy("point").count().filter(F.col("count") > block), "crowded")
    spread = spread.join(crowded, "point", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / F.lit(block)).cast("int"), F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    paired = spread.select("point", "fp", F.explode(met).alias("at")).select("point", "at.i", "at.j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("point", "i", "j")]
            held_key = np.concatenate([held_key, np.stack(columns, 1)])
            held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(held_key):
                continue
            last = int(np.flatnonzero((held_key != held_key[-1]).any(1))[-1]) + 1 if (held_key != held_key[-1]).any() else 0
            if last:
                yield _pairs(_links(held_key[:last], held_fp[:last], distance))
                held_key, held_fp = held_key[last:], held_fp[last:]
        yield _pairs(_links(held_key, held_fp, distance))

    together = paired.repartition("point", "i", "j").sortWithinPartitions("point", "i", "j")
    return together.mapInArrow(run, "a long, b long").distinct()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """a, b -> node, root: the smallest node of each node that is not itself the smallest of its component."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for i in range(rounds):
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (mark["n"], mark["s"])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), f"edges-{i}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, h, fp and component_id (its smallest doc_id) of each document."""
    found = materialise(with_fingerprints(docs), "fingerprints")
    each = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(each.select("fp"), distance))
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(named, "root").select("fp", "component_id"), "components")
    return found.join(named, "fp").select("doc_id", "h", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of equal ids: smallest text hash)."""
    found = near_duplicates(docs, distance)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    comp = F.when(F.col("component_id").isNull(), F.col("fp"))  # only null ids in it: by its own fingerprint
    kept = materialise(found.groupBy(F.col("component_id"), comp.alias("lone")).agg(F.min(order).alias("k")).select("k._id", "k._h"), "kept")
    rows = docs.withColumn("_row_hash", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_row_hash"] == kept["_h"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_row_hash"]).drop("_row_hash")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
