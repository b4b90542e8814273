"""Best-fit packing by a grouping genetic algorithm on islands (operator 5).

Texts are encoded where they are read; only pieces (identifier, place, length, checksum) move on. Pieces of
full length are sequences of their own. The others are dealt by hash into instances of about
``instance_pieces`` pieces, each a bin-packing problem of its own with the same mix of lengths, so a task never
holds more than one instance and the loss is less than one sequence for each instance.

An instance evolves on several islands, each one Spark task over a population of its own. A chromosome is a
set of bins. Crossover injects whole well-filled bins of one parent into the other, removes bins that hold a
document twice, and best-fits the documents set free in descending order. After each epoch the elite of an
island migrates to the next one by a shuffle; the best packing of all islands counts. An island rests once it
meets the lower bound. Random choices are seeded by instance and island, so reruns agree.

Defined results: a null or empty text is its end id alone; repeated rows are packed once each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise

CAPACITY, INSTANCE_PIECES = 2048, 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, number (of its own for each piece), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .span_tokens import encoder

        encode, number = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, out = batch.column("doc_id").to_pylist(), []
            for first, ids, offsets in encode.encode(batch.column("text")):
                data = memoryview(ids.astype("<u4").tobytes())
                for i in range(len(offsets) - 1):
                    own = bytes(data[4 * offsets[i] : 4 * offsets[i + 1]]) + end
                    for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        out.append((names[first + i], number, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                        number += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "number", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return in_small_batches(given).mapInArrow(cut, "doc_id long, number long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by what is left in them; the tightest that fits comes first."""

    def __init__(self, capacity: int):
        self.capacity, self.left, self.mask = capacity, {}, 0

    def put(self, size: int) -> int | None:
        """A bin that was registered with ``add`` and has room, taken out; None for a new one."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        stack = self.left[room]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        return found

    def add(self, room: int, number: int) -> None:
        if room:
            stack = self.left.setdefault(room, [])
            if not stack:
                self.mask |= 1 << room
            stack.append(number)


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Places the items of ``order`` into ``bins``, new ones where none has room."""
    state = Bins(capacity)
    for i, fill in enumerate(fills):
        state.add(capacity - fill, i)
    for item in order:
        size = sizes[item]
        at = state.put(size)
        if at is None:
            at = len(bins)
            bins.append([])
            fills.append(0)
        bins[at].append(item)
        fills[at] += size
        state.add(capacity - fills[at], at)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's second bound: total size, with items over half the capacity apart."""
    ordered = np.sort(np.array(sizes, np.int64))
    if not len(ordered):
        return 0
    upto = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(upto[-1]) // capacity)
    half = int(np.searchsorted(ordered, capacity // 2, "right"))
    for low in {0, *ordered[:half].tolist()}:
        big = int(np.searchsorted(ordered, capacity - low, "right"))
        n, middle = len(ordered) - half, upto[half] - upto[np.searchsorted(ordered, low, "left")]
        room = (big - half) * capacity - (upto[big] - upto[half])
        best = max(best, n + max(0, -(-int(middle - room) // capacity)))
    return best


def cross(a: list[list[int]], b: list[list[int]], sizes: list[int], rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """Well-filled bins of ``b`` go whole into ``a``."""
    filled = [sum(sizes[i] for i in x) for x in b]
    good = [i for i in np.argsort(-np.array(filled), kind="stable").tolist() if filled[i] < capacity or rng.random() < 0.5][: max(1, len(b) // 2)]
    inject = [list(b[i]) for i in good if rng.random() < 0.5] or [list(b[good[0]])]
    taken = {i for x in inject for i in x}
    kept, free = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            free += [i for i in x if i not in taken]
    return settle(kept + inject, free, sizes, rng, capacity)


def settle(bins: list[list[int]], free: list[int], sizes: list[int], rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """Empties some of the least filled bins and best-fits all free items in descending order."""
    fills = [sum(sizes[i] for i in x) for x in bins]
    for i in np.argsort(fills, kind="stable").tolist()[: max(1, len(bins) // 20)]:
        if rng.random() < 0.7 and fills[i] < capacity:
            free = free + bins[i]
            bins[i], fills[i] = [], -1
    bins, fills = [x for x in bins if x], [f for f in fills if f >= 0]
    best_fit(sizes, sorted(free, key=lambda i: (-sizes[i], i)), bins, fills, capacity)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the smaller, the fitter)."""
    return len(bins), -sum((sum(sizes[i] for i in x) / capacity) ** 2 for x in bins) / max(1, len(bins))


def evolve(sizes: list[int], population: list[list[list[int]]], seed: list[int], capacity: int) -> list[list[list[int]]]:
    """The population after some generations, the best first."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(sizes, capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    while len(population) < POPULATION:
        bins: list[list[int]] = []
        noise = rng.random(len(sizes)) * (0.02 * capacity * len(population))
        best_fit(sizes, sorted(order, key=lambda i: noise[i] - sizes[i]) if population else order, bins, [], capacity)
        population = [*population, bins]
        if len(bins) <= bound:
            break
    rank = lambda p: sorted(p, key=lambda x: fitness(x, sizes, capacity))
    population = rank(population)
    for _ in range(GENERATIONS):
        if len(population[0]) <= bound or len(population) < 2:
            break
        a, b = rng.choice(len(population), 2, replace=False).tolist()
        children = [cross(population[x], population[y], sizes, rng, capacity) for x, y in ((a, b), (b, a))]
        population = rank([*population, *children])[:POPULATION]
    return population


def _chromosome(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for number, x in enumerate(bins):
        out[x] = number
    return out.tobytes()


def _bins(chromosome: bytes) -> list[list[int]]:
    numbers = np.frombuffer(chromosome, np.int32)
    out: list[list[int]] = [[] for _ in range(int(numbers.max(initial=-1)) + 1)]
    for item, number in enumerate(numbers.tolist()):
        out[number].append(item)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, instance_pieces: int = INSTANCE_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    every = materialise(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    full, short = every.filter(F.col("length") == capacity), every.filter(F.col("length") < capacity)
    instances = -(-max(1, short.count()) // instance_pieces)
    items = short.withColumn("instance", F.pmod(F.xxhash64("number"), F.lit(instances)).cast("int"))
    sizes = items.select("instance", "number", F.col("length").cast("int").alias("length"))
    sizes = sizes.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
    schema = "instance int, island int, bins int, chromosome binary"
    population = None

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame | None) -> pd.DataFrame:
        left = left.sort_values(["length", "number"], ascending=[False, True])
        lengths, given = left["length"].tolist(), [] if right is None else right.sort_values(["bins", "chromosome"])["chromosome"].tolist()
        found = evolve(lengths, [_bins(x) for x in given], [*map(int, key), len(given)], capacity) if lengths else []
        return pd.DataFrame([(key[0], key[1], len(x), _chromosome(x, len(lengths))) for x in found], columns=["instance", "island", "bins", "chromosome"])

    for epoch in range(epochs):
        grouped = sizes.groupBy("instance", "island")
        if population is None:
            grown = grouped.applyInPandas(lambda key, left: run(key, left, None), schema)
        else:
            elite = Window.partitionBy("instance", "island").orderBy("bins", "chromosome")
            best = population.withColumn("r", F.row_number().over(elite)).filter("r = 1").drop("r")
            moved = best.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            grown = grouped.cogroup(population.unionByName(moved).groupBy("instance", "island")).applyInPandas(run, schema)
        population = materialise(grown, f"population-{epoch}")
    winner = Window.partitionBy("instance").orderBy("bins", "island", "chromosome")
    best = population.withColumn("r", F.row_number().over(winner)).filter("r = 1").select("instance", "chromosome")

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "number"], ascending=[False, True])
        left["bin"] = np.frombuffer(right["chromosome"].iloc[0], np.int32)
        left["offset"] = left.groupby("bin")["length"].cumsum() - left["length"]
        left["sequence_id"] = (int(key[0]) << 32) + left["bin"].astype("int64")
        return left[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = items.groupBy("instance").cogroup(best.groupBy("instance")).applyInPandas(assign, out)
    # a piece of full length is a sequence of its own, numbered below zero
    lone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("number") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(lone)
