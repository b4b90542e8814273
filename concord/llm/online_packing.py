"""Sum-of-squares online packing (operator 13).

Texts are encoded and packed where they are read, in one pass without a shuffle. A level array counts the open windows
at each fill level. Each document goes into the level, or a new window, for which the sum of the squared counts becomes
least; ties go to the fullest level. A document longer than a window fills whole windows first and its rest is placed.

A task holds ``max_open`` open windows at most. Beyond that, and at the end of its rows, it closes them: the least full
ones are poured into the gaps of the fullest, cut where a gap ends, so that one window at most stays open. What is left
in the last window of each of ``GATHER`` neighbouring tasks (less than a window each) meets in one small group, is packed
in order, and the end is cut into sequences of powers of two, which need no padding. So no sequence is padded at all,
whatever the lengths are and over however many tasks the table is spread; the placing decides how few documents are cut.

A task's result follows from its rows in their order: a table read from files gives the same packing again, also when a
lost task is repeated. Sequence ids are the task's number and a count; those of gathered windows are negative.

Defined results: a null or empty text is its end id alone; a repeated row is packed once for each time it occurs, under its
own doc_id, a null doc_id as well; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise

CAPACITY, MAX_OPEN, GATHER = 4096, 2048, 16

#: doc_id, ids of the document before the piece, the piece's ids (32 bits each), ids of the whole document
Piece = tuple[int | None, int, bytes, int]

_NONE = -(1 << 40)


class Levels:
    """Open windows by how full they are."""

    def __init__(self, capacity: int, max_open: int = MAX_OPEN):
        self.capacity, self.max_open, self.n = capacity, max_open, 0
        self.stacks: dict[int, list[list[Piece]]] = {}
        self.into = np.ones(capacity + 1, np.int64)  # what one more window at a level adds to the sum of squares
        self.out = np.full(capacity + 1, _NONE, np.int64)  # what one window less takes from it
        self.into[capacity] = self.out[0] = 0  # a full window counts no more, a new one did not count before

    def _count(self, level: int, change: int) -> None:
        n = len(self.stacks[level])
        self.into[level], self.out[level] = 2 * n + 1, 2 * n - 1 if n else _NONE
        self.n += change

    def level_for(self, size: int) -> int:
        """The level to put ``size`` on top of; 0 is a new window."""
        rise = self.into[size:] - self.out[: self.capacity + 1 - size]
        return self.capacity - size - int(np.argmin(rise[::-1]))

    def take(self, level: int) -> list[Piece]:
        if not level:
            return []
        window = self.stacks[level].pop()
        self._count(level, -1)
        return window

    def keep(self, window: list[Piece], level: int) -> None:
        self.stacks.setdefault(level, []).append(window)
        self._count(level, 1)

    def put(self, piece: Piece) -> list[list[Piece]]:
        """The windows that become full by placing ``piece``, which is shorter than a window."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        window = [*self.take(level), piece]
        if level + size == self.capacity:
            return [window]
        self.keep(window, level + size)
        return self.pour() if self.n > self.max_open else []

    def pour(self) -> list[list[Piece]]:
        """Closes all windows but one: the full ones that come of it."""
        windows = deque((level, w) for level in sorted(self.stacks, reverse=True) for w in self.stacks[level])
        for level in self.stacks:
            self.into[level], self.out[level] = 1, _NONE
        self.stacks, self.n, full = {}, 0, []
        while len(windows) > 1:
            level, window = windows.popleft()
            while level < self.capacity and windows:
                left, donor = windows.pop()
                name, start, ids, total = donor.pop()
                n = min(len(ids) // 4, self.capacity - level)
                window.append((name, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    donor.append((name, start + n, ids[4 * n :], total))
                if donor:
                    windows.append((left - n, donor))
                level += n
            if level < self.capacity:
                windows.append((level, window))
                break
            full.append(window)
        for level, window in windows:
            self.keep(window, level)
        return full

    def last(self) -> list[Piece]:
        """The pieces of the window that ``pour`` leaves open."""
        return [piece for stack in self.stacks.values() for window in stack for piece in window]


def in_order(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows filled in order, cut where they end; the end in sequences of falling powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    sizes = [capacity] * (left // capacity)
    sizes += [1 << b for b in range(left % capacity, -1, -1) if (left % capacity) >> b & 1] if left % capacity else []
    out, todo = [], deque(pieces)
    for size in sizes:
        window, level = [], 0
        while level < size:
            name, start, ids, total = todo.popleft()
            n = min(len(ids) // 4, size - level)
            window.append((name, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                todo.appendleft((name, start + n, ids[4 * n :], total))
            level += n
        out.append(window)
    return out


def _rows(windows: list[list[Piece]], first: int, step: int = 1) -> list[tuple]:
    out = []
    for number, window in enumerate(windows):
        offset = 0
        for name, start, ids, total in window:
            out.append((name, start, len(ids) // 4, zlib.crc32(ids), total, first + step * number, offset))
            offset += len(ids) // 4
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def pack_online(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, max_open: int = MAX_OPEN, gather: int = GATHER) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .span_tokens import encoder

        encode, part, made = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        levels, end = Levels(capacity, max_open), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, full = batch.column("doc_id").to_pylist(), []
            for first, ids, offsets in encode.encode(batch.column("text")):
                data = memoryview(ids.astype("<u4").tobytes())
                for i in range(len(offsets) - 1):
                    own = bytes(data[4 * offsets[i] : 4 * offsets[i + 1]]) + end
                    total = len(own) // 4
                    whole = total - total % capacity
                    full += [[(names[first + i], at, own[4 * at : 4 * (at + capacity)], total)] for at in range(0, whole, capacity)]
                    if whole < total:
                        full += levels.put((names[first + i], whole, own[4 * whole :], total))
            if full:
                yield _batch([(*r, part, None) for r in _rows(full, (part << 40) + made)])
                made += len(full)
        full = levels.pour()
        rows = [(*r, part, None) for r in _rows(full, (part << 40) + made)]
        rest = levels.last()
        rows += [(*r, part, p[2]) for r, p in zip(_rows([rest], 0), rest)]
        if rows:
            yield _batch(rows)

    def finish(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("part", "ascending"), ("offset", "ascending")])
        given = list(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))))
        rows = _rows(in_order(given, capacity), -1 - (pieces.column("part")[0].as_py() // gather << 40), -1)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], _NAMES)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    placed = materialise(in_small_batches(given).mapInArrow(place, f"{_PIECES}, part long, ids binary"), "windows")
    groups = placed.filter("ids IS NOT NULL").select("doc_id", "start", "doc_tokens", "offset", "part", "ids")
    gathered = groups.groupBy(F.expr(f"part div {gather}")).applyInArrow(finish, _PIECES)
    return placed.filter("ids IS NULL").drop("part", "ids").unionByName(gathered)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 8, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [*_NAMES, "part", "ids"])
