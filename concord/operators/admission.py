"""Who may go, and when: running budgets, starts an owner and day, quotas with release, and slots a fixed gap apart.

Each is an ordered scan whose step is a function of the state; steps compose, so they run in blocks of time (see ``blocks``) and
no day, owner or lane is one task:

* budget: x + n, composed by sums;
* spacing: max(t, x + gap), composed by maxima after a shift (max-plus);
* quota: x + 1 up to a cap and x - 1 down to zero, composed as clamped sums;
* spacing with a bound on the wait: a request that would wait longer takes no slot. Its steps have no small composed form, so
  blocks are run with what the block before handed on, and run again while that changes. A moment without a queue cuts the
  chain, so two or three rounds do, and only changed blocks are read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .blocks import B, G, carried, in_blocks, numbered, running_sum, within


def admit_budget(requests: DataFrame, day: str, order: Sequence[str], count: str, limit: int, block: Column | None = None) -> DataFrame:
    """Running use by day; a request is admitted while it stays within the limit."""
    used = running_sum(in_blocks(requests, [day], order, block), order, F.col(count), "used")
    return used.withColumn("admitted", F.col("used") <= limit).drop(G, B)


def admit_starts(starts: DataFrame, owner: str, day: str, run: str, order: Sequence[str], limit: int, block=None) -> DataFrame:
    """The first ``limit`` runs of each owner and day; a run counts once, at its first start. ``block`` makes a block of the
    struct ``at`` of that start."""
    once = starts.groupBy(owner, day, run).agg(F.min(F.struct(*order)).alias("at"))
    placed = in_blocks(once, [owner, day], ["at", run], None if block is None else block(F.col("at")))
    return numbered(placed, ["at", run], "turn").withColumn("admitted", F.col("turn") <= limit).drop(G, B)


def space_out(requests: DataFrame, lane: str, time: str, order: Sequence[str], gap: int, block: Column | None = None) -> DataFrame:
    """Slots at least ``gap`` apart in each lane, in order. ``order`` begins with ``time`` or something that rises with it."""
    placed = in_blocks(requests, [lane], order, block)
    w = within(order)
    local = placed.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    local = local.withColumn("slot", F.max(F.col(time) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * gap)
    # a block ends at the latest of its own last slot and what it was handed, moved by its number of requests
    ends = local.groupBy(G, B).agg(F.max("slot").alias("end"), F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy(G).orderBy(B).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(G).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("after", F.sum("m").over(upto))
    handed = ends.select(G, B, (F.max(F.col("end") - F.col("after") * gap).over(earlier) + (F.col("after") - F.col("m")) * gap).alias("_last"))
    moved = local.join(handed, [G, B]).withColumn("slot", F.greatest("slot", F.col("_last") + (F.col("_i") + 1) * gap))
    return moved.drop("_i", "_last", G, B)


def space_out_bounded(requests: DataFrame, lane: str, time: str, order: Sequence[str], gap: int, bound: int, block: Column | None = None) -> DataFrame:
    """As ``space_out``, but a request that would wait longer than ``bound`` is refused (slot null) and takes no slot."""
    placed = in_blocks(requests.withColumn("_t", F.col(time).cast("long")), [lane], order, block)
    placed = placed if block is None else materialise(placed, "requests")
    # blocks and their groups by number; one row a block
    numbers = {"b": F.dense_rank().over(Window.orderBy(G, B)).cast("long"), "g": F.dense_rank().over(Window.orderBy(G)).cast("long")}
    blocks = materialise(placed.select(G, B).distinct().withColumns(numbers), "blocks")
    named = placed.join(blocks, [G, B]).drop(G, B, "g")
    in_order = Window.partitionBy("b").orderBy(*[F.col(c) for c in order])

    def started(rows: DataFrame, state: DataFrame) -> DataFrame:
        """Rows in their order within each block, with what the block is handed; the first is marked."""
        return rows.join(state, "b").withColumn("_starts", F.row_number().over(in_order) == 1)

    def slot_of(t: int, last: int | None) -> int | None:
        slot = t if last is None or t >= last + gap else last + gap
        return slot if slot - t <= bound else None

    def end(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for part in parts:
            out = []
            for b, t, handed, starts in zip(part["b"], part["_t"], part["handed"], part["_starts"]):
                if starts:
                    out += [] if at is None else [(at, last)]
                    at, last = b, None if pd.isna(handed) else int(handed)
                last = last if (slot := slot_of(int(t), last)) is None else slot
            yield pd.DataFrame(out, columns=["b", "new"]).astype({"b": "int64", "new": "Int64"})
        if at is not None:
            yield pd.DataFrame({"b": [at], "new": pd.array([last], "Int64")})

    short = named.select("b", *dict.fromkeys([*order, "_t"]))
    state = blocks.select("g", "b", F.lit(None).cast("long").alias("handed"), F.lit(True).alias("fresh"), F.lit(None).cast("long").alias("end"))
    while True:
        again = started(short, state.filter("fresh").select("b", "handed")).select("b", "_t", "handed", "_starts").mapInPandas(end, "b long, new long")
        ended = state.join(again.withColumn("ran", F.lit(True)), "b", "left").withColumn("end", F.when(F.col("ran"), F.col("new")).otherwise(F.col("end")))
        ended = ended.withColumn("now", F.lag("end").over(Window.partitionBy("g").orderBy("b")))
        state = materialise(ended.select("g", "b", F.col("now").alias("handed"), (~F.col("now").eqNullSafe(F.col("handed"))).alias("fresh"), "end"), "state")
        if not state.filter("fresh").limit(1).count():
            break

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for part in parts:
            out = []
            for t, handed, starts in zip(part["_t"], part["handed"], part["_starts"]):
                if starts:
                    last = None if pd.isna(handed) else int(handed)
                out.append(slot := slot_of(int(t), last))
                last = last if slot is None else slot
            yield part.drop(columns=["handed", "_starts", "b"]).assign(slot=pd.array(out, "Int64"))

    whole = started(named, state.select("b", "handed"))
    return whole.mapInPandas(slots, _schema(whole, "handed", "_starts", "b") + ", slot long").drop("_t")


def _schema(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def quota_with_release(events: DataFrame, by: Sequence[str], order: Sequence[str], release: Column, limit: int, block: Column | None = None) -> DataFrame:
    """Reservations and releases in order: adds ``used`` (after the event) and ``admitted``. A reservation is admitted while
    fewer than ``limit`` are held, and only an admitted one counts; a release frees one, never below zero."""
    placed = in_blocks(events.withColumn("_free", release), by, order, block)
    # a block as one clamped sum x -> min(high, max(low, x + by)); two of them in a row are one again
    held = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(limit))
    move = lambda o: F.when(o["_free"], F.lit(-1)).otherwise(F.lit(1))
    ops = placed.groupBy(G, B).agg(F.array_sort(F.collect_list(F.struct(*order, "_free"))).alias("ops"))
    first = F.struct(F.lit(0).alias("by"), F.lit(0).alias("low"), F.lit(limit).alias("high"))
    fold = F.aggregate("ops", first, lambda a, o: F.struct((a["by"] + move(o)).alias("by"), held(a["low"] + move(o)).alias("low"), held(a["high"] + move(o)).alias("high")))
    sums = ops.select(G, B, fold.alias("f")).select(G, B, "f.*")
    handed = carried(sums, "0", lambda state, block: F.least(F.greatest(state + block["by"], block["low"]), block["high"]), "int", "handed")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = 0
        for part in parts:
            used, fine = [], []
            for free, first, starts in zip(part["_free"], part["handed"], part["_starts"]):
                x = int(first) if starts else x
                fine.append(bool(not free and x < limit))
                x = max(x - 1, 0) if free else min(x + 1, limit)
                used.append(x)
            yield part.drop(columns=["handed", "_starts"]).assign(used=used, admitted=fine)

    # the window leaves each block's rows together and in order, so they are streamed
    whole = placed.join(handed, [G, B]).withColumn("_starts", F.row_number().over(within(order)) == 1).drop(G, B)
    return whole.mapInPandas(walk, _schema(whole, "handed", "_starts") + ", used int, admitted boolean").drop("_free")
