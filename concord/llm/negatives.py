"""Hard-negative mining by a full sort of each anchor's scores (operator 11).

Rows are packed into blocks of ``BLOCK_ROWS`` with their integer vectors, ids and labels, anchors into blocks of their own,
and every anchor block meets every block of rows (a stated query set against all rows, in blocks). Candidate blocks are dealt out once
a pass; the anchor blocks, a small share of the rows, go to each group of blocks, by a shuffle and never by a broadcast. Two passes:

1. positives: an anchor's scores over the same-label rows of a block are sorted by score and id; the blocks' first rows merge
   by a window into the anchor's positives.
2. negatives: an anchor's scores over the whole block are sorted by score and id once for all of its positives. For each positive a
   binary search finds the upper limit (the positive's own score) among the different-label rows, and the first k from there
   that stay above the lower limit are read. The first k of all blocks hold the first k of the table, and a window merges them.

So a task sorts one block's scores of one anchor at a time, and nothing that grows with the table meets in one task. Scores come from
a matrix product of doubles where every sum is below 2 ** 53 and so exact, from 64-bit or Python's integers otherwise.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a row with the
anchor's own vec_id is neither its positive nor its negative; a repeated anchor is an anchor of its own, a repeated row a
row of its own, so their results repeat; vectors of unequal length score over the components that both have; scores
beyond the range of a long are held at its ends; a negative positive score admits no negatives; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite, group_count, materialise, met
from .topk import _HIGH, _LOW, _weights, narrow

BLOCK_ROWS, ANCHOR_ROWS = 8192, 1024
POSITIVES, NEGATIVES = 5, 5
#: Lower limit of a negative's score, in hundredths of the positive's.
LOW_PERCENT = 80
#: What the second pass has to know of each positive; ``i`` is the anchor's place in its block.
_WANTED = ("i", "place", "positive_id", "positive_score")


def labelled(vectors: DataFrame, label, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and v of the rows that take part."""
    taking = finite(F.col(vector_col)) & F.col(id_col).isNotNull() & label.isNotNull()
    return vectors.filter(taking).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))


def product(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs, held within a long."""
    width = min(rows.shape[1], other.shape[1])
    a, b = rows[:, :width], other[:, :width]
    if a.dtype != object and b.dtype != object:
        most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
        if most < 1 << 53:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        if most < 1 << 63:
            return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, _LOW, _HIGH).astype(np.int64)


def by_score(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places from the highest score to the lowest, ties by id. ``~x`` falls as x rises and never overflows."""
    return np.lexsort((ids, ~scores))


def between(falling: np.ndarray, high: int, low: int) -> tuple[int, int]:
    """The part of falling scores from ``high`` down to ``low``, both included, by binary search."""
    rising = ~falling
    return int(np.searchsorted(rising, ~np.int64(high), "left")), int(np.searchsorted(rising, ~np.int64(low), "right"))


def _blocks(rows: DataFrame, name: str, size: int, scale: float) -> DataFrame:
    """Blocks of at most ``size`` rows, as (name, data of the ids, labels and weights). A full block leaves its task at once."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, pd.DataFrame()
        for batch in _and_end(batches):
            held = held if batch is None else pd.concat([held, batch], ignore_index=True) if len(held) else batch
            while len(held) >= size or (batch is None and len(held)):
                now, held = held.iloc[:size], held.iloc[size:]
                w = _weights(now["v"].tolist(), scale)
                data = (now["vec_id"].to_numpy(np.int64), now["label"].to_numpy(np.int64), narrow(w))
                yield pd.DataFrame({name: [(part << 32) + made], f"{name}_data": [pickle.dumps(data)]})
                made += 1

    return rows.mapInPandas(pack, f"{name} long, {name}_data binary")


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _each(pairs: DataFrame, look, schema: str, wanted: bool = False) -> DataFrame:
    """Rows that ``look(own id, own label, scores, ids, labels, its positives)`` gives for each anchor of each pair of blocks."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            lists = zip(*(batch[f"{c}s"] for c in _WANTED)) if wanted else [()] * len(batch)
            for data, number, asked, mine in zip(batch["block_data"], batch["asked"], batch["asked_data"], lists):
                (ids, labels, weights), (own_ids, own_labels, own) = pickle.loads(data), pickle.loads(asked)
                positives: dict[int, list[tuple[int, ...]]] = {}
                for i, *positive in zip(*mine):
                    positives.setdefault(int(i), []).append(tuple(map(int, positive)))
                out = []
                for at in range(0, len(own), 128):  # 128 anchors' scores at once
                    for i, scores in enumerate(product(own[at : at + 128], weights), at):
                        out += [(int(number), i, *row) for row in look(int(own_ids[i]), own_labels[i], scores, ids, labels, positives.get(i, ()))]
                if out:
                    yield pd.DataFrame(out, columns=names)

    return pairs.mapInPandas(search, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. ``label`` is a column, ``label`` if not given."""
    given = labelled(vectors, F.col("label") if label is None else label, id_col, vector_col)
    asked_rows = is_anchor(F.col("vec_id"))
    count = given.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked_rows).alias("asked")).first()
    groups = group_count(vectors.sparkSession, count["rows"], count["asked"], block_rows)
    blocks = materialise(_blocks(given, "block", block_rows, scale), "blocks")
    asked = materialise(_blocks(given.filter(asked_rows).repartition(count["asked"] // ANCHOR_ROWS + 1), "asked", ANCHOR_ROWS, scale), "anchors")

    def same(own_id, own_label, scores, ids, labels, _):
        rows = np.flatnonzero((labels == own_label) & (ids != own_id))
        best = rows[by_score(scores[rows], ids[rows])[:positives]]
        return [(own_id, int(ids[r]), int(scores[r])) for r in best]

    found = _each(met(blocks, asked, groups), same, "asked long, i int, anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("asked", "i").orderBy(F.col("positive_score").desc(), "positive_id")
    found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    # at most ANCHOR_ROWS * positives entries a block
    lists = found.filter("positive_score >= 0").groupBy("asked").agg(F.collect_list(F.struct(*_WANTED)).alias("all"))
    wanted = asked.join(lists.hint("merge"), "asked").select("asked", "asked_data", *(F.col(f"all.{c}").alias(f"{c}s") for c in _WANTED))

    def other(own_id, own_label, scores, ids, labels, mine):
        if not mine:
            return
        rows = np.flatnonzero((labels != own_label) & (ids != own_id))
        rows = rows[by_score(scores[rows], ids[rows])]
        falling = scores[rows]
        for place, positive_id, high in mine:
            start, stop = between(falling, high, -(-low_percent * high // 100))
            for r in rows[start : min(stop, start + negatives)]:
                yield own_id, place, positive_id, high, int(ids[r]), int(scores[r])

    schema = "asked long, i int, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    near = _each(met(blocks, materialise(wanted, "positives"), groups), other, schema, wanted=True)
    order = Window.partitionBy("asked", "i", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(vec_id, label):
    """Labels of the registered query: every seventh vector is mislabelled on purpose."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


NEGATIVES_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
