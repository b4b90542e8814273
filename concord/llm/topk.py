"""Exact top-k search (operator 10): exhaustive term-at-a-time accumulation over blocks.

A vector is a sparse row of (term, integer weight) pairs, a term being a component's position. Candidates are
packed into blocks of ``BLOCK_ROWS``; a block keeps one posting list per term. Queries are packed into blocks
as well, and every query block meets every candidate block (a stated query set against all rows, in blocks): candidate
blocks are dealt out once, over groups, and the query blocks, the smaller side by far, go to every group, by a shuffle and never
by a broadcast. In a task, each term in turn scatters its weighted postings into dense score arrays; a partition selection
keeps the k best of the block per query, and a window merges the blocks' lists.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of
unequal length score over the terms that both have; rows with the query's own vec_id are no candidates for it;
a repeated query row is a query of its own; ties go to the smaller vec_id; vec_ids that are null take no part;
integers are exact whatever the size of a component; scores beyond the range of a long are clamped to it before they are ranked.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_count, materialise, met

BLOCK_ROWS, QUERY_ROWS = 8192, 2048
_SAFE = 1 << 23  # below it, 2**16 products stay within 62 bits
_LOW, _HIGH = -(2**63), 2**63 - 1


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and components of the rows that take part."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _weights(values, scale: float) -> np.ndarray:
    """One row per vector; short ones end in zeros. Python integers where 64 bits could overflow."""
    width = max((len(v) for v in values), default=0)
    dense = np.zeros((len(values), width))
    with np.errstate(over="ignore"):
        for i, v in enumerate(values):
            dense[i, : len(v)] = np.floor(np.asarray(v, float) * scale)
    if np.abs(dense).max(initial=0) < _SAFE and width < 1 << 16:
        return dense.astype(np.int64)
    exact = np.zeros(dense.shape, object)
    for i, j in zip(*np.nonzero(dense)):
        exact[i, j] = int(dense[i, j]) if np.isfinite(dense[i, j]) else floor(Fraction(float(values[i][j])) * Fraction(scale))
    return exact


def narrow(weights: np.ndarray) -> np.ndarray:
    """Weights as they are stored: in the fewest bytes that hold them and their negatives."""
    if weights.dtype == object:
        return weights
    most = np.abs(weights).max(initial=0)
    return weights.astype(np.int16 if most < 1 << 15 else np.int32)


def score_type(rows: np.ndarray, other: np.ndarray):
    """The type in which all sums of products of stored weights are exact; objects as they are."""
    if rows.dtype == object or other.dtype == object:
        return None
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(other).max(initial=0)) * min(rows.shape[1], other.shape[1])
    return np.int32 if most < 1 << 31 else np.int64


def postings(weights: np.ndarray) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
    """(term, rows or None for all rows, their weights) of each term in use. A list of most rows is cheaper with its zeros."""
    out = []
    for term in range(weights.shape[1]):
        column = weights[:, term]
        rows = np.flatnonzero(column)
        if 2 * len(rows) > len(column):
            out.append((term, None, np.ascontiguousarray(column)))
        elif len(rows):
            out.append((term, rows, column[rows]))
    return out


def accumulate(query: np.ndarray, lists, n: int) -> np.ndarray:
    """Scores of n candidates for one query, one term after the other."""
    small = query.dtype != object and all(w.dtype != object for _, _, w in lists)
    scores = np.zeros(n, np.result_type(query, *(w for _, _, w in lists)) if small else object)
    for term, rows, weights in lists:
        if term < len(query) and (q := query[term]) != 0:
            if not small:
                weights, q = weights.astype(object), int(q)
            if rows is None:
                scores += weights * q
            else:
                scores[rows] += weights * q
    return scores if small else np.clip(scores, _LOW, _HIGH).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of the allowed rows; ties to the smaller id."""
    rows = np.flatnonzero(allowed)
    s = scores[rows]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        rows = rows[s >= least]
        s = scores[rows]
    order = np.lexsort((ids[rows], -s))[:k]
    return [(int(ids[rows[i]]), int(s[i])) for i in order]


def _pack(rows: DataFrame, name: str, size: int, scale: float) -> DataFrame:
    """Blocks of at most ``size`` rows, as (name, data). Full blocks leave a task as soon as they are full."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        values: list = []

        def block():
            nonlocal made
            made += 1
            w = _weights(values, scale)
            return pd.DataFrame({name: [part * 1_000_000 + made], f"{name}_data": [pickle.dumps((np.array(ids, np.int64), narrow(w)))]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"]):
                ids.append(i)
                values.append(v)
                if len(ids) == size:
                    yield block()
                    ids, values = [], []
        if ids:
            yield block()

    return rows.mapInPandas(pack, f"{name} long, {name}_data binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row."""
    given = taking_part(vectors, id_col, vector_col)
    asked_rows = is_query(F.col("vec_id"))
    count = given.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked_rows).alias("asked")).first()
    blocks = _pack(given, "block", BLOCK_ROWS, scale)
    asked = materialise(_pack(given.filter(asked_rows).repartition(count["asked"] // QUERY_ROWS + 1), "asked", QUERY_ROWS, scale), "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = own = rows = None
        for batch in batches:
            for block_data, number, asked_data in zip(batch["block_data"], batch["asked"], batch["asked_data"]):
                if number != held:
                    held, (own, rows) = number, pickle.loads(asked_data)
                ids, weights = pickle.loads(block_data)
                kind = score_type(rows, weights)
                lists, wanted = (postings(weights), rows) if kind is None else (postings(weights.astype(kind)), rows.astype(kind))
                out = []
                for i, query_id in enumerate(own):
                    found = best(accumulate(wanted[i], lists, len(ids)), ids, ids != query_id, k)
                    out += [(int(query_id), int(number) * QUERY_ROWS + i, v, s) for v, s in found]
                yield pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

    pairs = met(blocks, asked, group_count(vectors.sparkSession, count["rows"], count["asked"], BLOCK_ROWS))
    partial = pairs.mapInPandas(search, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    merged = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
