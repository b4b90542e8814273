"""Quality classifier (operator 9): histogram gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the bytes and words of whole texts. Trees grow on binned statistics:
each node's split is the best of all histogram edges by the gain of the logistic loss. A trained model is a set
of flat arrays (feature, threshold, child, value), and a whole batch walks all trees level by level in numpy.
The training sample is bounded: about ``per_class`` labelled documents of each class, chosen by a hash of doc_id; that
small set of labels is broadcast. Scoring is one pass over all documents, without a shuffle.

Defined results: null and empty texts have statistics of zero and a score like any other; several labels of one
document count by their mean; without labels of both classes the score is the share of label 1 (0.5 if none);
repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_small_batches
from .wordbytes import hashes, rows_of, slices, words

PER_CLASS, TREES, DEPTH, BINS, RATE, LAMBDA = 6000, 80, 4, 64, 0.15, 1.0
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "mark", "wide", "feeds", "other_space", "distinct", "top_word", "short", "long",
    "marked_end", "twin_end", "upper_words", "capital_words", "repeated_lines", "line_words", "runs", "repeated_pairs", "common_pair", "kinds_of_marks", "entropy",
)

_KIND = np.full(256, 4, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[:9], _KIND[14:32] = 5, 6, 6


def _share(rows: np.ndarray, n: int, total: np.ndarray, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, n)[:n] / np.maximum(total, 1)


def _repeats(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys and count of the most frequent one, for each row."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], count)
    return np.bincount(r[at], minlength=n)[:n].astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slice."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    starts, ends = words(data, offsets)
    if not len(starts):
        out[:, 0] = np.log1p(size)
        return out
    kind, doc = _KIND[data], np.repeat(np.arange(n), np.diff(offsets))
    by_kind = np.bincount(doc * 7 + kind, minlength=7 * n).reshape(n, 7)
    row, length = rows_of(offsets, starts), (ends - starts).astype(float)
    n_words = np.bincount(row, minlength=n).astype(float)
    h = hashes(data, starts, ends)
    feeds = np.bincount(doc[data == 10], minlength=n)
    distinct, top = _repeats(h, row, n)
    pair = row[1:] == row[:-1]
    pairs, common = _repeats((h[:-1] * np.uint64(3) + h[1:])[pair], row[:-1][pair], n)
    # words of a line: hash them by a sum over the line
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] + row * 0
    new_line = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))
    at = np.flatnonzero(new_line)
    line_hash = np.add.reduceat(h * np.uint64(0x9E3779B97F4A7C15), at)
    lines = np.bincount(row[at], minlength=n).astype(float)
    unlike, _ = _repeats(line_hash, row[at], n)
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
    mark = kind == 4
    marks = np.bincount(doc[mark] * 256 + data[mark], minlength=256 * n).reshape(n, 256) if mark.any() else np.zeros((n, 256))
    letters = np.concatenate([[0], np.cumsum(kind == 0)])
    upper_in = letters[ends] - letters[starts]
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    freq = np.bincount(doc * 64 + (data & 63), minlength=64 * n).reshape(n, 64) / np.maximum(size, 1)[:, None]
    columns = [
        np.log1p(size), np.log1p(n_words), _share(row, n, n_words, length), by_kind[:, 0] / np.maximum(size, 1), by_kind[:, 1] / np.maximum(size, 1),
        by_kind[:, 2] / np.maximum(size, 1), by_kind[:, 4] / np.maximum(size, 1), by_kind[:, 3] / np.maximum(size, 1), feeds / np.maximum(size, 1), (by_kind[:, 6] + by_kind[:, 5] - feeds) / np.maximum(size, 1),
        distinct / np.maximum(n_words, 1), top / np.maximum(n_words, 1), _share(row[length <= 2], n, n_words), _share(row[length >= 15], n, n_words),
        _share(row[_KIND[last] == 4], n, n_words), _share(row[(length > 1) & (_KIND[last] == 4) & (last == before)], n, n_words),
        _share(row[(upper_in == length) & (length > 1)], n, n_words), _share(row[_KIND[data[starts]] == 0], n, n_words), 1 - unlike / np.maximum(lines, 1), np.log1p(n_words / np.maximum(lines, 1)),
        _share(doc[same], n, size), 1 - pairs / np.maximum(n_words - 1, 1), common / np.maximum(n_words, 1), (marks > 0).sum(1).astype(float), -(freq * np.log(np.maximum(freq, 1e-12))).sum(1),
    ]
    return np.stack(columns, 1)


class Trees:
    """Flat arrays of all trees: node i goes to child[i] if its statistic is at most the threshold, else to the node after that.
    A leaf has feature 0, an infinite threshold and itself as child."""

    def __init__(self, roots, feature, threshold, child, value, base: float):
        self.roots, self.feature, self.child = (np.array(x, np.int32) for x in (roots, feature, child))
        self.threshold, self.value, self.base = np.array(threshold), np.array(value), base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(DEPTH):
                node = self.child[node] + (x[rows, self.feature[node]] > self.threshold[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts trees on the logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees([], [], [], [], [], float(np.log(share / (1 - share))))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    total, width = np.full(len(y), base), x.shape[1]
    roots, feature, threshold, child, value = [], [], [], [], []

    def leaf() -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(leaf())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                value[node] = RATE * float(g[rows].sum() / (h[rows].sum() + LAMBDA))
                if d == depth or len(rows) < 20:
                    total[rows] += value[node]
                    continue
                flat = (binned[rows] + np.arange(width) * BINS).ravel()
                sums_g = np.bincount(flat, np.repeat(g[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                sums_h = np.bincount(flat, np.repeat(h[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                whole_g, whole_h = sums_g[0, -1], sums_h[0, -1]
                gain = sums_g**2 / (sums_h + LAMBDA) + (whole_g - sums_g) ** 2 / (whole_h - sums_h + LAMBDA) - whole_g**2 / (whole_h + LAMBDA)
                gain[(sums_h < 1) | (whole_h - sums_h < 1)] = -1
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    total[rows] += value[node]
                    continue
                left = binned[rows, j] <= b
                feature[node], threshold[node] = j, float(edges[j][b])
                child[node] = leaf()
                leaf()
                below += [(child[node], rows[left]), (child[node] + 1, rows[~left])]
            level = below
    return Trees(roots, feature, threshold, child, value, base)


def _statistics_of(column: pa.Array) -> np.ndarray:
    found = [statistics(data, offsets) for _, data, offsets in slices(column)]
    return np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """Learns from labelled rows whose crc32 of doc_id is not 1 modulo 3; about ``per_class`` of each class."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("quality").alias("q")).select("_id", (F.col("q") >= 0.5).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(u < share).limit(2 * per_class * max(1, len(counts)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics_of(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = in_small_batches(rows).mapInArrow(run, "id long, y int, x array<double>").limit(4 * per_class * max(1, len(counts))).toPandas().sort_values(["id", "y"])
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, len(STATISTICS)))
    return train(x, got["y"].to_numpy(float))


def quality_report(docs: DataFrame, labels: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = model or fit(docs, labels)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_statistics_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return in_small_batches(given).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, model: Trees | None = None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(_statistics_of(batch.column(batch.schema.get_field_index("text")))) >= 0.5
            yield batch.filter(pa.array(good))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
