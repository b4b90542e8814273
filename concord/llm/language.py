"""Language identification (operator 8): multinomial logistic regression on TF-IDF character n-grams.

A feature is an n-gram of one to three lower-cased characters, hashed into ``buckets``; its value is its share of
the text's n-grams times its inverse document frequency. Weights are trained with follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties, so most weights stay zero), then one temperature is fitted on a part of
the sample that training did not see. The sample is bounded: about ``per_label`` documents of each language, chosen
by a hash of doc_id, and at most ``SAMPLE_LABELS`` languages (the most frequent); of a text in the sample, its n-gram counts go to
the driver, at most BUCKETS of them however long the text is. Prediction is one vectorised pass over all documents, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if no labelled
row is there to learn from; repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_small_batches
from .wordbytes import mix

BUCKETS, SIZES, PER_LABEL, EPOCHS, SAMPLE_LABELS = 1 << 16, (1, 2, 3), 1000, 3, 200
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.002, 0.01, 30.0
SLICE_CHARS = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def grams(codes: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """The bucket of the n-gram that starts at each character, for each n."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in SIZES:
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        out.append((mix(h) & np.uint64(buckets - 1)).astype(np.int64))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


class LanguageModel:
    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.table, self.bias, self.temperature = labels, table, bias, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and probability of each text."""
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if t and self.labels and _LETTER.search(t)]
        at = 0
        while at < len(todo):
            part, size = [], 0
            while at < len(todo) and (not part or size + len(texts[todo[at]]) <= SLICE_CHARS):
                part.append(todo[at])
                size += len(texts[todo[at]])
                at += 1
            p = self._probabilities([_codes(texts[i]) for i in part])
            for i, row in zip(part, p):
                found[i] = self.labels[int(row.argmax())]
            score[part] = p.max(1)
        return found, score

    def _probabilities(self, codes: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(c) for c in codes])
        whole = np.concatenate(codes)
        starts = np.cumsum(lengths) - lengths
        total, logits = np.zeros(len(codes)), np.zeros((len(codes), len(self.labels)))
        for n, bucket in zip(SIZES, grams(whole)):
            counts = np.maximum(0, lengths - n + 1)
            total += counts
            held = np.flatnonzero(counts)
            inside = np.ones(len(bucket) + 1, bool)
            for k in range(1, n):  # n-grams over the end of a text
                over = starts[1:] - k
                inside[over[(over >= 0) & (over < len(bucket))]] = False
            use = bucket[inside[:-1]]
            if len(held):
                edge = (np.cumsum(counts) - counts)[held]
                logits[held] += np.add.reduceat(self.table[use], edge, axis=0, dtype=np.float64)
        z = (logits * (SCALE / np.maximum(total, 1))[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    all_grams = np.concatenate(grams(_codes(text)))
    bucket, count = np.unique(all_grams, return_counts=True)
    return bucket, count * (SCALE / len(all_grams))


def shrink(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the follow-the-regularised-leader state (z, n): zero within the L1 penalty."""
    return np.where(np.abs(a) <= L1, 0, -(a - np.sign(a) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def leader_step(z: np.ndarray, n: np.ndarray, x: np.ndarray, bias: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of a document's features and the bias after one document of class y with feature values x."""
    w = shrink(z, n)
    s = x @ w + bias
    p = np.exp(s - s.max())
    p /= p.sum()
    p[y] -= 1
    g = x[:, None] * p
    n_new = n + g * g
    return z + g - (np.sqrt(n_new) - np.sqrt(n)) / ALPHA * w, n_new, bias - 0.01 * p


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 8) -> LanguageModel:
    """Of (text, label) pairs."""
    return train_counted([(*_features(t), y) for t, y in sample if t and _LETTER.search(t)], epochs, seed)


def train_counted(sample: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS, seed: int = 8) -> LanguageModel:
    """Of (buckets, values, label), as ``_features`` gives them."""
    labels = sorted({y for _, _, y in sample})
    k = len(labels)
    if not k:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    rows = [(b, x, labels.index(y)) for b, x, y in sample]
    order = rng.permutation(len(rows)).tolist()
    held = order[: len(rows) // 5] if len(rows) >= 50 else []
    learn = order[len(held) :]
    seen = np.zeros(BUCKETS)
    for i in learn:
        seen[rows[i][0]] += 1
    idf = np.log((1 + len(learn)) / (1 + seen)) + 1
    z, n, bias = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k)

    def weights(bucket):
        return shrink(z[bucket], n[bucket])

    def logits(i):
        return (rows[i][1] * idf[rows[i][0]]) @ weights(rows[i][0]) + bias

    for _ in range(epochs):
        for i in rng.permutation(learn).tolist():
            bucket, x, y = rows[i][0], rows[i][1] * idf[rows[i][0]], rows[i][2]
            z[bucket], n[bucket], bias = leader_step(z[bucket], n[bucket], x, bias, y)
    temperature = 1.0
    if held:
        scores, truth = np.array([logits(i) for i in held]), np.array([rows[i][2] for i in held])

        def loss(t):
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())

        temperature = min(np.geomspace(0.2, 8, 60).tolist(), key=loss)
    table = (weights(np.arange(BUCKETS)) * idf[:, None]).astype(np.float32)
    return LanguageModel(labels, table, bias, temperature)


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> LanguageModel:
    """Learns from rows with a label whose crc32 of doc_id is not 2 modulo 4; about ``per_label`` of each label."""
    known = docs.filter(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LABELS).collect()}
    if not counts:
        return train([])
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_label / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, lang in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "lang"))):
                if text and _LETTER.search(text):
                    bucket, x = _features(text)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "lang": [lang], "bucket": [bucket.astype("<i4").tobytes()], "x": [x.astype("<f8").tobytes()]})

    sample = known.filter(u < share).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counted = in_small_batches(sample).mapInArrow(count, "doc_id long, lang string, bucket binary, x binary")
    rows = sorted(counted.limit(2 * per_label * len(counts)).collect(), key=lambda r: (str(r["doc_id"]), r["lang"], r["bucket"], r["x"]))
    return train_counted([(np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f8"), r["lang"]) for r in rows])


def language_report(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = model or fit(docs)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return in_small_batches(given).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
