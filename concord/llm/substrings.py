"""Substring dedup with a log-structured fingerprint index (operator 4).

A window is ``width`` consecutive words. The index keeps the hashes of all windows in immutable runs: tables bucketed
and sorted by anchor, which no later batch shuffles again. The anchor of a window is the least hash of the five-word runs
inside it, so equal windows have equal anchors and about five neighbours share one; a row holds an anchor, the document's
key (doc_id) and content (a hash of its whole text) and the hashes of its windows there. A new batch of documents becomes a
run of its own and is merge-joined with the runs before it: anchors at which two contents, one of them new, have a window in
common are hits. When ``fanout`` runs have gathered they are compacted into one and dropped.

Hits are verified on the words. Each document with hits (the first of its content) gives the 128-bit BLAKE2b digest of the
words of every window at those anchors; the least key of a digest is found by a partial aggregate and joined back, so a window of
very many documents is spread over tasks (Spark's skew join), and the words of later documents' windows are marked. Copies of a
whole text (by SHA-256) need no windows: all but the first go at once.

An index that goes from call to call also keeps the texts of its batches, as later hits are verified against them; its
rows are those of one call over all batches. Rows of earlier calls are not revised, so batches come by ascending doc_id.
``drop`` removes its tables.

Defined results: null and short texts lose nothing; rows that repeat an identifier are no copies of each other;
a null doc_id counts as larger than any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise, partitions, shuffles_dropped
from .wordbytes import hashes, rows_of, slices, window_hashes, words

WIDTH, ANCHOR_WORDS, FANOUT, BATCHES = 13, 5, 4, 3
_LAST = (1 << 63) - 1


def window_anchors(h: np.ndarray, width: int, size: int = ANCHOR_WORDS) -> np.ndarray:
    """The anchor of each window, from the words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = window_hashes(h, size, 77)
    out = g[:n].copy()
    for i in range(1, width - size + 1):
        np.minimum(out, g[i : i + n], out=out)
    return out


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Hash of each word, row of each word, and which words start a window within their row."""
    starts, ends = words(data, offsets)
    h, row = hashes(data, starts, ends), rows_of(offsets, starts)
    n = max(0, len(h) - width + 1)
    return h, row, np.flatnonzero(row[:n] == row[width - 1 : width - 1 + n])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.col("text"))


def _sha(text: str) -> F.Column:
    return F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))


def fingerprints(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """anchor, key, content and the 32-bit hashes of the windows at that anchor, for each text. Copies that meet in one
    Arrow batch give the rows of the least key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, content = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "content"))
            order = np.lexsort((key, content))
            firsts = np.sort(order[np.append(True, content[order][1:] != content[order][:-1])[: len(order)]])
            key, content = key[firsts], content[firsts]
            for first, data, offsets in slices(batch.column("text").take(pa.array(firsts))):
                h, row, ok = _windows(data, offsets, width)
                a, w, r = window_anchors(h, width)[ok], short(window_hashes(h, width)[ok]), row[ok]
                order = np.lexsort((a, r))
                a, w, r = a[order], w[order], r[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                s = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(s, len(a)).astype(np.int32)), pa.array(w))
                yield pa.RecordBatch.from_arrays([pa.array(a[s].view(np.int64)), pa.array(key[first + r[s]]), pa.array(content[first + r[s]]), lists], ["anchor", "key", "content", "windows"])

    return in_small_batches(keyed.select("key", "content", "text")).mapInArrow(run, "anchor long, key long, content long, windows array<int>")


def short(w: np.ndarray) -> np.ndarray:
    """The upper half of window hashes, as the index keeps them."""
    return (w >> np.uint64(32)).astype(np.uint32).view(np.int32)


class FingerprintIndex:
    """Sorted immutable runs of window hashes by anchor, oldest first. All runs have the same buckets."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets or partitions(spark), fanout
        self.runs: list[str] = []
        self.texts: list[DataFrame] = []
        self.blind = False

    def hold(self, keyed: DataFrame) -> DataFrame:
        """Keeps the key, content and text of a batch for the verification of later ones; the kept batch."""
        self.texts.append(materialise(keyed.select("key", "content", "text"), "texts"))
        return self.texts[-1]

    def _write(self, rows: DataFrame, name: str = "windows") -> str:
        """A managed table, bucketed by anchor as all others, so that dropping it removes its files."""
        name = f"{name}_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            rows.sortWithinPartitions("anchor").write.option("compression", "zstd").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return name

    def add(self, rows: DataFrame, held: bool = False) -> DataFrame:
        """Writes a run for the batch; content and anchor wherever two contents, one of them of the batch, share a window.
        ``held``: the texts behind the rows are at hand for verification."""
        self.blind |= not held
        self.runs.append(self._write(rows.repartition(self.buckets, "anchor")))
        runs = [self.spark.table(x) for x in self.runs]
        # each step below merges sorted buckets of the same number; only windows of shared anchors are shuffled, after a partial aggregate
        spread = runs[-1].groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
        for run in runs[:-1]:
            old = run.groupBy("anchor").agg(F.min("content").alias("old_lo"), F.max("content").alias("old_hi"))
            spread = spread.join(old.hint("merge"), "anchor", "left").select("anchor", F.least("lo", "old_lo").alias("lo"), F.greatest("hi", "old_hi").alias("hi"))
        near = self._write(spread.filter("lo < hi").select("anchor"), "near")  # in the runs' buckets: found once, joined to each run
        rows = [run.join(self.spark.table(near).hint("shuffle_hash"), "anchor", "left_semi").select("anchor", "content", "windows", F.lit(run is runs[-1]).alias("new")) for run in runs]
        rows = materialise(reduce(DataFrame.unionByName, rows), "near-windows")  # a part of the runs, which are then not read again
        self.spark.sql(f"DROP TABLE {near}")
        each = rows.select("anchor", "content", "new", F.explode("windows").alias("w"))
        most = [F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("new").alias("fresh")]
        same = each.groupBy("anchor", "w").agg(*most).filter("fresh AND lo < hi")
        shared = materialise(same.select("anchor").distinct(), "shared-anchors")
        return materialise(rows.select("content", "anchor").join(shared, "anchor", "left_semi").select("content", "anchor"), "hits")

    def compact(self) -> None:
        """One run in place of all, which go. Of the rows that an anchor has for one content, that of the least key stays."""
        if len(self.runs) > 1:
            rows = self.spark.table(self.runs[0])
            for name in self.runs[1:]:  # merged bucket by bucket
                later = self.spark.table(name).select(F.col("anchor").alias("a"), F.col("content").alias("c"), F.col("key").alias("k"), F.col("windows").alias("w"))
                both = rows.join(later.hint("merge"), (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")), "full")
                mine = F.col("a").isNull() | (F.col("key") <= F.col("k"))
                pick = {"anchor": F.coalesce("anchor", "a"), "content": F.coalesce("content", "c"), "key": F.when(mine, F.col("key")).otherwise(F.col("k")), "windows": F.when(mine, F.col("windows")).otherwise(F.col("w"))}
                rows = both.select(*[x.alias(n) for n, x in pick.items()])
            rows = rows.groupBy("anchor", "content").agg(F.min_by(F.struct("key", "windows"), "key").alias("x"))
            new = self._write(rows.select("anchor", "x.key", "content", "x.windows").repartition(self.buckets, "anchor"))
            self.drop()
            self.runs = [new]

    def drop(self) -> None:
        """Removes the runs' tables and files."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def hit_windows(texts: DataFrame, hits: DataFrame, firsts: DataFrame, width: int = WIDTH) -> DataFrame:
    """d, key, content, pos of each window at an anchor that was hit, in the first document of each content: d is a digest of
    its words."""
    sets = hits.groupBy("content").agg(F.collect_set("anchor").alias("wanted")).join(firsts, "content")
    sets = sets.select(F.col("content").alias("c"), F.col("first").alias("k"), F.col("sha").alias("s"), "wanted")
    mine = (F.col("key") == F.col("k")) & (F.col("content") == F.col("c")) & (_sha("text") == F.col("s"))
    found = texts.select("key", "content", "text").join(sets, mine).select("key", "content", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, content = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "content"))
            for first, data, offsets in slices(batch.column("text")):
                starts, ends = words(data, offsets)
                h, row, ok = _windows(data, offsets, width)
                wanted = batch.column("wanted").slice(first, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False)
                held = ok[np.isin(window_anchors(h, width)[ok].view(np.int64), wanted)]
                raw = data.tobytes()
                each = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                digests = b"".join([hashlib.blake2b(b" ".join(each[p : p + width]), digest_size=16).digest() for p in held.tolist()])
                r = row[held]
                pos = held - np.searchsorted(row, np.arange(len(offsets)))[r]
                d = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(held), [None, pa.py_buffer(digests)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([d, pa.array(key[first + r]), pa.array(content[first + r]), pa.array(pos.astype(np.int32))], ["d", "key", "content", "pos"])

    return found.mapInArrow(run, "d binary, key long, content long, pos int")


def later_windows(windows: DataFrame) -> DataFrame:
    """key, content, pos of the windows whose words also start in a document with a smaller key."""
    least = windows.groupBy("d").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("d", "least")
    least = materialise(least, "least-keys")  # a plain table, so that Spark may split a skewed side of the join
    return windows.join(least, "d").filter(F.col("key") > F.col("least")).select("key", "content", "pos")


def substring_marks(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """key, sha, copy, at: documents that lose words, known by key and SHA-256 of the text, and where the windows that go
    start. The documents enter the index in ``batches`` of ascending doc_id and are judged against what it held before, too."""
    keyed = _keyed(docs)
    texts, passing = keyed, index is None
    if index is None:
        index = FingerprintIndex(docs.sparkSession)  # ends with this call, so no later one needs the texts
    elif index.blind:
        raise ValueError("the index has runs whose texts it does not hold; matches with them cannot be verified")
    else:
        keyed = index.hold(keyed)
        texts = reduce(DataFrame.unionByName, index.texts)
    ids = materialise(keyed.select("key", "content", _sha("text").alias("sha")), "contents")
    known = ids if len(index.texts) < 2 else texts.select("key", "content", _sha("text").alias("sha"))
    firsts = materialise(known.groupBy("content", "sha").agg(F.min("key").alias("first")), "firsts")
    cuts: list[int] = []
    if batches > 1:
        shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
        cuts = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, F.lit(1000)).alias("cuts")).first()["cuts"] or []))
    hits = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = keyed
        if low is not None:
            batch = batch.filter(F.col("key") > int(low))
        if high is not None:
            batch = batch.filter(F.col("key") <= int(high))
        found = index.add(fingerprints(batch, width), held=True)
        hits = found if hits is None else hits.unionByName(found)
        if len(index.runs) >= index.fanout:
            index.compact()
    if passing:
        index.drop()
    windows = materialise(hit_windows(texts, hits, firsts, width), "windows")
    spans = later_windows(windows).groupBy("key", "content").agg(F.collect_list("pos").alias("at"))
    copies = ids.join(firsts, ["content", "sha"]).filter(F.col("key") > F.col("first")).select("key", "sha").distinct()
    spans = spans.join(firsts.withColumnRenamed("first", "key"), ["key", "content"]).select("key", "sha", F.lit(False).alias("copy"), "at")
    marks = copies.select("key", "sha", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("at"))
    return materialise(marks.unionByName(spans), "marks")


def _kept(docs: DataFrame, width: int, finish, schema: str, batches: int, index: FingerprintIndex | None) -> DataFrame:
    marks = substring_marks(docs, width, batches, index).select(F.col("key").alias("k"), F.col("sha").alias("s"), "copy", "at")
    rows = _keyed(docs).join(marks, (F.col("key") == F.col("k")) & (_sha("text") == F.col("s")), "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, copies, at = batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("at")
            for first, data, offsets in slices(batch.column("text")):
                starts, ends = words(data, offsets)
                bounds, raw, out = np.searchsorted(starts, offsets).tolist(), data.tobytes(), []
                for i in range(len(offsets) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    keep = np.ones(b - a, bool)
                    if copies[first + i]:
                        keep[:] = b - a < width
                    elif copies[first + i] is not None:
                        gone = np.array(at[first + i].as_py(), np.int64)
                        keep[(gone[:, None] + np.arange(width)).ravel()] = False
                    kept = np.flatnonzero(keep) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[kept].tolist(), ends[kept].tolist())])
                    out.append((ids[first + i], b - a, b - a - len(kept), *finish(text)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], kinds)

    names = [x.split()[0] for x in schema.split(",")]
    kinds = pa.schema([(n, pa.string() if n in ("kept_sha256", "kept") else pa.int64()) for n in names])
    return rows.select("doc_id", "text", "copy", "at").mapInArrow(run, schema)


def substring_report(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return _kept(docs, width, lambda text: (hashlib.sha256(text).hexdigest(),), "doc_id long, n_words long, n_removed long, kept_sha256 string", batches, index)


def without_repeats(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words as text."""
    return _kept(docs, width, lambda text: (text.decode(),), "doc_id long, n_words long, n_removed long, kept string", batches, index)
