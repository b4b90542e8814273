"""Mixing and exact search against plain versions and by their stated properties; checksums of secrets."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from . import brute
from .fixtures import SCHEMA, documents, frame


def plain_targets(sizes):
    """source -> target, by giving out the budget again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    return target


def test_mix(spark):
    from concord.llm.mixing import mix, mix_report

    docs = documents()
    sizes, by_id = Counter(), defaultdict(list)
    for d in docs:
        n = len(brute.WORD.findall(d[1] or ""))
        sizes[d[3]] += n
        by_id[d[0]].append(n)
    want = plain_targets(sizes)
    got = mix(frame(spark, docs, False)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    taken = Counter()
    for r in got:
        assert r["size"] in by_id[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1  # the boundary document is cut to the word
    for s in sizes:  # whole epochs first: within a source, takes differ by one epoch at most
        epochs = {r["taken"] // r["size"] for r in got if r["source"] == s and r["size"]}
        assert max(epochs) - min(epochs) <= 1
    again = mix_report(frame(spark, docs).repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)
    assert mix_report(frame(spark, [])).collect() == []


def test_targets_of_many_sources_below_their_limits(spark):
    from concord.llm.mixing import source_targets

    for sizes in ({f"src{i}": 900 + 37 * (i * 7 % 20) for i in range(20)} | {None: 500, "": 0}, {"a": 10, "b": 10, "c": 10}, {"a": 7, "b": 100_000, "c": 3, "d": 0}):
        want = plain_targets(sizes)
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
        assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values())) and all(0 <= got[s] <= 2 * sizes[s] for s in sizes)


def test_ranges_are_bounded_whatever_the_weights(spark):
    from concord.llm.mixing import in_ranges, mix

    rows = [(i, "1 " * 3, "en", "a", 1) for i in range(6000)] + [(None, "2 2", "en", "a", 1)] * 3000  # weights near 0.25, and one tie of a third of all rows
    docs = spark.createDataFrame(rows, SCHEMA)
    ranked = mix(docs, rows_per_bucket=500).selectExpr("'=a' as group", "rank_key", "doc_id", "size")
    counts = [r["count"] for r in in_ranges(ranked, ["group", "rank_key", "doc_id", "size"], 500).groupBy("bucket").count().collect()]
    assert sum(counts) == 9000 and max(counts) < 1000
    few = Counter(map(tuple, mix(docs, rows_per_bucket=500).select("doc_id", "taken").collect()))
    assert few == Counter(map(tuple, mix(docs, rows_per_bucket=10**6).select("doc_id", "taken").collect()))


def test_mixed_documents_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    from concord.llm.mixing import mix_report, mixed_documents

    docs = frame(spark, documents(), False)
    names = ["_n", "_take", "_each", "_size", "_taken", "_rows", "row", "size", "low", "total", "n", "cut", "digest", "a.b"]
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = mixed_documents(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == i for r in rows for i, n in enumerate(names))
    assert sum(len(brute.WORD.findall(r["text"])) for r in rows) == sum(r["taken"] for r in mix_report(docs).collect())


def plain_top(rows, k=5, every=50):
    """(vec_id, vector) -> Counter of (query_id, rank, vec_id, score), in Python integers."""
    fine = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, v in fine:
        if q % every == 0:
            scores = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in fine if i != q)
            found = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
            out.update((q, n + 1, i, s) for n, (s, i) in enumerate(found))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k(spark, kind):
    from concord.llm.topk import top_k

    r = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(-20, 230)]
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (700, []), (750, [0.5, 0.25])]
    rows += [(i, rows[30][1]) for i in range(300, 330)] + [rows[20], rows[20], rows[70]]  # ties and repeated rows
    if kind == "double":
        rows += [(800, [1e300, -1e300]), (801, [1.7e308, 1.0]), (850, [-1.7e308] * 6), (802, [5e-324] * 6)]
    else:
        rows += [(800, [3.4e38, -3.4e38])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = top_k(df.selectExpr("*", "1 as block", "2 as asked", "3 as v", "4 as score"), lambda v: v % 50 == 0)
    rows = [(i, v and [x if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    assert Counter(map(tuple, got.collect())) == plain_top(rows)
    assert top_k(df.filter("false"), lambda v: v % 50 == 0).collect() == []
    few = top_k(df.filter("vec_id in (100, 1, 2)"), lambda v: v % 50 == 0).collect()
    assert [(x["query_id"], x["rank"]) for x in sorted(few)] == [(100, 1), (100, 2)]


def test_blocks_are_dealt_evenly(spark, monkeypatch):
    from concord.llm import topk

    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-9, 9, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.top_k(df, lambda v: v % 10 == 0).collect())) == plain_top(rows, every=10)


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def test_checksums():
    from concord.llm.secret_scan import BASE62, find_spans

    body, check, n = "aB3" * 10, "", zlib.crc32(b"aB3" * 10)
    for _ in range(6):
        n, d = divmod(n, 62)
        check = BASE62[d] + check
    for head in ("ghp_", "npm_"):
        good = head + body + check
        assert ("checked", 2, 2 + len(good)) in find_spans("é " + good)
        assert not [s for s in find_spans(head + body[::-1] + check) if s[0] == "checked"]
        assert not [s for s in find_spans(good + "x") if s[0] == "checked"]
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = BASE58[d] + key
    assert re.match("xprv", key) and ("xkey", 1, 1 + len(key)) in find_spans(f"({key})")
    bad = key[:40] + ("2" if key[40] != "2" else "3") + key[41:]
    assert not [s for s in find_spans(bad) if s[0] == "xkey"]


def test_redaction_counts_characters_anew(spark):
    from concord.llm.secret_scan import redact_secrets

    df = spark.createDataFrame([(1, "é password=hunter22", "en", "a", 99), (2, "plain", "en", "a", 99), (3, None, "en", "a", None)], SCHEMA)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact_secrets(df).collect()} == {1: ("é <secret>", 10), 2: ("plain", 99), 3: (None, None)}
