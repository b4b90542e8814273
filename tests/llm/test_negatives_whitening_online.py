"""Hard negatives, whitening and online packing against plain versions."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from . import brute
from .fixtures import documents, frame

CLASH = "'x' as block, 'x' as asked, 'x' as v, 'x' as x, 'x' as n, 'x' as rank, 'x' as place, 'x' as i, 'x' as component, 'x' as part, 'x' as ids, 'x' as length"


def vectors(kind="float"):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=6)], int(r.integers(0, 4))) for i in range(-210, 420)]
    rows += [(500, None, 1), (600, [1.0, None] * 3, 1), (700, [float("nan")] * 6, 1), (800, [float("-inf")] + [0.0] * 5, 2), (None, [1.0] * 6, 1), (900, [1.0] * 6, None)]
    rows += [(1000, [], 1), (1001, [], 2), (1100, [0.5, 0.25], 1), (1101, [0.5, 0.25], 2), (1200, [0.0] * 6, 0), (-300, [-0.001] * 6, 3)]
    rows += [(2000 + i, rows[230][1], rows[230][2] + i % 2) for i in range(40)]  # ties
    rows += [rows[210], rows[210], rows[215], rows[310], rows[311], rows[311]]  # repeated rows, anchors among them
    rows += [(300, [2.0] * 6, 3), (7, [2.0] * 6, None)]  # one id, two rows
    if kind == "double":
        rows += [(1300, [1e300, -1e300], 0), (1301, [1.7e308, 1.0], 0), (1302, [1.7e308, 2.0], 1), (1400, [5e-324] * 6, 0)]
    return rows


def plain_negatives(rows, k=5, low=80):
    """In Python integers; a row is known by its place, so that repeats count."""
    fine = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        if i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        fine.append((i, [math.floor(256 * Fraction(x)) for x in v], label))
    out = Counter()
    for a, v, la in fine:
        if a % 100:
            continue
        scored = sorted(((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, lb) for i, w, lb in fine if i != a), key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in scored if t[2] == la][:5]:
            near = [t for t in scored if t[2] != la and low * p <= 100 * t[0] <= 100 * p][:k]
            out.update((a, pid, n, nid, p, s) for n, (s, nid, _) in enumerate(near, 1))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_hard_negatives(spark, kind):
    from pyspark.sql import functions as F

    from concord.llm.negatives import hard_negatives, shifted

    rows = vectors(kind)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    call = lambda d, **more: hard_negatives(d, lambda v: v % 100 == 0, shifted(F.col("vec_id"), F.col("label")), **more)
    want = plain_negatives(rows)
    assert len(want) > 50
    assert Counter(map(tuple, call(df.selectExpr("*", *CLASH.split(", "))).collect())) == want
    assert Counter(map(tuple, call(df.repartition(3), block_rows=50).collect())) == want
    assert call(df.filter("false")).collect() == []
    assert call(df.filter("vec_id = 100")).collect() == []
    assert call(df.withColumn("label", F.lit(None).cast("int"))).collect() == []


def test_limits_of_negatives(spark):
    """Positive scores 125 and 0 (1/16 a component is 16); limits count, one step beyond them does not."""
    from concord.llm.negatives import hard_negatives

    one = 1 / 256
    anchor = [one, one]
    rows = [(0, anchor, 1), (1, [125 * one, 0.0], 1), (2, [0.0, 0.0], 1), (3, [-one, 0.0], 1)]
    rows += [(10, [100 * one, 0.0], 2), (11, [99 * one, 0.0], 2), (12, [125 * one, 0.0], 3), (13, [126 * one, 0.0], 3), (14, [0.0, 0.0], 2), (15, [one, 0.0], 2), (16, [-one, 0.0], 2)]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lambda v: v == 0)
    assert sorted((r["positive_id"], r["rank"], r["negative_id"]) for r in got.collect()) == [(1, 1, 12), (1, 2, 10), (2, 1, 14)]


def test_scores_are_exact():
    from concord.llm.negatives import between, by_score, product

    big = np.array([[2**40, -(2**40)], [3, 2**22]])
    assert product(big, big).tolist() == [[2**63 - 1, 3 * 2**40 - 2**62], [3 * 2**40 - 2**62, 9 + 2**44]]
    scores = np.array([5, -(2**63), 2**63 - 1, 5, 0])
    assert by_score(scores, np.array([9, 1, 1, 2, 3])).tolist() == [2, 3, 0, 4, 1]
    assert between(np.array([9, 5, 5, 4, -(2**63)]), 5, 4) == (1, 4) and between(np.array([9, 5]), 4, 3) == (2, 2)


def plain_whitening(rows, k=16):
    fine = [(i, [max(-(2**52), min(2**52, math.floor(64 * Fraction(c)))) + 10**6 for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in fine), default=0)
    fine = [(i, tuple(x + [10**6] * (width - len(x)))) for i, x in fine]
    fit = sorted({x for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit]).reshape(n, width)
    values, axes = np.linalg.eigh(d.T @ d / max(n, 1))
    return fine, n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening(spark, parts):
    from concord.llm.whitening import whiten

    rows = [r for r in vectors() if r[0] is None or r[0] < 1300]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *CLASH.split(", ")).repartition(parts)
    got = whiten(df, components=4).collect()
    fine, n, sums, values, axes = plain_whitening([(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows])
    want = Counter((i, c, n, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in fine for c in range(1, 5))
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    assert all(r["identity_error"] < 1e-9 for r in got)
    by_id = defaultdict(list)
    for i, x in fine:
        by_id[i].append(x)
    sign = {}
    for r in got:
        c = r["component"] - 1
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
        if len(by_id[r["vec_id"]]) == 1:
            plain = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(by_id[r["vec_id"]][0], sums)]) @ axes[:, c] / math.sqrt(values[c]))
            if abs(plain) > 1e-3:
                assert math.isclose(abs(r["whitened"]), abs(plain), rel_tol=1e-6) and sign.setdefault(c, r["whitened"] * plain > 0) == (r["whitened"] * plain > 0)


def test_whitening_of_small_tables(spark):
    from concord.llm.whitening import whiten

    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten(make([])).collect() == [] and whiten(make([(1, None), (2, [float("nan")]), (3, [])])).collect() == []
    assert whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    got = whiten(make([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])])).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got} == {(1, 1, 3, 192**2), (2, 1, 3, 0), (3, 1, 3, 192**2)} and len(got) == 4
    far = whiten(make([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] == 1} == {2**63 - 1} and all(r["identity_error"] < 1e-4 for r in far)


def test_jacobi_keeps_small_eigenvalues():
    from concord.llm.whitening import jacobi

    values, axes = jacobi(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and np.allclose(axes, np.eye(3))
    r = np.random.default_rng(2)
    scaled = np.diag(10.0 ** -np.arange(0, 16, 2))
    base = np.eye(8) + 0.1 * (lambda b: (b + b.T) / 2)(r.normal(size=(8, 8)))
    graded = scaled @ base @ scaled  # entries from 1 to 1e-28
    values, axes = jacobi(graded)
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    # the product of the eigenvalues is the determinant, here in 80 digits
    m, det = [[Decimal(float(x)) for x in row] for row in graded], Decimal(1)
    for i in range(8):
        det *= m[i][i]
        for j in range(i + 1, 8):
            f = m[j][i] / m[i][i]
            m[j] = [a - f * b for a, b in zip(m[j], m[i])]
    product = Decimal(1)
    for v in values:
        product *= Decimal(float(v))
    assert abs(product / det - 1) < Decimal("1e-12")
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-14


def padding(rows, capacity):
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert all(0 < f <= capacity for f in fills.values())
    return sum(capacity - f for f in fills.values() if f & (f - 1)), len(fills)


def check_packing(rows, docs, ids_of, capacity):
    """Every id of every document lies in one piece; sequences have no gap; rows that repeat are told apart by their starts."""
    ids = Counter((d[0], tuple(t)) for d, t in zip(docs, ids_of))
    spans, copies = defaultdict(Counter), defaultdict(list)
    for (name, t), n in ids.items():
        copies[name].append((t, n))
    for r in rows:
        fits = [t for t, _ in copies[r["doc_id"]] if r["doc_tokens"] == len(t) and brute.crc(t[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]]
        assert fits and r["length"] > 0 and r["start"] + r["length"] <= r["doc_tokens"]
        spans[r["doc_id"], fits[0]][r["start"]] += 1
        spans[r["doc_id"], fits[0]][r["start"] + r["length"]] -= 1
    for (name, t), n in ids.items():
        steps, level = spans[name, t], 0
        for at in sorted(steps):  # every id is covered once for each time the row occurs
            level += steps[at]
            assert level == (n if at < len(t) else 0)
        assert min(steps) == 0
    for pieces in (lambda d: [d[r["sequence_id"]].append((r["offset"], r["length"])) for r in rows] and d.values())(defaultdict(list)):
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


@pytest.mark.parametrize(("capacity", "max_open", "parts"), [(4096, 2048, 1), (64, 3, 7), (1, 2048, 2)])
def test_online_packing(spark, capacity, max_open, parts):
    from concord.llm.online_packing import pack_online

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents() if capacity > 1 else [d for d in documents() if len(d[1] or "") < 300][:40]
    df = frame(spark, docs).repartition(parts)
    got = pack_online(df, path, capacity=capacity, max_open=max_open, gather=2).collect()
    check_packing(got, docs, [tuple(t) for t in brute.tokens([d[1] for d in docs], path, 2)], capacity)
    assert padding(got, capacity)[0] == 0
    assert pack_online(frame(spark, []), path).collect() == []


def test_placing_is_the_least_sum_of_squares():
    from concord.llm.online_packing import Levels

    r, capacity = np.random.default_rng(6), 40
    levels, counts = Levels(capacity), np.zeros(capacity + 1, int)
    for n in range(3000):
        size = int(r.integers(1, capacity))
        trials = []
        for level in range(capacity - size, -1, -1):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < capacity
                trials.append(((after**2).sum(), -level, after))
        best = min(trials, key=lambda t: t[:2])
        assert levels.level_for(size) == -best[1]
        full = levels.put((n, 0, bytes(4 * size), size))
        assert bool(full) == (size - best[1] == capacity)
        counts = best[2]
        counts[capacity] = 0
        assert counts.sum() == levels.n and all(len(levels.stacks.get(i, ())) == c for i, c in enumerate(counts) if i)
    assert sum(len(p[2]) // 4 for w in levels.pour() for p in w) % capacity == 0 and levels.n <= 1
