"""Query blocks and blocks of rows meet without the copies of the query blocks passing through the driver."""

from collections import Counter

import numpy as np
import pytest

from .test_mixing_and_search import plain_top


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_broadcasts_no_copies(spark, many_partitions):
    from concord.llm.topk import top_k

    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-9, 9, 4)]) for i in range(300)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0)
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)
    assert Counter(map(tuple, got.collect())) == plain_top(rows)


def test_copies_follow_the_rows_not_the_partitions(spark, many_partitions):
    from pyspark.sql import functions as F

    from concord.llm.common import GROUP_ROWS, group_count, met

    least = 4 * spark.sparkContext.defaultParallelism
    assert group_count(spark, 1000, 20, 10) == min(60, max(50, least))
    assert group_count(spark, 1000, 1000, 10) == min(60, least)
    assert group_count(spark, 1000, 20, 800) == 3 and group_count(spark, 0, 0, 10) == 1
    assert group_count(spark, 100 * GROUP_ROWS, 2 * GROUP_ROWS, 8192) == 100
    blocks, asked = spark.range(40).select(F.col("id").alias("block"), F.lit("b").alias("block_data")), spark.range(7).withColumnRenamed("id", "asked")
    pairs = Counter((x["asked"], x["block"]) for x in met(blocks, asked, 5).collect())
    assert pairs == Counter((a, b) for a in range(7) for b in range(40))


def test_scores_in_narrow_types():
    from concord.llm.topk import accumulate, narrow, postings, score_type

    r = np.random.default_rng(6)
    for most in (9, 2**15 - 1, 2**15, 2**23 - 1):
        query, rows = r.integers(-most, most + 1, (3, 70)), r.integers(-most, most + 1, (50, 70))
        query[0], rows[0], rows[1], rows[:, 3], rows[5:, 4], rows[30:, 5] = most, most, -most, 0, 0, 0
        stored, asked = narrow(rows), narrow(query)
        assert stored.dtype == (np.int16 if most < 2**15 else np.int32) and (stored == rows).all() and (asked == query).all()
        kind = score_type(asked, stored)
        lists = postings(stored.astype(kind))
        for q, plain in zip(asked.astype(kind), query):
            assert accumulate(q, lists, 50).tolist() == [sum(int(a) * int(b) for a, b in zip(plain, w)) for w in rows]


def test_negatives_broadcast_no_copies(spark, many_partitions, monkeypatch):
    from concord.llm import negatives

    from .test_negatives_whitening_online import plain_negatives

    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.integers(-9, 9, 4)], int(r.integers(0, 4))) for i in range(600)]
    plans, written = [], negatives.materialise
    monkeypatch.setattr(negatives, "materialise", lambda df, name: (plans.append(plan(df)), written(df, name))[1])
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lambda v: v % 100 == 0, negatives.shifted(*_columns("vec_id", "label")))
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)
    assert not any("Broadcast" in p for p in [*plans, plan(got)]) and sum("SortMergeJoin" in p for p in [*plans, plan(got)]) == 2


def _columns(*names):
    from pyspark.sql import functions as F

    return [F.col(n) for n in names]


def test_products_of_stored_weights_are_exact():
    from concord.llm.negatives import product
    from concord.llm.topk import narrow

    for kind in (2**15 - 1, 2**23 - 1):  # sums beyond 53 bits with 300 of the latter
        rows, other = np.full((2, 300), kind), np.full((3, 300), -(2**23 - 1))
        assert product(narrow(rows), narrow(other)).tolist() == [[-300 * kind * (2**23 - 1)] * 3] * 2
