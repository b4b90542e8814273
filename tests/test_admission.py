"""Admission in blocks against plain loops, over lanes that are hot, tied, empty, null and overloaded."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators import admission, review


def requests(seed, n=400, span=3000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lane = r.choice(["hot", "hot", "hot", "b", None])
        t = r.choice([r.randrange(span), 500, r.randrange(900, 1000)])  # ties at 500, a crowd from 900 on
        rows.append((i, lane, t, r.randrange(1, 4), r.random() < 0.35))
    return rows


SCHEMA = "id long, lane string, t long, n int, free boolean"


def by_lane(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[2], x[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("block", [None, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_admission(spark, seed, block):
    rows = requests(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cut = None if block is None else F.floor(F.col("t") / block)
    used, turn, slot, waits, quota = {}, {}, {}, {}, {}
    for lane in by_lane(rows).values():
        total, last, held, x = 0, None, None, 0
        for place, (i, _, t, n, free) in enumerate(lane, 1):
            total += n
            used[i], turn[i] = (total, total <= 200), place + 7
            last = t if last is None else max(t, last + 9)
            slot[i] = last
            at = t if held is None else max(t, held + 9)
            waits[i] = at if at - t <= 60 else None
            held = at if at - t <= 60 else held
            fine = not free and x < 3
            x = max(x - 1, 0) if free else min(x + 1, 3)
            quota[i] = (x, fine)
    assert {v is None for v in waits.values()} == {True, False}
    got = lambda frame, *c: {r["id"]: tuple(r[k] for k in c) if len(c) > 1 else r[c[0]] for r in frame.collect()}
    order = ["t", "id"]
    assert got(admission.admit_budget(df, "lane", order, "n", 200, cut), "used", "admitted") == used
    assert got(review.number_events(df, "lane", order, 7, cut), "seq") == turn
    assert got(admission.space_out(df, "lane", "t", order, 9, cut), "slot") == slot
    assert got(admission.quota_with_release(df, ["lane"], order, F.col("free"), 3, cut), "used", "admitted") == quota
    if seed == 1:
        assert got(admission.space_out_bounded(df, "lane", "t", order, 9, 60, cut), "slot") == waits
        empty = df.filter("false")
        assert admission.space_out_bounded(empty, "lane", "t", order, 9, 60, cut).collect() == []
        assert admission.quota_with_release(empty, ["lane"], order, F.col("free"), 3, cut).collect() == []


def test_first_starts(spark):
    rows = [(i, f"o{i % 2}", "d", i // 3, 100 - i) for i in range(30)]
    got = admission.admit_starts(spark.createDataFrame(rows, "id long, owner string, day string, run long, t long"), "owner", "day", "run", ["t", "id"], 4).collect()
    want = {}
    for o in ("o0", "o1"):
        first = {}
        for i, owner, _, run, t in rows:
            if owner == o:
                first[run] = min(first.get(run, (t, i)), (t, i))
        for place, run in enumerate(sorted(first, key=lambda r: (first[r], r)), 1):
            want[o, run] = (place, place <= 4)
    assert {(r["owner"], r["run"]): (r["turn"], r["admitted"]) for r in got} == want


def test_no_task_holds_a_hot_group(spark):
    """A lane of all rows is spread over the blocks; ranges cut one instant as well."""
    from concord.operators.blocks import B, in_blocks

    df = spark.range(8000).selectExpr("'one' as lane", "7 as t", "id")
    sizes = [r["count"] for r in in_blocks(df, ["lane"], ["t", "id"], ranges=4).groupBy(B).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 4000
