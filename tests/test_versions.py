"""Batches of changes to stored rules against a plain loop."""

import random

import pytest


def loop(stored, changes, cap):
    held, out = {k: [o, v, b] for k, o, v, b in stored}, {}
    for pos, action, key, owner, expected, body in sorted(changes):
        mine = key in held and held[key][0] == owner
        if action == "insert":
            full = sum(h[0] == owner for h in held.values()) >= cap
            out[pos] = "full" if full else "done"
            if not full:
                held[key] = [owner, 1, body]
        elif not mine:
            out[pos] = "missing"
        elif action == "delete":
            del held[key]
            out[pos] = "done"
        elif held[key][1] != expected:
            out[pos] = "stale"
        else:
            held[key][1:] = [expected + 1, body]
            out[pos] = "done"
    return {(k, *v) for k, v in held.items()}, out


def batch(seed):
    r = random.Random(seed)
    stored = [(f"k{i}", f"o{i % 3}", r.randrange(1, 4), "first") for i in range(12)]
    changes = []
    for pos in range(220):
        key = r.choice([f"k{r.randrange(14)}", f"new{r.randrange(max(1, pos))}"])
        owner = f"o{int(key[1:]) % 3}" if key[0] == "k" and r.random() < 0.9 else f"o{r.randrange(3)}"
        action = r.choices(["update", "insert", "delete"], [8, 2, 1])[0]
        changes.append((pos, action, f"new{pos}" if action == "insert" else key, owner, r.randrange(1, 9), f"b{pos}"))
    for key, start in (("long", 1), ("one", 1)):  # chains of 20 and of 1, with stale branches
        stored.append((key, "o0", start, "first"))
        steps = 20 if key == "long" else 1
        for i in range(steps):
            changes += [(1000 + 10 * len(changes), "update", key, "o0", start + i, f"{key}{i}"), (1005 + 10 * len(changes), "update", key, "o0", start + i, "late")]
    return stored, changes


@pytest.mark.parametrize(("seed", "cap"), [(1, 7), (2, 200)])
def test_changes(spark, seed, cap):
    from concord.operators.versions import apply_changes

    stored, changes = batch(seed)
    want, said = loop(stored, changes, cap)
    assert {"done", "stale", "missing"} <= set(said.values()) and ("full" in said.values()) == (cap == 7)
    frames = spark.createDataFrame(stored, "key string, owner string, version long, body string"), spark.createDataFrame(changes, "pos long, action string, key string, owner string, expected long, body string").repartition(3)
    now, outcomes = apply_changes(*frames, cap)
    assert {tuple(r) for r in now.collect()} == want
    assert {r["pos"]: r["outcome"] for r in outcomes.collect()} == said
    assert max(v for _, _, v, _ in want) >= 21


def test_no_changes(spark):
    from concord.operators.versions import apply_changes

    stored = spark.createDataFrame([("a", "o", 3, "x")], "key string, owner string, version long, body string")
    now, outcomes = apply_changes(stored, spark.createDataFrame([], "pos long, action string, key string, owner string, expected long, body string"))
    assert [tuple(r) for r in now.collect()] == [("a", "o", 3, "x")] and outcomes.collect() == []
