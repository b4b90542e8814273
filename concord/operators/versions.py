"""Stored rules and contracts under a batch of changes: insert, update guarded by the version that was read, delete, cap an owner.

Changes take effect in order of ``pos``, but no key is walked change by change. An update that applies to version v makes v + 1,
so the next one is the first later update that expects v + 1: every update is linked to that one, in blocks of the order, and the
links from what is stored are followed by pointer doubling - rounds grow with the logarithm of the longest chain. Inserts
under a cap are a quota whose releases are deletes; whether a delete frees a place depends on whether its insert was let in, so that
scan is repeated until no refusal changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .admission import quota_with_release
from .blocks import B, G, in_blocks, within

#: Rules that an owner may keep.
MOST_RULES = 200


def _next_target(asked: DataFrame) -> DataFrame:
    """asked: key, v, pos, target (a target's own ``pos``, else null), probe. Adds ``next``, the first later target of the same key and v."""
    placed = in_blocks(asked, ["key", "v"], ["pos", "target"])
    # in falling order, what comes later in time is what came before; a probe and a target of one pos are one change
    falling = Window.partitionBy(G, B).orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("here", F.min("target").over(falling))
    firsts = placed.groupBy(G, B).agg(F.min("target").alias("first"))
    later = Window.partitionBy(G).orderBy(F.col(B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(G, B, F.min("first").over(later).alias("beyond"))
    return local.join(firsts, [G, B]).withColumn("next", F.coalesce("here", "beyond")).drop(G, B, "here", "beyond")


def apply_changes(stored: DataFrame, changes: DataFrame, cap: int = MOST_RULES) -> tuple[DataFrame, DataFrame]:
    """(stored, outcomes) after ``changes``. stored: key, owner, version, body. changes: pos (no two alike, from 0), action
    (insert, update, delete), key, owner, expected, body. An insert's key is new. Outcomes: pos, outcome - done, stale (another
    version is stored), missing (no such key of this owner) or full (the owner's cap)."""
    changes = materialise(changes.select(F.col("pos").cast("long").alias("pos"), "action", "key", "owner", F.col("expected").cast("long").alias("expected"), "body"), "changes")
    old = stored.select("key", "owner", F.col("version").cast("long").alias("version"), "body", F.lit(-1).cast("long").alias("born"))
    inserts = changes.filter("action = 'insert'").select("key", "owner", F.lit(1).cast("long").alias("version"), "body", F.col("pos").alias("born"))

    # inserts against the cap, until no refusal changes; refused inserts have no delete that frees a place
    refused, before = changes.filter("false").select("key", "owner"), -1
    while True:
        alive = materialise(old.unionByName(inserts.join(refused, ["key", "owner"], "left_anti")), "alive")
        ends = changes.filter("action = 'delete'").join(alive.select("key", "owner", "born"), ["key", "owner"]).filter("pos > born").groupBy("key", "owner").agg(F.min("pos").alias("died"))
        moves = old.select("owner", F.col("born").alias("at"), "key", F.lit(False).alias("free")).unionByName(inserts.select("owner", F.col("born").alias("at"), "key", F.lit(False).alias("free")))
        moves = moves.unionByName(ends.select("owner", F.col("died").alias("at"), "key", F.lit(True).alias("free")))
        turned = quota_with_release(moves, ["owner"], ["at", "key"], F.col("free"), cap).filter("NOT free AND NOT admitted AND at >= 0")
        refused = materialise(turned.select("key", "owner"), "refused")
        if (n := refused.count()) == before or n == 0:
            break
        before = n
    lives = materialise(old.unionByName(inserts.join(refused, ["key", "owner"], "left_anti")).join(ends, ["key", "owner"], "left"), "lives")

    # updates in the life of their key, each linked to the next one that its version allows
    updates = changes.filter("action = 'update'").join(lives.select("key", "owner", "version", "born", "died"), ["key", "owner"])
    updates = materialise(updates.filter("pos > born AND (died IS NULL OR pos < died)").select("key", "pos", "expected", "body"), "updates")
    none = F.lit(None).cast("long")
    targets = updates.select("key", F.col("expected").alias("v"), "pos", F.col("pos").alias("target"), none.alias("probe"))
    probes = updates.select("key", (F.col("expected") + 1).alias("v"), "pos", none.alias("target"), F.col("pos").alias("probe"))
    roots = lives.select("key", F.col("version").alias("v"), F.col("born").alias("pos"), none.alias("target"), F.lit(-1).cast("long").alias("probe"))
    links = materialise(_next_target(targets.unionByName(probes).unionByName(roots)).filter("probe IS NOT NULL AND next IS NOT NULL").select("key", "probe", "next"), "links")
    reached = materialise(links.filter("probe = -1").select(F.col("next").alias("pos")), "reached")
    jump, n = links.filter("probe <> -1").select(F.col("probe").alias("from"), F.col("next").alias("to")), reached.count()
    while n:
        more = materialise(reached.union(reached.join(jump, F.col("pos") == F.col("from")).select("to")).distinct(), "reached")
        if (m := more.count()) == n:
            break
        reached, n = more, m
        on = jump.select(F.col("from").alias("mid"), F.col("to").alias("far"))
        jump = materialise(jump.join(on, F.col("to") == F.col("mid")).select("from", F.col("far").alias("to")), "jump")

    done = updates.join(reached, "pos", "left_semi").groupBy("key").agg(F.max_by("body", "pos").alias("new"), F.count(F.lit(1)).alias("times"))
    now = lives.filter("died IS NULL").join(done, "key", "left")
    now = now.select("key", "owner", (F.col("version") + F.coalesce("times", F.lit(0))).alias("version"), F.when(F.col("times").isNotNull(), F.col("new")).otherwise(F.col("body")).alias("body"))
    fine = reached.select("pos").union(ends.select("died")).union(inserts.join(refused, ["key", "owner"], "left_anti").select("born")).withColumn("ok", F.lit(True))
    rows = changes.join(fine, "pos", "left").join(updates.select("pos", F.lit(True).alias("lives")), "pos", "left")
    outcome = F.when(F.col("ok"), F.lit("done")).when(F.col("action") == "insert", F.lit("full")).when(F.col("lives"), F.lit("stale")).otherwise(F.lit("missing"))
    return now, rows.select("pos", outcome.alias("outcome"))


def listed(stored: DataFrame, owner: str, most: int = MOST_RULES) -> DataFrame:
    """An owner's rows, the most recently changed first (``updated_at``)."""
    return stored.filter(F.col("owner") == owner).orderBy(F.desc("updated_at"), "key").limit(most)
