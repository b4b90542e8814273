"""The middle of a run as one pass: records are corrected, cleaned and validated, and the pass says what it did.

Corrections by reviewers come before validation, excluded records pass through untouched, revisions rise by one where a correction
applies. Records, with their events inside, are written once, in ranges of their order; records, issues and the event stream are
read from that table. Event numbers have no gap: the counts of a range's records are summed where they are, and a prefix over the
ranges (one small row each) gives each range its first number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..storage import materialise, shared_dir
from .blocks import B, G, in_blocks, running_sum
from .issues import explanation, label_of, subject, validation_issues
from .reconcile import global_index, identity_key, merge
from .rulebook import Rules
from .validate import two_pass

EVENT = "struct<action:string,reason:string,execution_basis:string,actor:string,subject:string,before:string,after:string,errors:int>"
EXCLUDED = "Excluded by the reviewer."


def _event(action: str, reason: Column, basis: str, subject: Column, actor: str = "agent", before: Column | None = None, after: Column | None = None, errors: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(action).alias("action"), reason.alias("reason"), F.lit(basis).alias("execution_basis"), F.lit(actor).alias("actor"), subject.alias("subject"),
        (none if before is None else before).alias("before"), (none if after is None else after).alias("after"), (F.lit(None) if errors is None else errors).cast("int").alias("errors"),
    )


def corrected(records: DataFrame, corrections: DataFrame, exclusions: DataFrame, contract: Contract) -> DataFrame:
    """``records`` with the values that reviewers gave (record_id, field, value, pos; of several for one field the last) and
    ``applied``, an array of field, before and after in the order in which fields were first corrected. Excluded records keep their
    values and revision. Adds ``before``, a map of the values as they were, and ``subject``."""
    names = [f.name for f in contract.fields]
    each = corrections.filter(F.col("field").isin(*names)).groupBy("record_id", "field").agg(F.min("pos").alias("first"), F.max_by("value", "pos").alias("after"))
    # at most one entry a field of the contract
    lists = each.groupBy(F.col("record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("first", "field", "after"))).alias("given"))
    gone = exclusions.select(F.col("record_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    out = records.join(lists, "id", "left").join(gone, "id", "left")
    before = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    state = F.col("disposition") if "disposition" in records.columns else F.lit(None).cast("string")
    out = out.withColumns({"before": before, "subject": subject(contract), "excluded": F.coalesce(F.col("_gone") | (state == "excluded"), F.coalesce("_gone", F.lit(False)))})
    given = F.when(~F.col("excluded"), F.coalesce("given", F.array().cast("array<struct<first:long,field:string,after:string>>")))
    applied = F.transform(given, lambda g: F.struct(g["field"].alias("field"), F.try_element_at("before", g["field"]).alias("before"), g["after"].alias("after")))
    out = out.withColumn("applied", F.coalesce(applied, F.array().cast("array<struct<field:string,before:string,after:string>>")))
    new = F.map_from_entries(F.transform("applied", lambda a: F.struct(a["field"], a["after"])))
    out = out.withColumn("_new", new).withColumns({n: F.coalesce(F.try_element_at("_new", F.lit(n)), F.col(n)) for n in names})
    revision = F.coalesce("revision", F.lit(1)) if "revision" in records.columns else F.lit(1)
    return out.withColumn("revision", revision + F.when(F.size("applied") > 0, 1).otherwise(0)).drop("_new", "_gone", "given")


def record_events(contract: Contract) -> Column:
    """What happened to one record: its repairs, then its corrections, then a second failure."""
    about, label = F.col("subject"), lambda c: label_of(contract, c)
    repaired = F.transform("repairs", lambda r: _event("value_repaired", F.concat(label(r["field"]), F.lit(": "), F.replace(r["rule"], F.lit("_"), F.lit(" ")), F.lit(".")), "deterministic", about, before=r["before"], after=r["after"]))
    given = F.transform("applied", lambda a: _event("value_corrected", F.concat(F.lit("Reviewer supplied a "), label(a["field"]), F.lit(".")), "human", about, "reviewer", a["before"], a["after"]))
    failed = F.when(F.size("errors") > 0, F.array(_event("validation_failed_twice", explanation(), "deterministic", about, errors=F.size("errors"))))
    every = F.concat(*[F.coalesce(x.cast(f"array<{EVENT}>"), F.array().cast(f"array<{EVENT}>")) for x in (repaired, given, failed)])
    return F.when(F.col("excluded"), F.array().cast(f"array<{EVENT}>")).otherwise(every)


def clean_and_validate(
    records: DataFrame, contract: Contract, corrections: DataFrame, exclusions: DataFrame, rules: Rules = None, orders: dict[str, Column] | None = None, next_seq: int = 1,
    ranges: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, issues, events) of records as ``reconcile.merge`` makes them. Records are in the order of ``first_ord``; events are
    numbered from ``next_seq`` on in that order and end with a summary."""
    given = corrected(records, corrections, exclusions, contract)
    placed = in_blocks(given, [], ["first_ord"], ranges=ranges)  # before the work, as Spark's range partitioner reads its input twice
    done = two_pass(placed, contract, rules, orders, excluded=F.col("excluded")).withColumn("events", record_events(contract))
    why = F.coalesce("exclusion_reason", F.lit(EXCLUDED)) if "exclusion_reason" in records.columns else F.lit(EXCLUDED)
    placed = materialise(done.withColumn("exclusion_reason", F.when(F.col("excluded"), why)), "validated")
    counted = running_sum(placed.select(G, B, "first_ord", "events"), ["first_ord"], F.size("events").cast("long"), "_upto")
    each = counted.select("_upto", F.size("events").alias("_n"), F.posexplode("events").alias("_i", "e"))
    stream = each.select((F.col("_upto") - F.col("_n") + F.col("_i") + F.lit(next_seq)).cast("long").alias("seq"), "e.*")
    total = placed.agg(
        F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("disposition") == "ready").alias("ready"),
    )
    words = F.concat(F.col("ready").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" records are valid and ready to deliver."))
    summary = total.select((F.col("n") + F.lit(next_seq)).cast("long").alias("seq"), _event("validation_summary", words, "deterministic", F.lit(None).cast("string")).cast(EVENT).alias("e")).select("seq", "e.*")
    validated = placed.drop(G, B, "events")
    return validated.drop("subject", "before", "applied", "excluded"), validation_issues(validated, contract), stream.unionByName(summary)


def route(issues: DataFrame, resolutions: DataFrame | None = None, deliveries: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """One row: where a run goes next. ``after_validation``: to review while a blocking issue is open, else to delivery.
    ``after_review``: resolutions (issue_id) are applied before anything else, without any the run delivers. ``after_delivery``: again
    while a delivery (state) waits; then to the drafting of rules for resolutions that it has not considered (``learned``: issue_id),
    else the run ends."""
    open_ = issues.agg(F.count_if(F.coalesce("blocking", F.lit(True)) & (F.coalesce("status", F.lit("open")) == "open")).alias("open_blocking"))
    chosen = open_.withColumn("after_validation", F.when(F.col("open_blocking") > 0, F.lit("await_review")).otherwise(F.lit("deliver")))
    if resolutions is not None:
        known = resolutions.select("issue_id").distinct()
        fresh = known if learned is None else known.join(learned.select("issue_id"), "issue_id", "left_anti")
        chosen = chosen.crossJoin(known.agg(F.count(F.lit(1)).alias("_known"))).crossJoin(fresh.agg(F.count(F.lit(1)).alias("_fresh")))  # single rows
    else:
        chosen = chosen.withColumns({"_known": F.lit(0), "_fresh": F.lit(0)})
    waiting = F.lit(0).alias("_waiting")
    chosen = chosen.crossJoin(deliveries.agg(F.count_if(F.col("state") == "retry_wait").alias("_waiting"))) if deliveries is not None else chosen.select("*", waiting)
    return chosen.select(
        "open_blocking", "after_validation", F.when(F.col("_known") > 0, F.lit("apply_resolutions")).otherwise(F.lit("deliver")).alias("after_review"),
        F.when(F.col("_waiting") > 0, F.lit("deliver")).when(F.col("_fresh") > 0, F.lit("induce_rules")).otherwise(F.lit("end")).alias("after_delivery"),
    )


class MergedRecords:
    """Records of a run that are kept merged while reviews change some of their rows.

    Rows and records are written by bucket of their identity key, a folder a generation. A change writes a new generation of the
    buckets that its keys fall into, and readers take each bucket from its last generation. So a review reads and merges
    the buckets it touches, not the run. Rows without a key are a bucket of their own; every row keeps its number in the run.
    """

    def __init__(self, rows: DataFrame, contract: Contract, rules: Rules = None, buckets: int = 64):
        self.spark, self.contract, self.rules, self.buckets = rows.sparkSession, contract, rules, buckets
        self.generations: list[tuple[str, set[int]]] = []
        rows = materialise(rows, "rows")
        self._write(global_index(rows.select("ord"), rows), set(range(-1, buckets)))

    def _bucket(self, key: Column) -> Column:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(self.buckets))).cast("int")

    def _write(self, rows: DataFrame, buckets: set[int]) -> None:
        folder = shared_dir(self.spark, "merged")
        placed = rows.withColumn("_bucket", self._bucket(identity_key(self.contract)))
        placed.write.partitionBy("_bucket").parquet(f"{folder}/rows")
        own = self.spark.read.schema(placed.schema).parquet(f"{folder}/rows")
        merged = merge(own.drop("_bucket"), self.contract, self.rules).withColumn("_bucket", self._bucket(F.col("key")))
        merged.write.partitionBy("_bucket").parquet(f"{folder}/records")
        self._schemas = {"rows": placed.schema, "records": merged.schema}
        self.generations.append((folder, buckets))

    def _read(self, kind: str, wanted: set[int]) -> DataFrame:
        """The last generation of each bucket; Spark prunes the folders of all others."""
        out, open_ = self.spark.createDataFrame([], self._schemas[kind]), set(wanted)
        for folder, own in reversed(self.generations):
            if mine := open_ & own:
                out, open_ = out.unionByName(self.spark.read.schema(self._schemas[kind]).parquet(f"{folder}/{kind}").filter(F.col("_bucket").isin(*mine))), open_ - mine
        return out.drop("_bucket")

    def records(self) -> DataFrame:
        return self._read("records", set(range(-1, self.buckets)))

    def change(self, corrected: DataFrame, keys: DataFrame) -> set[int]:
        """Puts ``corrected`` rows (with the ``ord`` of rows held) in place of those, and merges anew what they touch: the buckets of
        their keys and of ``keys`` (key; null: none), which the rows had before. Gives the buckets that were read."""
        new = materialise(corrected, "changed")
        touched = keys.select(self._bucket(F.col("key")).alias("b")).union(new.select(self._bucket(identity_key(self.contract)).alias("b"))).distinct()
        buckets = {r["b"] for r in touched.collect()}  # at most one row a bucket
        if buckets:
            held = self._read("rows", buckets)
            numbers = held.select("ord", "index").join(F.broadcast(new.select("ord")) if new.count() < 1_000_000 else new.select("ord"), "ord", "left_semi")
            self._write(held.join(numbers, "ord", "left_anti").select(*held.columns).unionByName(new.join(numbers, "ord").select(*held.columns)), buckets)
        return buckets
