"""Issues, decisions on them, rules, and the audit trail: keyed upserts, anti-joins and ordered windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import Contract, normal
from .blocks import B, G, in_blocks, numbered

ACTIONS = ("map", "accept", "correct_value", "exclude", "reject", "keep_all")


def upsert_issues(old: DataFrame, new: DataFrame) -> DataFrame:
    """By issue_id: details of the new row, status and resolution of the old one where it has any."""
    o = old.select("issue_id", F.col("status").alias("o_status"), F.col("resolution").alias("o_resolution"), F.col("reason").alias("o_reason"))
    joined = o.join(new, "issue_id", "full")
    settled = F.col("o_resolution").isNotNull()
    return joined.select(
        "issue_id", F.coalesce("reason", "o_reason").alias("reason"), F.when(settled, F.col("o_status")).otherwise(F.coalesce("status", "o_status")).alias("status"),
        F.coalesce("o_resolution", "resolution").alias("resolution"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def check_decisions(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Decisions that are refused, with the reason: unknown issue, action or option."""
    known = issues.select("issue_id", "options", F.lit(True).alias("known"))
    rows = decisions.join(known, "issue_id", "left")
    reason = (
        F.when(F.col("known").isNull(), F.lit("unknown issue")).when(~F.col("action").isin(*ACTIONS), F.lit("unknown action"))
        .when(F.col("option_id").isNotNull() & ~F.array_contains("options", F.col("option_id")), F.lit("unknown option"))
    )
    return rows.select("issue_id", "action", "option_id", reason.alias("refused")).filter(F.col("refused").isNotNull())


def resolve(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """``issues`` with the choice made for them (issue_id, action, option_id, value): those become resolved, others stay as they are."""
    d = decisions.select("issue_id", F.struct(F.coalesce("action", F.lit("approve")).alias("action"), "option_id", "value").alias("chosen"))
    return issues.join(d, "issue_id", "left").withColumn("status", F.when(F.col("chosen").isNotNull(), F.lit("resolved")).otherwise(F.col("status")))


def _choices(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (issue_id, action, option_id, value, pos) on known issues, with the option that each names."""
    rows = decisions.withColumns({"action": F.coalesce("action", F.lit("approve")), "option_id": F.coalesce("option_id", F.lit(""))}).join(issues, "issue_id")
    return rows.withColumn("option", F.get(F.filter("options", lambda o: o["id"] == F.col("option_id")), F.lit(0)))


def mapping_corrections(issues: DataFrame, decisions: DataFrame, columns: DataFrame) -> DataFrame:
    """New decisions that reviewers' options make: the issue's own column, or the one that a ``use:`` option names, feeds the
    option's target. issues: issue_id, column_id, options (id, target). Unknown columns, rejections and exclusions give none."""
    chosen = _choices(issues.select("issue_id", F.col("column_id").alias("own"), "options"), decisions).filter(~F.col("action").isin("reject", "exclude") & (F.coalesce("option.target", F.lit("")) != ""))
    chosen = chosen.withColumn("column_id", F.coalesce("own", F.regexp_replace("option_id", "^use:", "")))
    known = chosen.join(columns.select("column_id"), "column_id", "left_semi")
    return known.select("column_id", F.col("option.target").alias("target"), F.lit("AUTO_MAPPED").alias("outcome"), F.lit("human_correction").alias("basis"), F.lit("reviewer").alias("decided_by"), "pos")


def record_resolutions(issues: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exclusions, corrections) that decisions make on records. issues: issue_id, field, record_ids, options (id, value).

    exclusions: record_id. An ``exclude:`` option names one record, the action without one takes all of the issue.
    corrections: record_id, field, value, pos: the value given, else that of the option.
    """
    rows = _choices(issues.select("issue_id", "field", "record_ids", "options"), decisions).filter(F.size("record_ids") > 0)
    out = (F.col("action") == "exclude") | F.startswith("option_id", F.lit("exclude:"))
    one = F.nullif(F.regexp_replace("option_id", "^exclude:", ""), F.lit(""))
    gone = F.when(F.contains("option_id", F.lit(":")) & one.isNotNull(), F.array(one)).otherwise(F.col("record_ids"))
    exclusions = rows.filter(out).select(F.explode(gone).alias("record_id")).distinct()
    value = F.coalesce("value", "option.value")
    fixes = rows.filter(~out & value.isNotNull() & (F.coalesce("field", F.lit("")) != ""))
    return exclusions, fixes.select(F.explode("record_ids").alias("record_id"), "field", value.alias("value"), "pos")


def apply_corrections(records: DataFrame, corrections: DataFrame, exclusions: DataFrame, contract: Contract) -> DataFrame:
    """Overlays corrected values (record_id, field, value, pos), of several the last, raises the revision of a corrected record
    by one (from 1, where records have none), marks excluded records; none is dropped."""
    last = [F.max_by(F.when(F.col("field") == f.name, F.col("value")), F.when(F.col("field") == f.name, F.col("pos"))).alias(f"c_{f.name}") for f in contract.fields]
    wide = corrections.groupBy(F.col("record_id").alias("id")).agg(*last)
    out = records.join(wide.withColumn("hit", F.lit(True)), "id", "left").join(exclusions.select(F.col("record_id").alias("id"), F.lit(True).alias("out")).distinct(), "id", "left")
    named = {f.name: F.coalesce(f"c_{f.name}", f.name) for f in contract.fields}
    before = F.coalesce("revision", F.lit(1)) if "revision" in records.columns else F.lit(1)
    out = out.withColumns(named).withColumn("revision", before + F.when(F.col("hit"), 1).otherwise(0)).withColumn("excluded", F.coalesce("out", F.lit(False)))
    return out.drop("hit", "out", *[f"c_{f.name}" for f in contract.fields])


def route(issues: DataFrame) -> DataFrame:
    """One row: pause for review while a blocking issue is open, else deliver."""
    n = F.count_if(F.col("blocking") & (F.col("status") == "open"))
    return issues.agg(n.alias("open_blocking"), F.when(n > 0, F.lit("review")).otherwise(F.lit("deliver")).alias("route"))


def builtin_rules(spark: SparkSession, contract: Contract) -> DataFrame:
    """Header rules of unambiguous spellings other than the name, value rules of aliases."""
    rows = [(f"builtin:{t[0]}:{s}", "HEADER_ALIAS", t[0], s, None, 0) for s, t in contract.spelling_index().items() if len(t) == 1 and s != t[0].lower()]
    rows += [(f"builtin:{f.name}={normal(a)}", "VALUE_ALIAS", f.name, normal(a), c, 0) for f in contract.fields for a, c in f.value_aliases.items() if c in f.values]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "rule_id string, kind string, field_name string, term string, canonical string, layer int, pos int")


def layered(*layers: DataFrame) -> DataFrame:
    """Rules of several layers, the first the weakest; positions count within a layer."""
    return reduce(DataFrame.unionByName, [rules.withColumn("layer", F.lit(i)) for i, rules in enumerate(layers)])


def active_rules(rules: DataFrame, overrides: DataFrame, schema_id: str | None = None) -> DataFrame:
    """Rules that are enabled, of the schema (null: of any) and taken away by no enabled override; of one kind and key the last
    layer and position wins. A key is the term, for values within its field; a date rule by header and one by field
    are told apart."""
    kept = rules.filter(F.col("enabled") & (F.col("kind") != "OVERRIDE")).join(overrides.filter("enabled").select(F.col("targets_rule_id").alias("rule_id")).distinct(), "rule_id", "left_anti")
    if schema_id is not None:
        kept = kept.filter(F.col("schema_id") == schema_id)
    place, by_field = F.struct("layer", "pos"), (F.col("kind") == "DATE_ORDER") & (F.coalesce("term", F.lit("")) == "")
    scope = F.when((F.col("kind") == "VALUE_ALIAS") | by_field, F.col("field_name"))
    more = [F.max_by(c, place).alias(c) for c in ("rule_id", "field_name", *(c for c in ("canonical", "date_order") if c in kept.columns))]
    return kept.groupBy("kind", scope.alias("scope"), "term").agg(*more)


def date_orders(columns: DataFrame, active: DataFrame) -> DataFrame:
    """``columns`` (h: normalised header, target) with the reading of ambiguous dates: a rule for the column's header wins over
    one for its field."""
    dates = active.filter("kind = 'DATE_ORDER'")
    by_header = dates.filter("scope IS NULL").select(F.col("term").alias("h"), F.col("date_order").alias("by_header"))
    by_field = dates.filter("scope IS NOT NULL").select(F.col("scope").alias("target"), F.col("date_order").alias("by_field"))
    return columns.join(by_header, "h", "left").join(by_field, "target", "left").withColumn("date_order", F.coalesce("by_header", "by_field")).drop("by_header", "by_field")


def overridden(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rules`` with a mark on those that an enabled override takes away."""
    off = overrides.filter("enabled").select(F.col("targets_rule_id").alias("rule_id"), F.lit(True).alias("off")).distinct()
    return rules.join(off, "rule_id", "left").withColumn("overridden", F.coalesce("off", F.lit(False))).drop("off")


def check_rules(rules: DataFrame, contract: Contract) -> DataFrame:
    """rule_id and the first reason why the contract refuses it (null: none). Overrides, rules that leave a column out and date
    rules for a header alone name no field, so none is asked of them."""
    spark = rules.sparkSession
    fields = spark.createDataFrame([(f.name, f.kind, list(f.values)) for f in contract.fields], "field_name string, f_kind string, f_values array<string>")
    shared = spark.createDataFrame([(s, len(t)) for s, t in contract.spelling_index().items()], "term string, n_fields int")
    rows = rules.join(F.broadcast(fields), "field_name", "left").join(F.broadcast(shared), "term", "left")
    k = F.col("kind")
    names_field = k.isin("HEADER_ALIAS", "VALUE_ALIAS") | ((k == "DATE_ORDER") & (F.coalesce("field_name", F.lit("")) != ""))
    reason = (
        F.when((k == "HEADER_ALIAS") & (F.col("n_fields") >= 2), F.lit("header is claimed by several fields")).when(names_field & F.col("f_kind").isNull(), F.lit("unknown field"))
        .when((k == "VALUE_ALIAS") & (F.col("f_kind") != "enum"), F.lit("not an enum field")).when((k == "VALUE_ALIAS") & ~F.array_contains("f_values", F.col("canonical")), F.lit("not a permitted value"))
        .when((k == "DATE_ORDER") & names_field & (F.col("f_kind") != "date"), F.lit("not a date field"))
    )
    return rows.select("rule_id", reason.alias("refused"))


TERMINAL = ("complete", "complete_with_failures")


def rule_hits(events: DataFrame, before: DataFrame) -> DataFrame:
    """Counts of events by rule, added to the hits so far; where events carry the phase of their run, only finished runs count."""
    if "phase" in events.columns:
        events = events.filter(F.col("phase").isin(*TERMINAL))
    new = events.filter(F.startswith("rule_id", F.lit("rule_"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("new"))
    return before.join(new, "rule_id", "full").select("rule_id", (F.coalesce("hits", F.lit(0)) + F.coalesce("new", F.lit(0))).cast("long").alias("hits"))


def number_events(events: DataFrame, run: str, order: list[str], base: int = 0, block: Column | None = None) -> DataFrame:
    """Gap-free sequence numbers within each run, in blocks of the order (see ``blocks``): no task holds a run."""
    return numbered(in_blocks(events, [run], order, block), order, "seq", base).drop(G, B)


def next_sequence(events: DataFrame) -> DataFrame:
    """One row: the number after the last one, 1 at first."""
    return events.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def newest(rows: DataFrame, partition: str, order: list, k: int) -> DataFrame:
    """The k newest rows of each partition (retention)."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).filter(F.col("r") <= k).drop("r")
