"""Review issues as records: id, type, reason, blocking, what they are about, the value in question, options and errors. Those of
the mapping step have metadata-sized inputs; those of records are one row a conflict, shared value or failed record.

The sentences are fixed values, as reviewers see them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from .mapping import required_missing

OPTION = "struct<id:string,label:string,detail:string,target:string,value:string>"
ERROR = "struct<field:string,code:string,message:string>"


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _quoted(c) -> Column:
    return _say('"', F.col(c) if isinstance(c, str) else c, '"')


def _option(id_, label, detail, target=None, value=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(id_.alias("id"), label.alias("label"), detail.alias("detail"), (none if target is None else target).alias("target"), (none if value is None else value).alias("value"))


def map_option(target: Column, label: Column, header: Column) -> Column:
    return _option(_say("map:", target), _say("Map to ", label), _say("Treat ", _quoted(header), " as ", label, "."), target)


def ignore_option(detail: Column) -> Column:
    return _option(F.lit("ignore"), F.lit("Ignore this column"), detail)


def field_table(contract: Contract, spark) -> DataFrame:
    """One row for each field: target, label, required, place."""
    return spark.createDataFrame([(f.name, f.title, f.required, i) for i, f in enumerate(contract.fields)], "target string, label string, required boolean, place int")


def _in_order(value: Column, *order: str) -> Column:
    """An array of ``value`` by ``order``, over a group."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("x")))), lambda s: s["x"])


def _issue(rows: DataFrame, issue_id: Column, type_: str, reason: Column, blocking: Column, options: Column, *, column_id=None, field=None, record_ids=None, current=None, errors=None) -> DataFrame:
    as_ = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return rows.select(
        issue_id.alias("issue_id"), F.lit(type_).alias("type"), reason.alias("reason"), blocking.alias("blocking"), as_(column_id, "string").alias("column_id"), as_(field, "string").alias("field"),
        (F.array() if record_ids is None else record_ids).cast("array<string>").alias("record_ids"), as_(current, "string").alias("current_value"), options.cast(f"array<{OPTION}>").alias("options"),
        (F.array() if errors is None else errors).cast(f"array<{ERROR}>").alias("detected_errors"),
    )


def first_samples(columns: DataFrame, samples: DataFrame | None) -> DataFrame:
    """``columns`` with ``sample``, the first of their samples (column_id, position, sample)."""
    if samples is None:
        return columns.withColumn("sample", F.lit(None).cast("string"))
    return columns.join(samples.groupBy("column_id").agg(F.min_by("sample", "position").alias("sample")), "column_id", "left")


def mapping_issues(columns: DataFrame, decisions: DataFrame, found: DataFrame, contract: Contract, samples: DataFrame | None = None) -> DataFrame:
    """The six kinds of issue that mapping raises, from ``mapping.decide`` and ``mapping.candidates`` of the columns
    (column_id, file_id, file_name, header). Issues of one column show its first sample."""
    spark = columns.sparkSession
    columns = first_samples(columns, samples)
    fields = F.broadcast(field_table(contract, spark))
    named = found.select("column_id", "target", "viable", "basis").join(fields, "target").join(columns.select("column_id", "file_id", "file_name", "header", "sample"), "column_id")
    named = named.join(decisions.select("column_id", "gate"), "column_id")
    out = []

    one = named.filter("gate = 'contended' AND viable").groupBy("file_id", "file_name", "target", "label", "required").agg(
        _in_order(_option(_say("use:", F.col("column_id")), _say("Use ", _quoted("header")), _say("Map ", _quoted("header"), " to ", F.col("label"), " and ignore the others."), F.col("target")), "column_id").alias("options"),
        _in_order(_quoted("header"), "column_id").alias("headers"),
    )
    out.append(_issue(
        one, _say("issue:competing:", F.col("file_id"), ":", F.col("target")), "COMPETING_COLUMNS",
        _say(F.size("headers").cast("string"), " columns in ", F.col("file_name"), " could each be ", F.col("label"), ": ", F.array_join("headers", ", "), ". Only one can supply it, and the headers do not say which."),
        F.col("required"), F.col("options"), field=F.col("target"),
    ))

    by_column = lambda rows: rows.groupBy("column_id", "file_name", "header", "sample").agg(
        _in_order(map_option(F.col("target"), F.col("label"), F.col("header")), "place").alias("maps"), _in_order(F.col("label"), "place").alias("labels"), F.max("required").alias("required"),
    )
    leave = F.array(ignore_option(_say("Leave ", _quoted("header"), " out of the migration entirely.")))
    where = _say(_quoted("header"), " in ", F.col("file_name"))
    shared = by_column(named.filter("gate = 'shared_header' AND basis <> 'learned'"))
    out.append(_issue(
        shared, _say("issue:ambiguous:", F.col("column_id")), "AMBIGUOUS_MAPPING",
        _say(where, " could be ", F.array_join("labels", " or "), ". The header does not say which, and picking wrong would silently corrupt every record in this file."),
        F.lit(True), F.concat("maps", leave), column_id=F.col("column_id"), current=F.col("sample"),
    ))
    several = by_column(named.filter("gate = 'several' AND viable"))
    out.append(_issue(
        several, _say("issue:ambiguous:", F.col("column_id")), "AMBIGUOUS_MAPPING", _say(where, " could be ", F.array_join("labels", " and "), ", and matches both equally well."),
        F.col("required"), F.concat("maps", leave), column_id=F.col("column_id"), current=F.col("sample"),
    ))
    best = named.filter("gate = 'mismatch'").groupBy("column_id", "file_name", "header", "sample").agg(F.min_by(F.struct("target", "label", "required"), "place").alias("b")).select("*", "b.*")
    out.append(_issue(
        best, _say("issue:mismatch:", F.col("column_id")), "AMBIGUOUS_MAPPING",
        _say(where, " looks like ", F.col("label"), " by name, but its values do not match that shape. Applying it could corrupt the field."),
        F.col("required"), F.concat(F.array(map_option(F.col("target"), F.col("label"), F.col("header"))), leave), column_id=F.col("column_id"), current=F.col("sample"),
    ))

    missing = required_missing(decisions, found, contract).join(fields, "target").crossJoin(columns.select("column_id", "file_name", "header"))
    use = _option(_say("use:", F.col("column_id")), _say("Use ", _quoted("header")), _say("Map ", _quoted("header"), " from ", F.col("file_name"), " to ", F.col("label"), "."), F.col("target"))
    missing = missing.groupBy("target", "label").agg(_in_order(use, "column_id").alias("options"))
    out.append(_issue(
        missing, _say("issue:missing:", F.col("target")), "REQUIRED_FIELD_UNMAPPED",
        _say(F.col("label"), " is required by the target schema, but none of the uploaded columns look like it. Records cannot be delivered without it."),
        F.lit(True), F.col("options"), field=F.col("target"),
    ))
    out.append(unknown_issues(columns.join(decisions.filter("gate = 'unknown'").select("column_id"), "column_id", "left_semi"), decisions, contract))
    return reduce(DataFrame.unionByName, out)


def unknown_issues(unresolved: DataFrame, decisions: DataFrame, contract: Contract) -> DataFrame:
    """For columns that nothing places: every field that no accepted decision takes, and leaving the column out."""
    free = field_table(contract, unresolved.sparkSession).join(decisions.filter("outcome = 'AUTO_MAPPED'").select("target").distinct(), "target", "left_anti")
    # columns and fields are both bounded by their limits, so all options are written out
    each = first_samples(unresolved, None) if "sample" not in unresolved.columns else unresolved
    each = each.select("column_id", "file_name", "header", "sample").join(F.broadcast(free), F.lit(True), "left")
    maps = _in_order(F.when(F.col("target").isNotNull(), map_option(F.col("target"), F.col("label"), F.col("header"))), "place")
    rows = each.groupBy("column_id", "file_name", "header", "sample").agg(F.array_compact(maps).alias("maps"))
    leave = F.array(ignore_option(_say("Leave ", _quoted("header"), " out of the migration.")))
    reason = _say(_quoted("header"), " in ", F.col("file_name"), " does not match any target field, and could not be placed confidently. Choose a field for it or leave it out.")
    return _issue(rows, _say("issue:unknown:", F.col("column_id")), "AMBIGUOUS_MAPPING", reason, F.lit(False), F.concat("maps", leave), column_id=F.col("column_id"), current=F.col("sample"))


def subject(contract: Contract) -> Column:
    """How a record is named in issues and events: the value of its naming field, else its id."""
    f = contract.naming
    return F.coalesce(F.nullif(F.col(f.name), F.lit("")), F.col("id")) if f else F.col("id")


def label_of(contract: Contract, field: Column) -> Column:
    names = F.create_map(*[F.lit(x) for f in contract.fields for x in (f.name, f.title)])
    return F.when(F.coalesce(field, F.lit("")) == "", F.lit("this value")).otherwise(F.coalesce(F.try_element_at(names, field), field))


def conflict_issues(records: DataFrame, contract: Contract) -> DataFrame:
    """One blocking issue for each field on which a record's sources disagree, with a choice for each of the values. records: as
    ``reconcile.merge`` makes them."""
    held = F.create_map(*[x for f in contract.fields for x in (F.lit(f.name), F.col(f.name))])
    found = records.filter("size(conflicts) > 0").select("id", "n_rows", subject(contract).alias("subject"), held.alias("held"), F.explode("conflicts").alias("c")).select("*", "c.*").withColumn("label", label_of(contract, F.col("field")))
    named = F.transform("options", _quoted)
    reason = _say(
        F.col("subject"), " appears in ", F.col("n_rows").cast("string"), " places with different values for ", F.col("label"), ": ", F.array_join(named, " and "), ". Merging would silently discard one of them.",
    )
    options = F.transform("options", lambda v: _option(_say("value:", v), v, _say('Use "', v, '" for ', F.col("label"), "."), None, v))
    error = F.struct(F.col("field"), F.lit("identity_conflict").alias("code"), _say("Sources disagree: ", F.array_join(named, " vs "), ".").alias("message"))
    return _issue(
        found, F.concat_ws(":", F.lit("issue:conflict"), "id", "field"), "IDENTITY_CONFLICT", reason, F.lit(True), options, field=F.col("field"), record_ids=F.array("id"),
        current=F.try_element_at("held", F.col("field")), errors=F.array(error),
    )


def duplicate_issues(shared: DataFrame, contract: Contract) -> DataFrame:
    """field, value, id (and first_ord) of records' values of unique fields -> issues of those that several share; they keep all
    or exclude one, in the order of the records. The ids of one value form one list, as the issue names them all."""
    spark = shared.sparkSession
    identity = F.lit(contract.identity.title) if contract.identity else F.col("label")
    at = F.struct("first_ord", "id") if "first_ord" in shared.columns else F.struct("id")
    rows = shared.groupBy("field", "value").agg(F.transform(F.array_sort(F.collect_list(at)), lambda r: r["id"]).alias("ids")).filter("size(ids) > 1")
    rows = rows.join(F.broadcast(field_table(contract, spark).select(F.col("target").alias("field"), "label")), "field")
    keep = F.array(_option(F.lit("keep_all"), F.lit("Keep both records"), F.lit("Treat them as genuinely different and migrate both.")))
    drop = F.transform("ids", lambda r: _option(_say("exclude:", r), _say("Exclude ", F.regexp_replace(r, "^rec:", "")), F.lit("Leave that record out of this migration.")))
    reason = _say(
        F.size("ids").cast("string"), " records with different ", identity, " values share the ", F.col("label"), " ", _quoted("value"),
        ". They may be duplicates of one record, or one value may be wrong. The target schema cannot tell these apart.",
    )
    return _issue(rows, _say("issue:duplicate:", F.col("field"), ":", F.col("value")), "DUPLICATE_EMAIL", reason, F.lit(False), F.concat(keep, drop), field=F.col("field"), record_ids=F.col("ids"), current=F.col("value"))


#: What became of a record that failed both passes.
NO_REPAIR, STILL_INVALID = "No safe automatic repair existed for this value.", "Safe repairs were applied and it is still invalid."


def explanation() -> Column:
    return F.when(F.size("repairs") > 0, F.lit(STILL_INVALID)).otherwise(F.lit(NO_REPAIR))


def validation_issues(validated: DataFrame, contract: Contract) -> DataFrame:
    """One blocking issue for each record that failed both passes, on the field of its first error: correct it, or exclude the
    record. validated: as ``validate.two_pass`` makes it, with ``subject`` and ``before`` (a map of the values as merged) where
    corrections came between."""
    rows = validated.filter("size(errors) > 0")
    if "subject" not in rows.columns:
        rows = rows.withColumns({"subject": subject(contract), "before": F.create_map(*[x for f in contract.fields for x in (F.lit(f.name), F.col(f.name))])})
    first = F.get("errors", F.lit(0))["field"]
    label = label_of(contract, first)
    options = F.array(
        _option(F.lit("correct_value"), _say("Correct ", label), _say("Supply a valid ", label, " for this record. It will be validated again.")),
        _option(_say("exclude:", F.col("id")), F.lit("Exclude this record"), F.lit("Leave it out of the migration. It stays visible in the totals and the audit trail.")),
    )
    return _issue(
        rows, F.concat_ws(":", F.lit("issue:invalid"), "id"), "VALIDATION_FAILED_TWICE", _say(F.col("subject"), " failed validation twice. ", explanation()), F.lit(True), options, field=first,
        record_ids=F.array("id"), current=F.try_element_at("before", first), errors=F.col("errors"),
    )


def evidence(columns: DataFrame, found: DataFrame, contract: Contract, rationale: DataFrame | None = None) -> DataFrame:
    """column_id, target, evidence: why a field is a candidate, in two sentences - the header, then the values.
    ``rationale`` (header, rationale) has the words of learned rules."""
    rows = found.join(F.broadcast(field_table(contract, columns.sparkSession)).drop("required"), "target").join(columns.select("column_id", "header", "kinds"), "column_id")
    why = F.lit(None).cast("string")
    if rationale is not None:
        rows = rows.join(rationale.select(F.col("header").alias("h"), "rationale"), "h", "left")
        why = F.nullif(F.col("rationale"), F.lit(""))
    learned = F.coalesce(_say("A rule you approved says ", _quoted("header"), " is ", F.col("label"), ": ", why), _say("A rule you approved says ", _quoted("header"), " is ", F.col("label"), "."))
    by_name = (
        F.when(F.col("basis") == "exact", _say("Header ", _quoted("header"), " is the target field name."))
        .when(F.col("basis") == "alias", _say("Header ", _quoted("header"), " is a known spelling of ", F.col("label"), ".")).otherwise(learned)
    )
    first = F.get("kinds", F.lit(0))
    by_value = (
        F.when(~F.col("viable"), _say("Values look like ", first, ", which does not fit ", F.col("label"), "."))
        .when(F.size("kinds") > 0, _say("Values look like ", first, ", which fits ", F.col("label"), ".")).otherwise(F.lit("Column has no values to contradict the header."))
    )
    return rows.select("column_id", "target", F.array(by_name, by_value).alias("evidence"))


def decision_evidence(columns: DataFrame, decisions: DataFrame, found: DataFrame, contract: Contract, rationale: DataFrame | None = None) -> DataFrame:
    """column_id, evidence: what each gate says of its decision. columns: column_id, file_name, header, kinds."""
    fields = F.broadcast(field_table(contract, columns.sparkSession))
    rows = decisions.select("column_id", "gate", F.col("target").alias("chosen")).join(columns.select("column_id", "file_name", "header"), "column_id")
    own = found.join(fields, "target").select("column_id", "target", "label", "place", "viable", "basis")
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "label")))), lambda x: x["label"])
    named = own.groupBy("column_id").agg(listed(F.col("basis") != "learned").alias("claims"), listed(F.col("viable")).alias("fits"), F.min_by("target", "place").alias("best"))
    rows = rows.join(named, "column_id", "left").withColumn("target", F.when(F.col("gate") == "mapped", F.col("chosen")).when(F.col("gate") == "mismatch", F.col("best")))
    of = evidence(columns, found, contract, rationale).withColumnRenamed("evidence", "why")
    rows = rows.join(of, ["column_id", "target"], "left")
    gate, header = F.col("gate"), _quoted("header")
    text = (
        F.when(gate == "ignored", _say("A rule you approved leaves ", header, " out of migrations."))
        .when(gate == "shared_header", _say("Header ", header, " names a concept shared by ", F.array_join("claims", " and "), "."))
        .when(gate == "contended", _say("Another column in ", F.col("file_name"), " claims the same target field."))
        .when(gate == "several", _say(header, " matches ", F.size("fits").cast("string"), " target fields: ", F.array_join("fits", ", "), "."))
        .when(gate == "unknown", _say("No known target field matches ", header, "."))
    )
    return rows.select("column_id", F.coalesce(F.when(text.isNotNull(), F.array(text)), "why").alias("evidence"))
