"""Queries of whole steps: the composed pass, issues of records, rules as tables, numbers of rows without a key, incremental merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contract import ORDER
from ..operators import issues, reconcile, run, validate
from ..storage import materialise
from .base import query, table
from .merge_queries import _CANON, _CONFLICT, _FIELDS, _FIXED, _MERGE, _Q, _REPAIRS, d_errors, union_rows
from .profile_queries import _PROFILED

# --- reviewers corrected, excluded and left records alone by the number in their key ---
_FIXES = {"customerEmail": ("num % 11 = 0", "fixed@example.com"), "tier": ("num % 13 = 0", "odd")}
_COR = ", ".join(f"CASE WHEN num % 17 <> 0 AND {cond} THEN '{v}' ELSE base.\"{n}\" END AS \"{n}\"" for n, (cond, v) in _FIXES.items())
_RUN = (
    _MERGE + ", base AS (SELECT rec.*, CAST(right(key, 7) AS BIGINT) AS num, fo FROM rec JOIN (SELECT key, min((file, k)) AS fo FROM u GROUP BY 1) USING (key)), "
    + f"cor AS (SELECT base.* REPLACE ({_COR}), {', '.join(f'base.{_Q(n)} AS was_{n}' for n in _CANON)} FROM base), "
    + f"one AS (SELECT cor.*, CASE WHEN num % 17 = 0 THEN '' ELSE {d_errors('cor')} END AS e1 FROM cor), "
    + "fixed AS (SELECT id, e1, num, fo, " + ", ".join(f"was_{n}, CASE WHEN e1 = '' THEN \"{n}\" ELSE {_FIXED[n]} END AS \"{n}\", \"{n}\" AS raw_{n}" for n in _CANON) + " FROM one), "
    + f"valid AS (SELECT *, CASE WHEN num % 17 = 0 THEN '' ELSE {d_errors('fixed')} END AS e2, num % 17 <> 0 AND ({' OR '.join(c for c, _ in _FIXES.values())}) AS hit FROM fixed), rep AS (SELECT * FROM ({_REPAIRS}))"
)
_TITLES = "CASE {0} " + " ".join(f"WHEN '{f.name}' THEN '{f.title}'" for f in ORDER.fields) + " END"
_PLACES = "CASE {0} " + " ".join(f"WHEN '{f.name}' THEN {i}" for i, f in enumerate(ORDER.fields)) + " END"
_WHY = "CASE WHEN id IN (SELECT id FROM rep) THEN 'Safe repairs were applied and it is still invalid.' ELSE 'No safe automatic repair existed for this value.' END"


def _run(spark, sf_dir):
    records = materialise(reconcile.merge(union_rows(spark, sf_dir), ORDER), "records")
    num = F.right("key", F.lit(7)).cast("long")
    fixes = [records.filter(f"cast(right(key, 7) as bigint) {cond.removeprefix('num ')}").select(F.col("id").alias("record_id"), F.lit(n).alias("field"), F.lit(v).alias("value"), F.lit(i).cast("long").alias("pos")) for i, (n, (cond, v)) in enumerate(_FIXES.items())]
    return run.clean_and_validate(records, ORDER, fixes[0].unionByName(fixes[1]), records.filter(num % 17 == 0).select(F.col("id").alias("record_id")))


@query(_RUN + f" SELECT id, CAST(CASE WHEN hit THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN num % 17 = 0 THEN 'excluded' WHEN e2 = '' THEN 'ready' ELSE 'needs_review' END AS disposition, CASE WHEN num % 17 = 0 THEN 'Excluded by the reviewer.' END AS exclusion_reason, {_FIELDS} FROM valid")
def run_records(spark, sf_dir):
    return _run(spark, sf_dir)[0].select("id", F.col("revision").cast("long").alias("revision"), "disposition", "exclusion_reason", *_PROFILED)


_FIRST = "split_part(split_part(e2, ',', 1), ':', 1)"


@query(
    _RUN + f""" SELECT 'issue:invalid:' || id AS issue_id, {_FIRST} AS field, CASE {_FIRST} {' '.join(f"WHEN '{n}' THEN was_{n}" for n in _CANON)} END AS current_value, "was_orderRef" || ' failed validation twice. ' || {_WHY} AS reason,
 'correct_value|Correct ' || {_TITLES.format(_FIRST)} || '|exclude:' || id AS options, CAST(len(string_split(e2, ',')) AS BIGINT) AS n_errors FROM valid WHERE e2 <> ''"""
)
def run_issues(spark, sf_dir):
    o = lambda i: F.get("options", F.lit(i))
    return _run(spark, sf_dir)[1].select("issue_id", "field", "current_value", "reason", F.concat_ws("|", o(0)["id"], o(0)["label"], o(1)["id"]).alias("options"), F.size("detected_errors").cast("long").alias("n_errors"))


@query(
    _RUN + f""", said AS (SELECT fo, 1 AS part, 2 * {_PLACES.format("field")} + CASE WHEN rule = 'trim_whitespace' THEN 0 ELSE 1 END AS i, 'value_repaired' AS action, "was_orderRef" AS subject, before, after, {_TITLES.format("field")} || ': ' || replace(rule, '_', ' ') || '.' AS reason FROM rep JOIN valid USING (id)
 {''.join(f" UNION ALL SELECT fo, 2, {i}, 'value_corrected', {_Q('was_orderRef')}, was_{n}, '{v}', 'Reviewer supplied a ' || '{ORDER[n].title}' || '.' FROM valid WHERE num % 17 <> 0 AND {cond}" for i, (n, (cond, v)) in enumerate(_FIXES.items()))}
 UNION ALL SELECT fo, 3, 0, 'validation_failed_twice', "was_orderRef", NULL, NULL, {_WHY} FROM valid WHERE e2 <> '')
 SELECT row_number() OVER (ORDER BY fo, part, i) + 40 AS seq, action, subject, before, after, reason FROM said
 UNION ALL SELECT (SELECT count(*) FROM said) + 41, 'validation_summary', NULL, NULL, NULL, count(*) FILTER (WHERE e2 = '' AND num % 17 <> 0) || ' of ' || count(*) || ' records are valid and ready to deliver.' FROM valid"""
)
def run_events(spark, sf_dir):
    return _run(spark, sf_dir)[2].select((F.col("seq") + 40).alias("seq"), "action", "subject", "before", "after", "reason")


# --- issues of records in full ---
@query(
    _MERGE + f""", c AS ({_CONFLICT}), q AS (SELECT id, field, string_split(options, '|') AS v FROM c) SELECT 'issue:conflict:' || id || ':' || field AS issue_id, field, CASE field {' '.join(f"WHEN '{n}' THEN {_Q(n)}" for n in _CANON)} END AS current_value,
 "orderRef" || ' appears in ' || n_rows || ' places with different values for ' || {_TITLES.format("field")} || ': "' || array_to_string(v, '" and "') || '". Merging would silently discard one of them.' AS reason,
 'Sources disagree: "' || array_to_string(v, '" vs "') || '".' AS message, array_to_string(list_transform(v, lambda x: 'value:' || x || '=Use "' || x || '" for ' || {_TITLES.format("field")} || '.'), '|') AS options FROM q JOIN rec USING (id)"""
)
def conflict_issue_records(spark, sf_dir):
    found = issues.conflict_issues(reconcile.merge(union_rows(spark, sf_dir), ORDER), ORDER)
    options = F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["detail"])), "|")
    return found.select("issue_id", "field", "current_value", "reason", F.col("detected_errors")[0]["message"].alias("message"), options.alias("options"))


@query(
    _MERGE + f""", v AS (SELECT id, lower({_CANON['customerEmail']}) AS value, fo FROM rec JOIN (SELECT key, min((file, k)) AS fo FROM u GROUP BY 1) USING (key)), g AS (SELECT value, list(id ORDER BY fo) AS ids FROM v WHERE value <> '' GROUP BY 1 HAVING count(*) > 1)
 SELECT 'issue:duplicate:customerEmail:' || value AS issue_id, value AS current_value, array_to_string(ids, ',') AS record_ids, 'keep_all,' || array_to_string(list_transform(ids, lambda i: 'exclude:' || i || '=Exclude ' || substr(i, 5)), ',') AS options,
 len(ids) || ' records with different Order ref values share the Customer email "' || value || '". They may be duplicates of one record, or one value may be wrong. The target schema cannot tell these apart.' AS reason FROM g"""
)
def duplicate_issue_records(spark, sf_dir):
    found = issues.duplicate_issues(reconcile.duplicate_values(reconcile.merge(union_rows(spark, sf_dir), ORDER), ORDER), ORDER)
    options = F.array_join(F.transform("options", lambda o: F.when(o["id"] == "keep_all", o["id"]).otherwise(F.concat(o["id"], F.lit("="), o["label"]))), ",")
    return found.select("issue_id", "current_value", F.array_join("record_ids", ",").alias("record_ids"), options.alias("options"), "reason")


# --- rows without a key, and changes ---
@query(_MERGE + ", n AS (SELECT *, row_number() OVER (ORDER BY file, k) - 1 AS i FROM u0) SELECT 'rec:row-' || i AS id, file, k AS row, \"customerEmail\" FROM n WHERE k % 5 = 0")
def keyless_records(spark, sf_dir):
    rows = union_rows(spark, sf_dir)
    rows = rows.withColumn("orderRef", F.when(F.col("ord.row") % 5 == 0, F.lit(" ")).otherwise(F.col("orderRef")))
    merged = reconcile.merge(rows, ORDER).filter("key IS NULL")
    return merged.select("id", F.col("first_ord.file").alias("file"), F.col("first_ord.row").alias("row"), "customerEmail")


_CHANGED = "SELECT 1 AS file, * REPLACE (CASE WHEN k % 97 = 0 THEN 'low' ELSE tier END AS tier) FROM ord_b"


@query(_MERGE.replace("SELECT 1 AS file, * FROM ord_b", _CHANGED) + f", c AS ({_CONFLICT}) SELECT id, n_rows, {_FIELDS}, id IN (SELECT id FROM c) AS conflicted FROM rec")
def incremental_merge(spark, sf_dir):
    """Both exports merged, then a review that changes some rows of the second: only the buckets of their keys are merged anew."""
    rows = union_rows(spark, sf_dir)
    held = run.MergedRecords(rows, ORDER, buckets=16)
    some = rows.filter((F.col("ord.file") == 1) & (F.col("ord.row") % 97 == 0))
    held.change(some.withColumn("tier", F.lit("low")), some.select(reconcile.identity_key(ORDER).alias("key")))
    return held.records().select("id", "n_rows", *_PROFILED, (F.size("conflicts") > 0).alias("conflicted"))


# --- a rule for three of four events ---
_TIERS = ("low", "high", "medium")


def _rule_rows(spark, sf_dir, file: int, tier):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    made = {"orderRef": F.concat(F.lit("E-"), n), "customerEmail": F.lit("a@example.com"), "placedDate": F.lit("2024-01-01"), "shippedDate": F.lit(None).cast("string"), "tier": tier}
    return e.select(F.struct(F.lit(file).alias("file"), F.col("event_id").alias("row")).alias("ord"), F.lit(f"f{file}").alias("file_id"), *[c.alias(k) for k, c in made.items()])


def _rule_table(spark, sf_dir):
    n = F.col("event_id")
    canonical = F.element_at(F.array(*map(F.lit, _TIERS)), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").filter(n % 4 != 3).select(F.lit("tier").alias("field"), F.concat(F.lit("r"), n.cast("string")).alias("term"), canonical.alias("canonical"))


_CANONICAL = "['low', 'high', 'medium'][event_id % 3 + 1]"


def _spelled():
    return F.concat(F.lit(" R-"), F.col("event_id").cast("string"), F.lit(" "))


@query(f"SELECT 'rec:e-' || event_id AS id, CASE WHEN event_id % 4 <> 3 THEN {_CANONICAL} ELSE 'R-' || event_id END AS tier, CASE WHEN event_id % 4 <> 3 THEN 'ready' ELSE 'needs_review' END AS disposition FROM events")
def repair_by_rule_table(spark, sf_dir):
    rules = _rule_table(spark, sf_dir)
    records = reconcile.merge(_rule_rows(spark, sf_dir, 0, _spelled()), ORDER, rules)
    return validate.two_pass(records, ORDER, rules).select("id", "tier", "disposition")


@query(f"SELECT 'rec:e-' || event_id AS id, CASE WHEN event_id % 4 <> 3 AND {_CANONICAL} = 'low' THEN 'low' ELSE ' R-' || event_id || ' ' END AS tier, event_id % 4 = 3 OR {_CANONICAL} <> 'low' AS conflicted FROM events")
def merge_by_rule_table(spark, sf_dir):
    rows = _rule_rows(spark, sf_dir, 0, _spelled()).unionByName(_rule_rows(spark, sf_dir, 1, F.lit("low")))
    return reconcile.merge(rows, ORDER, _rule_table(spark, sf_dir)).select("id", "tier", (F.size("conflicts") > 0).alias("conflicted"))


# --- where a run goes next ---
@query(
    """SELECT count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 <> 0) AS open_blocking, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 <> 0) > 0 THEN 'await_review' ELSE 'deliver' END AS after_validation,
 CASE WHEN count(*) FILTER (WHERE event_id % 3 = 0) > 0 THEN 'apply_resolutions' ELSE 'deliver' END AS after_review, CASE WHEN count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 2 = 1) > 0 THEN 'induce_rules' ELSE 'end' END AS after_delivery FROM events"""
)
def run_routes(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    made = e.select(n.alias("issue_id"), (F.col("event_type") == "error").alias("blocking"), F.when(n % 3 == 0, F.lit("resolved")).otherwise(F.lit("open")).alias("status"))
    chosen = made.filter("status = 'resolved'")
    return run.route(made, chosen, e.select(F.lit("succeeded").alias("state")), chosen.filter("issue_id % 2 = 0"))
