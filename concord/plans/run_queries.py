"""Queries over a run's own tables: issue records, resolutions, rules, views, counters and delivery, with DuckDB SQL for the same rows.

The driver's ``events`` and ``orders`` stand in for issues, decisions, rules and attempts of any number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contract import ORDER
from ..operators import deliver, issues, mapping, profile, review, rulebook, views
from .base import query, table
from .catalog import TRADE, columns, source_cells
from .mapping_queries import _DECIDE, _MISSING, _TRADE, decided_without_unknown

_MAPS = "string_agg('map:' || target, ',' ORDER BY place) || ',ignore'"


@query(
    _DECIDE + f""", {_TRADE}, firsts AS (SELECT column_id, min(t) AS sample FROM cells WHERE t <> '' GROUP BY 1), n AS (SELECT c.*, d.gate, d.one, f.label, f.required, f.place, k.header, s.sample FROM cand c JOIN decided d USING (column_id) JOIN fields f USING (target) JOIN cols k USING (column_id) LEFT JOIN firsts s USING (column_id))
SELECT 'issue:competing:' || file_id || ':' || target AS issue_id, 'COMPETING_COLUMNS' AS type, required AS blocking, string_agg('use:' || column_id, ',' ORDER BY column_id) AS options, CAST(NULL AS VARCHAR) AS current_value,
  count(*) || ' columns in ' || file_id || '.csv could each be ' || label || ': ' || string_agg('"' || header || '"', ', ' ORDER BY column_id) || '. Only one can supply it, and the headers do not say which.' AS reason
  FROM n WHERE gate = 'contended' AND viable GROUP BY file_id, target, required, label
UNION ALL SELECT 'issue:ambiguous:' || column_id, 'AMBIGUOUS_MAPPING', TRUE, {_MAPS}, any_value(sample), '"' || header || '" in ' || file_id || '.csv could be ' || string_agg(label, ' or ' ORDER BY place) || '. The header does not say which, and picking wrong would silently corrupt every record in this file.'
  FROM n WHERE gate = 'shared_header' GROUP BY column_id, header, file_id
UNION ALL SELECT 'issue:ambiguous:' || column_id, 'AMBIGUOUS_MAPPING', bool_or(required), {_MAPS}, any_value(sample), '"' || header || '" in ' || file_id || '.csv could be ' || string_agg(label, ' and ' ORDER BY place) || ', and matches both equally well.'
  FROM n WHERE gate = 'several' AND viable GROUP BY column_id, header, file_id
UNION ALL SELECT 'issue:mismatch:' || column_id, 'AMBIGUOUS_MAPPING', arg_min(required, place), 'map:' || arg_min(target, place) || ',ignore', any_value(sample),
  '"' || header || '" in ' || file_id || '.csv looks like ' || arg_min(label, place) || ' by name, but its values do not match that shape. Applying it could corrupt the field.' FROM n WHERE gate = 'mismatch' GROUP BY column_id, header, file_id
UNION ALL SELECT 'issue:unknown:' || column_id, 'AMBIGUOUS_MAPPING', FALSE, coalesce((SELECT string_agg('map:' || target, ',' ORDER BY place) || ',' FROM fields WHERE target NOT IN (SELECT one FROM decided WHERE gate = 'mapped')), '') || 'ignore', sample,
  '"' || header || '" in ' || file_id || '.csv does not match any target field, and could not be placed confidently. Choose a field for it or leave it out.' FROM decided JOIN cols USING (column_id, file_id) LEFT JOIN firsts USING (column_id) WHERE gate = 'unknown'"""
)
def mapping_issue_records(spark, sf_dir):
    cols = columns(spark, sf_dir)
    found = issues.mapping_issues(cols, mapping.decide(cols, TRADE), mapping.candidates(cols, TRADE), TRADE, profile.profile_samples(source_cells(spark, sf_dir)))
    return found.select("issue_id", "type", "blocking", F.array_join(F.transform("options", lambda o: o["id"]), ",").alias("options"), "current_value", "reason")


@query(
    _MISSING + " SELECT 'issue:missing:' || target AS issue_id, string_agg('use:' || column_id, ',' ORDER BY column_id) AS options, label || ' is required by the target schema, but none of the uploaded columns look like it. Records cannot be delivered without it.' AS reason FROM missing, cols GROUP BY target, label"
)
def missing_field_issues(spark, sf_dir):
    cols, decisions, known = decided_without_unknown(spark, sf_dir)
    found = issues.mapping_issues(cols, decisions, known, TRADE).filter("type = 'REQUIRED_FIELD_UNMAPPED'")
    return found.select("issue_id", F.array_join(F.transform("options", lambda o: o["id"]), ",").alias("options"), "reason")


_EVIDENCE = """CASE basis WHEN 'exact' THEN 'Header "' || header || '" is the target field name.' ELSE 'Header "' || header || '" is a known spelling of ' || label || '.' END || ' ' ||
CASE WHEN NOT viable THEN 'Values look like ' || kinds[1] || ', which does not fit ' || label || '.' WHEN len(kinds) > 0 THEN 'Values look like ' || kinds[1] || ', which fits ' || label || '.' ELSE 'Column has no values to contradict the header.' END"""


@query(_DECIDE + f", {_TRADE} SELECT column_id, target, {_EVIDENCE} AS evidence FROM cand JOIN cols USING (column_id) JOIN fields USING (target)")
def mapping_evidence(spark, sf_dir):
    cols = columns(spark, sf_dir)
    return issues.evidence(cols, mapping.candidates(cols, TRADE), TRADE).select("column_id", "target", F.array_join("evidence", " ").alias("evidence"))


@query(
    _MISSING + f""", e AS (SELECT column_id, target, place, label, {_EVIDENCE} AS evidence FROM cand JOIN cols USING (column_id) JOIN fields USING (target))
 SELECT column_id, CASE WHEN column_id IN (SELECT column_id FROM left_out) THEN 'A rule you approved leaves "' || header || '" out of migrations.'
 WHEN gate = 'shared_header' THEN 'Header "' || header || '" names a concept shared by ' || (SELECT string_agg(label, ' and ' ORDER BY place) FROM e WHERE e.column_id = d.column_id) || '.'
 WHEN gate = 'contended' THEN 'Another column in ' || d.file_id || '.csv claims the same target field.' WHEN gate = 'mapped' THEN (SELECT evidence FROM e WHERE e.column_id = d.column_id AND target = one)
 ELSE (SELECT arg_min(evidence, place) FROM e WHERE e.column_id = d.column_id) END AS evidence FROM decided d JOIN cols USING (column_id)"""
)
def gate_evidence(spark, sf_dir):
    """What each gate says of its decision, some headers being left out by rules."""
    cols, decisions, known = decided_without_unknown(spark, sf_dir)
    return issues.decision_evidence(cols, decisions, known, TRADE).select("column_id", F.array_join("evidence", " ").alias("evidence"))


# --- decisions on issues: every event is an issue about the column or records of its user ---
def _issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    none, u = F.lit(None).cast("string"), F.col("user_id").cast("string")
    option = lambda i, target, value: F.struct(i.alias("id"), target.alias("target"), value.alias("value"))
    options = F.array(
        option(F.lit("map:tier"), F.lit("tier"), none), option(F.concat(F.lit("use:c"), u), F.lit("placedDate"), none), option(F.lit("ignore"), none, none),
        option(F.lit("value:x"), none, F.lit("x")), option(F.concat(F.lit("exclude:r"), u), none, none),
    )
    return e.select(
        F.concat(F.lit("issue:"), "event_id").alias("issue_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), u)).alias("column_id"), options.alias("options"),
        F.when(F.col("event_id") % 3 != 0, F.lit("customerEmail")).alias("field"), F.array(F.concat(F.lit("r"), u), F.concat(F.lit("s"), u)).alias("record_ids"), F.lit("open").alias("status"),
    )


def _decisions(spark, sf_dir):
    """Of seven events one is left open; the others choose options in turn."""
    e, n = table(spark, sf_dir, "events").filter("event_id % 7 <> 0"), F.col("event_id")
    u = F.col("user_id").cast("string")
    option = F.when(n % 7 == 1, F.lit("map:tier")).when(n % 7 == 2, F.concat(F.lit("use:c"), u)).when(n % 7 == 3, F.lit("ignore")).when(n % 7 == 4, F.lit("value:x")).when(n % 7 == 5, F.concat(F.lit("exclude:r"), u))
    action = F.when(n % 11 == 0, F.lit("reject")).when((n % 7 == 6) & (n % 2 == 0), F.lit("exclude"))
    return e.select(F.concat(F.lit("issue:"), "event_id").alias("issue_id"), action.alias("action"), option.alias("option_id"), F.when(n % 7 == 6, F.concat(F.lit("v"), n.cast("string"))).alias("value"), n.alias("pos"))


@query("SELECT 'issue:' || event_id AS issue_id, CASE WHEN event_id % 7 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 11 = 0 THEN 'reject' WHEN event_id % 7 = 6 AND event_id % 2 = 0 THEN 'exclude' ELSE 'approve' END END AS action FROM events")
def issues_resolved(spark, sf_dir):
    return review.resolve(_issues(spark, sf_dir), _decisions(spark, sf_dir)).select("issue_id", "status", F.col("chosen.action").alias("action"))


@query("SELECT 'c' || user_id AS column_id, CASE event_id % 7 WHEN 1 THEN 'tier' ELSE 'placedDate' END AS target, event_id AS pos FROM events WHERE user_id % 4 <> 0 AND event_id % 11 <> 0 AND (event_id % 7 = 1 AND event_id % 2 = 0 OR event_id % 7 = 2)")
def mapping_resolutions(spark, sf_dir):
    columns = table(spark, sf_dir, "events").filter("user_id % 4 <> 0").select(F.concat(F.lit("c"), "user_id").alias("column_id")).distinct()
    return review.mapping_corrections(_issues(spark, sf_dir), _decisions(spark, sf_dir), columns).select("column_id", "target", "pos")


@query("SELECT DISTINCT 'r' || user_id AS record_id FROM events WHERE event_id % 7 = 5 OR event_id % 7 = 6 AND event_id % 2 = 0 AND event_id % 11 <> 0 UNION SELECT 's' || user_id FROM events WHERE event_id % 7 = 6 AND event_id % 2 = 0 AND event_id % 11 <> 0")
def record_exclusions(spark, sf_dir):
    return review.record_resolutions(_issues(spark, sf_dir), _decisions(spark, sf_dir))[0]


_FIXES = "SELECT p || user_id AS record_id, event_id AS pos, CASE WHEN event_id % 7 = 4 THEN 'x' ELSE 'v' || event_id END AS value FROM events, (VALUES ('r'), ('s')) t(p) WHERE event_id % 3 <> 0 AND (event_id % 7 = 4 OR event_id % 7 = 6 AND (event_id % 2 <> 0 OR event_id % 11 = 0))"


@query(f"WITH f AS ({_FIXES}), r AS (SELECT DISTINCT p || user_id AS id, user_id % 3 + 1 AS revision FROM events, (VALUES ('r'), ('s')) t(p)), w AS (SELECT record_id, arg_max(value, pos) AS value FROM f GROUP BY 1) SELECT id, CAST(revision + CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS revision, coalesce(value, 'old') AS \"customerEmail\" FROM r LEFT JOIN w ON record_id = id")
def corrections_last_wins(spark, sf_dir):
    gone, fixes = review.record_resolutions(_issues(spark, sf_dir), _decisions(spark, sf_dir))
    e = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat(F.lit("r"), "user_id"), F.concat(F.lit("s"), "user_id"))).alias("id"), (F.col("user_id") % 3 + 1).alias("revision")).distinct()
    records = e.select("*", *[F.lit("old" if f.name == "customerEmail" else None).cast("string").alias(f.name) for f in ORDER.fields])
    return review.apply_corrections(records, fixes, gone, ORDER).select("id", F.col("revision").cast("long").alias("revision"), "customerEmail")


# --- rules ---
def _rules(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(n % 5 == 0, F.lit("HEADER_ALIAS")).when(n % 5 == 1, F.lit("VALUE_ALIAS")).when(n % 5 == 2, F.lit("DATE_ORDER")).when(n % 5 == 3, F.lit("COLUMN_IGNORE")).otherwise(F.lit("OVERRIDE"))
    field = F.when(n % 4 == 0, F.lit("tier")).when(n % 4 == 1, F.lit("placedDate")).when(n % 4 == 2, F.lit("nothing"))
    return e.select(
        F.concat(F.lit("rule_"), n.cast("string")).alias("rule_id"), kind.alias("kind"), field.alias("field_name"), F.when(n % 3 == 0, F.lit("date")).when(n % 3 == 1, F.concat(F.lit("t"), (F.col("user_id") % 30).cast("string"))).alias("term"),
        F.when(n % 2 == 0, F.lit("low")).otherwise(F.lit("nope")).alias("canonical"), F.when(n % 7 < 4, F.lit("day_first")).otherwise(F.lit("month_first")).alias("date_order"),
        F.when(n % 6 == 0, F.lit("other")).otherwise(F.lit("order")).alias("schema_id"), (n % 9 != 0).alias("enabled"), n.alias("pos"),
    )


_R = """WITH r AS (SELECT 'rule_' || event_id AS rule_id, event_id AS pos, ['HEADER_ALIAS', 'VALUE_ALIAS', 'DATE_ORDER', 'COLUMN_IGNORE', 'OVERRIDE'][event_id % 5 + 1] AS kind, ['tier', 'placedDate', 'nothing', NULL][event_id % 4 + 1] AS field_name,
 CASE event_id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 't' || user_id % 30 END AS term, CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'nope' END AS canonical, CASE WHEN event_id % 7 < 4 THEN 'day_first' ELSE 'month_first' END AS date_order,
 CASE WHEN event_id % 6 = 0 THEN 'other' ELSE 'order' END AS schema_id, event_id % 9 <> 0 AS enabled, event_id FROM events)"""


@query(_R + """ SELECT rule_id, CASE WHEN kind IN ('OVERRIDE', 'COLUMN_IGNORE') THEN NULL WHEN kind = 'HEADER_ALIAS' AND term = 'date' THEN 'header is claimed by several fields'
 WHEN (kind <> 'DATE_ORDER' OR field_name IS NOT NULL) AND coalesce(field_name, 'nothing') = 'nothing' THEN 'unknown field' WHEN kind = 'VALUE_ALIAS' AND field_name <> 'tier' THEN 'not an enum field' WHEN kind = 'VALUE_ALIAS' AND canonical <> 'low' THEN 'not a permitted value'
 WHEN kind = 'DATE_ORDER' AND field_name = 'tier' THEN 'not a date field' END AS refused FROM r""")  # fmt: skip
def rule_checks(spark, sf_dir):
    return review.check_rules(_rules(spark, sf_dir), ORDER)


_ACTIVE = _R + """, k AS (SELECT *, CASE WHEN kind = 'VALUE_ALIAS' OR kind = 'DATE_ORDER' AND term IS NULL THEN field_name END AS scope, pos % 2 AS layer FROM r WHERE enabled AND kind <> 'OVERRIDE' AND schema_id = 'order' AND event_id % 8 <> 3),
 a AS (SELECT kind, scope, term, arg_max(rule_id, (layer, pos)) AS rule_id, arg_max(date_order, (layer, pos)) AS date_order FROM k GROUP BY 1, 2, 3)"""


def _active(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    off = rules.filter("pos % 8 = 3").select(F.col("rule_id").alias("targets_rule_id"), F.lit(True).alias("enabled"))
    return review.active_rules(review.layered(rules.filter("pos % 2 = 0"), rules.filter("pos % 2 = 1")), off, "order")


@query(_ACTIVE + " SELECT kind, scope, term, rule_id FROM a")
def rule_layers_by_schema(spark, sf_dir):
    return _active(spark, sf_dir).select("kind", "scope", "term", "rule_id")


@query(_ACTIVE + ", c AS (SELECT event_id, 't' || user_id % 40 AS h, CASE WHEN event_id % 2 = 0 THEN 'placedDate' ELSE 'tier' END AS target FROM events) SELECT c.event_id, coalesce(x.date_order, y.date_order) AS date_order FROM c LEFT JOIN (SELECT * FROM a WHERE kind = 'DATE_ORDER' AND scope IS NULL) x ON x.term = h LEFT JOIN (SELECT * FROM a WHERE kind = 'DATE_ORDER' AND scope IS NOT NULL) y ON y.scope = target")
def date_order_precedence(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("h"), F.when(F.col("event_id") % 2 == 0, F.lit("placedDate")).otherwise(F.lit("tier")).alias("target"))
    return review.date_orders(c, _active(spark, sf_dir)).select("event_id", "date_order")


@query(_R + """ SELECT rule_id, CASE WHEN event_id % 13 = 0 THEN 'The model judged that this decision does not generalise.' WHEN kind = 'OVERRIDE' THEN 'The model proposed a kind of rule the engine does not accept.'
 WHEN kind = 'DATE_ORDER' AND event_id % 10 = 2 THEN 'The drafted date rule named no usable reading.' WHEN kind = 'COLUMN_IGNORE' THEN CASE WHEN term IS NULL THEN 'needs header' END WHEN kind = 'HEADER_ALIAS' AND (term IS NULL OR field_name IS NULL) THEN 'needs header and field' WHEN kind = 'VALUE_ALIAS' AND (field_name IS NULL OR term IS NULL) THEN 'needs field, value and canonical value'
 WHEN kind = 'DATE_ORDER' AND term IS NULL AND field_name IS NULL THEN 'needs column or field' WHEN kind = 'HEADER_ALIAS' AND term = 'date' THEN 'header is claimed by several fields' WHEN (kind <> 'DATE_ORDER' OR field_name IS NOT NULL) AND field_name = 'nothing' THEN 'unknown field'
 WHEN kind = 'VALUE_ALIAS' AND field_name <> 'tier' THEN 'not an enum field' WHEN kind = 'VALUE_ALIAS' AND canonical <> 'low' THEN 'not a permitted value' WHEN kind = 'DATE_ORDER' AND field_name = 'tier' THEN 'not a date field' END AS refused,
 CASE WHEN kind IN ('VALUE_ALIAS', 'DATE_ORDER') THEN 'value' ELSE 'column' END AS scope FROM r""")  # fmt: skip
def draft_verification(spark, sf_dir):
    n = F.col("pos")
    drafts = _rules(spark, sf_dir).withColumns({"header": F.col("term"), "value": F.col("term"), "generalises": n % 13 != 0, "date_order": F.when(n % 10 == 2, F.lit("any")).otherwise(F.col("date_order")), "targets_rule_id": F.lit(None).cast("string")})
    return rulebook.verify_drafts(drafts, ORDER)


@query("SELECT DISTINCT 'h' || user_id % 50 AS header, CASE WHEN event_id % 2 = 0 THEN 'tier' ELSE 'placedDate' END AS field_name FROM events WHERE event_id % 3 = 1")
def learned_header_rules(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    columns = e.select(n.cast("string").alias("column_id"), F.when(n % 3 == 0, F.lit(" Date ")).when(n % 3 == 1, F.concat(F.lit("H-"), F.col("user_id") % 50)).otherwise(F.lit("??")).alias("header"))
    verified = e.select(n.cast("string").alias("column_id"), F.when(n % 2 == 0, F.lit("tier")).otherwise(F.lit("placedDate")).alias("target"))
    return rulebook.learned_from_mappings(verified, columns, ORDER, "order").select("header", "field_name")


@query(_R + " SELECT rule_id FROM r WHERE coalesce(term, '') LIKE '%t1%' OR lower(coalesce(field_name, '')) LIKE '%t-1%' OR canonical LIKE '%t-1%'")
def rule_search(spark, sf_dir):
    return rulebook.search(_rules(spark, sf_dir).withColumns({"header": F.col("term"), "value": F.lit(None).cast("string")}), " T-1 ").select("rule_id")


@query(_R + " SELECT min(event_id) AS pos FROM r WHERE pos % 10 <> 9 GROUP BY kind, field_name, term, canonical, date_order, schema_id HAVING (kind, coalesce(field_name, '?'), coalesce(term, '?'), canonical, date_order, schema_id) NOT IN (SELECT (kind, coalesce(field_name, '?'), coalesce(term, '?'), canonical, date_order, schema_id) FROM r WHERE pos % 10 = 9)")
def accepted_rules(spark, sf_dir):
    rules = _rules(spark, sf_dir).withColumns({"header": F.col("term"), "value": F.lit("")})
    return rulebook.accept_new(rules.filter("pos % 10 <> 9"), rules.filter("pos % 10 = 9")).select("pos")


# --- counters and views: orders are records, their lines' events the mappings ---
def _records(spark, sf_dir):
    k = F.col("o_orderkey")
    state = F.when(k % 7 == 0, F.lit("failed")).when(k % 7 == 1, F.lit("excluded")).when(k % 7 == 2, F.lit("retry_wait")).otherwise(F.lit("delivered"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("rec:"), k.cast("string")).alias("id"), state.alias("disposition"), (k % 3).alias("n_repairs"), k.alias("k"))


def _mappings(spark, sf_dir):
    n = F.col("event_id")
    basis = F.when(n % 3 == 0, F.lit("alias")).when(n % 3 == 1, F.lit("learned")).otherwise(F.lit("unmapped"))
    outcome = F.when(n % 3 == 2, F.lit("ESCALATED")).otherwise(F.lit("AUTO_MAPPED"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("c"), "user_id").alias("column_id"), n.alias("pos"), outcome.alias("outcome"), basis.alias("basis"), F.when(n % 2 == 0, F.lit("tier")).otherwise(F.lit("orderRef")).alias("target"), F.lit("agent").alias("decided_by"))


_COUNTED = """WITH m AS (SELECT user_id, arg_max(event_id, event_id) AS n FROM events GROUP BY 1), mm AS (SELECT count(*) FILTER (WHERE n % 3 <> 2) AS auto_mapped, count(*) FILTER (WHERE n % 3 = 2) AS escalated, count(*) FILTER (WHERE n % 3 <> 2) AS rule_hits, count(*) FILTER (WHERE n % 3 = 1) AS learned_hits FROM m),
 r AS (SELECT count(*) AS records, CAST(sum(o_orderkey % 3) AS BIGINT) AS repairs, count(*) FILTER (WHERE o_orderkey % 7 > 2) AS delivered, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS failed, count(*) FILTER (WHERE o_orderkey % 7 = 1) AS excluded, count(*) FILTER (WHERE o_orderkey % 7 = 2) AS retrying FROM orders),
 i AS (SELECT count(*) FILTER (WHERE event_id % 4 = 0) AS awaiting_review FROM events), n AS (SELECT count(*) AS source_rows FROM lineitem),
 q AS (SELECT CAST(sum(event_id % 2) AS BIGINT) AS model_requests FROM events), c AS (SELECT *, greatest(0, source_rows - records) AS merged, learned_hits AS model_requests_avoided FROM r, mm, i, n, q)"""


def _counted(spark, sf_dir, open_issues: bool = True):
    status = F.when(F.col("event_id") % 4 == 0, F.lit("open" if open_issues else "resolved")).otherwise(F.lit("resolved"))
    i = table(spark, sf_dir, "events").select(status.alias("status"), F.lit(True).alias("blocking"))
    rows = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("n"))
    return views.counters(_records(spark, sf_dir), _mappings(spark, sf_dir), i, rows, asked)


@query(_COUNTED + " SELECT * FROM c")
def run_counters(spark, sf_dir):
    return _counted(spark, sf_dir)


@query("SELECT count(*) FILTER (WHERE event_id % 3 <> 2) AS auto, count(*) FILTER (WHERE event_id % 3 = 2) AS escalated, count(*) FILTER (WHERE event_id % 3 = 1) AS learned FROM events")
def mapping_summary(spark, sf_dir):
    return views.mapping_summary(_mappings(spark, sf_dir))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 7 = 2 THEN 'retry_wait' ELSE 'succeeded' END AS state, count(*) AS n FROM orders GROUP BY 1")
def delivery_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    return views.delivery_summary(table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.lit("failed")).when(k % 7 == 2, F.lit("retry_wait")).otherwise(F.lit("succeeded")).alias("state")))


_PHASES = "CASE phase " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in views.PHASES.items()) + " END"


@query(
    _COUNTED + f""", e AS (SELECT max(event_id) AS latest_seq FROM events), p AS (SELECT unnest(['{"', '".join(views.PHASES)}']) AS phase),
 s AS (SELECT phase, {_PHASES} AS phase_label, phase IN ('ingested', 'analyzing', 'ready', 'delivering') AS active, latest_seq, source_rows, records, merged,
 CASE phase WHEN 'blocked' THEN 'This migration cannot continue.' WHEN 'ingested' THEN 'Reading 2 files' WHEN 'analyzing' THEN 'Working out which column means what' WHEN 'review' THEN 'Reviewing what was found' WHEN 'ready' THEN 'Getting ready to send ' || records || ' records'
 WHEN 'delivering' THEN 'Sending ' || (delivered + 1) || ' of ' || (records - excluded) || ' records' WHEN 'complete' THEN delivered || ' records sent to the destination' ELSE delivered || ' records sent, ' || (failed + excluded) || ' did not go' END AS headline,
 source_rows || ' rows from 2 files' AS read, auto_mapped || ' of ' || (auto_mapped + escalated) || ' columns matched automatically' AS matched, 'Combined ' || merged || ' duplicate rows, tidied ' || repairs || ' values' AS checked, delivered || ' of ' || (delivered + failed + retrying) || ' sent' AS sent
 FROM c, e, p) SELECT phase, phase_label, active, latest_seq, headline, read, matched, checked, sent, source_rows || ' rows across your files became ' || records || ' records after combining ' || merged || ' duplicate rows.' AS reconciled FROM s"""
)
def run_views(spark, sf_dir):
    run = spark.createDataFrame([("run-1", p, False, 2, None) for p in views.PHASES], "run_id string, phase string, paused boolean, n_files int, blocked_reason string")
    rows = views.run_view(run, _counted(spark, sf_dir, False), table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))).withColumn("d", views.stage_details())
    return rows.select("phase", "phase_label", "active", "latest_seq", "headline", F.col("d.read").alias("read"), F.col("d.match").alias("matched"), F.col("d.check").alias("checked"), F.col("d.send").alias("sent"), "reconciled")


@query("WITH m AS (SELECT user_id, max(event_id) AS n FROM events GROUP BY 1) SELECT CASE WHEN user_id % 2 = 0 THEN 'f.csv' ELSE '' END AS file, CASE WHEN user_id % 2 = 0 THEN 'Head ' || user_id ELSE 'c' || user_id END AS \"column\", CASE WHEN n % 2 = 0 THEN 'tier' ELSE 'orderRef' END AS target, CASE WHEN n % 2 = 0 THEN 'Tier' ELSE 'Order ref' END AS target_label, CASE WHEN n % 3 = 2 THEN 'ESCALATED' ELSE 'AUTO_MAPPED' END AS outcome FROM m")
def mapping_views(spark, sf_dir):
    u = F.col("user_id")
    columns = table(spark, sf_dir, "events").filter("user_id % 2 = 0").select(F.concat(F.lit("c"), u).alias("column_id"), F.concat(F.lit("Head "), u).alias("header"), F.lit("f.csv").alias("file_name")).distinct()
    return views.mapping_view(_mappings(spark, sf_dir), columns, ORDER).select("file", "column", "target", "target_label", "outcome")


@query("SELECT 'rec:' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'rec:' || o_orderkey ELSE 'O-' || o_orderkey END AS subject, CASE WHEN o_orderkey % 7 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'bad row (HTTP 422)' WHEN 1 THEN 'no answer' ELSE 'The destination refused this record.' END ELSE 'e' || o_orderkey END AS messages FROM orders")
def record_views(spark, sf_dir):
    k = F.col("k")
    r = _records(spark, sf_dir)
    records = r.select("id", "disposition", F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("O-"), k.cast("string"))).alias("orderRef"), F.array(F.struct(F.concat(F.lit("e"), k.cast("string")).alias("message"))).alias("errors"))
    attempt = lambda status, detail: F.struct(F.lit(status).cast("int").alias("status"), F.lit(detail).alias("detail"))
    attempts = F.when(k % 3 == 0, F.array(attempt(503, "busy"), attempt(422, "bad row"), attempt(500, ""))).when(k % 3 == 1, F.array(attempt(None, "no answer")))
    deliveries = r.filter("k % 7 = 0").select(F.col("id").alias("record_id"), F.lit("t").alias("target_id"), attempts.alias("attempts"))
    return views.record_view(records, deliveries, ORDER).select("id", "subject", F.array_join("messages", ";").alias("messages"))


@query("SELECT 'issue:' || event_id AS issue_id, CASE WHEN event_id % 3 <> 0 THEN 'Customer email' END AS field_label, CAST(2 AS BIGINT) AS affected, CASE WHEN event_id % 2 = 0 AND user_id % 2 = 0 THEN 'Head ' || user_id END AS \"column\" FROM events")
def issue_views(spark, sf_dir):
    u = F.col("user_id")
    columns = table(spark, sf_dir, "events").filter("user_id % 2 = 0").select(F.concat(F.lit("c"), u).alias("column_id"), F.concat(F.lit("Head "), u).alias("header"), F.lit("f.csv").alias("file_name")).distinct()
    rows = _issues(spark, sf_dir).withColumns({"type": F.lit("DUPLICATE_EMAIL"), "reason": F.lit("why"), "blocking": F.lit(False)})
    return views.issue_view(rows, columns, ORDER).select("issue_id", "field_label", "affected", "column")


@query("SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'human' WHEN event_type = 'click' THEN 'model' ELSE 'unknown' END AS execution_basis, CASE WHEN event_id % 2 = 0 THEN 'rule_' || user_id END AS rule_id FROM events WHERE event_id > 100")
def event_views(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    basis = F.when(F.col("event_type") == "view", F.lit("human")).when(F.col("event_type") == "click", F.lit("model")).when(F.col("event_type") == "error", F.lit("odd"))
    detail = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("rule_id"), F.concat(F.lit("rule_"), "user_id"), F.lit("secret"), F.lit("x"))).otherwise(F.create_map(F.lit("other"), F.lit("y")))
    rows = e.select(F.col("event_id").alias("seq"), F.lit("agent").alias("actor"), basis.alias("execution_basis"), F.col("event_type").alias("action"), detail.alias("detail"))
    return views.event_view(rows, 100).select("seq", "execution_basis", "rule_id")


@query("SELECT event_id AS seq FROM events WHERE event_id % 2 = 0 OR event_id > 300")
def client_event_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return views.merge_events(e.filter("seq % 2 = 0"), e.filter("seq > 300"))


@query("SELECT coalesce(max(event_id), 0) + 1 AS next_seq FROM events")
def next_sequence(spark, sf_dir):
    return review.next_sequence(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq")))


# --- delivery ---
@query("SELECT 'rec:' || o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 2 OR o_orderkey % 7 = 0 AND o_orderkey % 2 = 0")
def deliverable_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    intents = r.filter("k % 3 <> 5").select(F.col("id").alias("record_id"), F.when(F.col("k") % 2 == 0, F.lit("retry_wait")).otherwise(F.lit("failed")).alias("state"))
    return deliver.deliverable(r, intents).select("id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Rejected. a; b; c' WHEN 1 THEN 'The destination rejected the record.' WHEN 2 THEN 'The destination returned 503 on every one of 3 attempts. It may need checking before retrying.' ELSE 'plain ' || o_orderkey END AS detail FROM orders")
def failure_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    full = '{"detail": {"message": "Rejected.", "errors": [{"message": "a"}, {"message": "b"}, {"message": "c"}, {"message": "d"}]}}'
    body = F.when(k % 4 == 0, F.lit(full)).when(k % 4 == 1, F.lit('{"detail": {"errors": []}}')).when(k % 4 == 2, F.lit("<html>")).otherwise(F.concat(F.lit('{"detail": "plain '), k.cast("string"), F.lit('"}')))
    return table(spark, sf_dir, "orders").select("o_orderkey", deliver.failure_text(body, F.when(k % 4 == 2, 503).otherwise(422), F.lit(3)).alias("detail"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 5 = 0 THEN 2.0 WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 7.0 ELSE 2.0 ** (event_id % 3 + 1) END END::DOUBLE AS wait FROM events")
def retry_waits(spark, sf_dir):
    n = F.col("event_id")
    status = F.when(n % 5 == 0, F.lit(None).cast("int")).when(n % 5 == 1, F.lit(429)).otherwise(F.lit(422))
    return table(spark, sf_dir, "events").select("event_id", deliver.backoff(status, n % 3 + 1, F.when(n % 2 == 0, F.lit(7))).alias("wait"))


@query("SELECT user_id, greatest(0, 6 - count(*)) AS left_over, count(*) < 6 AS may_ask FROM events GROUP BY 1")
def quota_left(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return used.select("user_id", deliver.remaining(F.col("n"), 6).alias("left_over"), deliver.may_ask(F.col("n")).alias("may_ask"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 7")
def receipt_count(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("key"))
    return deliver.count_receipts(r, "7")


@query(f"SELECT event_id, 'Order' AS name, {len(ORDER.fields)} AS n_fields FROM events WHERE event_id % 2 = 0")
def schema_envelopes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(deliver.schema_envelope(ORDER))).otherwise(F.lit("?")).alias("header"))
    read = e.select("event_id", deliver.read_envelope(F.col("header")).alias("c")).filter("c IS NOT NULL")
    return read.select("event_id", F.col("c.name").alias("name"), F.size("c.fields").alias("n_fields"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def retryable_errors(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", F.lit("RateLimitError")).when(F.col("event_type") == "view", F.lit("ReadTimeout")).otherwise(F.lit("ValueError"))
    return table(spark, sf_dir, "events").filter(deliver.retryable_error(kind)).select("event_id")


@query("SELECT DISTINCT 'c' || user_id AS column_id, '- id=c' || user_id || ' header=\"Head ' || user_id || '\" shape=' || CASE WHEN user_id % 2 = 0 THEN 'date' ELSE 'unknown' END || ' filled=' || user_id || '/100 distinct=5' || CASE WHEN user_id % 3 = 0 THEN ' examples=[\"a\", \"b\", \"c\"]' ELSE '' END AS line FROM events")
def column_descriptions(spark, sf_dir):
    u = F.col("user_id")
    c = table(spark, sf_dir, "events").select(u, F.concat(F.lit("c"), u).alias("column_id")).distinct()
    none = F.array().cast("array<string>")
    profiles = c.select("column_id", F.lit(100).alias("total_count"), u.alias("non_empty_count"), F.lit(5).alias("distinct_count"), F.when(u % 2 == 0, F.array(F.lit("date"))).otherwise(none).alias("detected_kinds"), F.when(u % 3 == 0, F.array(*map(F.lit, "abcd"))).otherwise(none).alias("samples"))
    return deliver.describe_columns(c.select("column_id", F.concat(F.lit("Head "), u).alias("header")), profiles)
