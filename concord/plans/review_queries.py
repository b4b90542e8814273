"""Queries of issues, decisions and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contract import ORDER
from ..functions import text
from ..operators import issues, profile, reconcile, review, rulebook
from .base import ENUM, d_trim, query, table
from .catalog import TRADE, columns, duck, view
from .mapping_queries import _COLS, _DECLARED, _NORM, _SPELL
from .merge_queries import _CANON, _CONFLICT, _MERGE, _Q, union_rows
from .profile_queries import _CELLS, _PROFILED, _cells
from .scalar_queries import _D

# --- issues, decisions, rules ---
def _issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("issue:"), "event_id").alias("issue_id"), F.col("event_type").alias("reason"), F.when(F.col("event_id") % 3 == 0, F.lit("resolved")).otherwise(F.lit("open")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.lit("accept")).alias("resolution"), (F.col("event_type") == "error").alias("blocking"), F.array(F.lit("a"), F.concat(F.lit("o"), F.col("event_id") % 5)).alias("options"), "event_id")


_ISSUES = "WITH i AS (SELECT 'issue:' || event_id AS issue_id, event_type AS reason, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN 'accept' END AS resolution, event_type = 'error' AS blocking, event_id, ['a', 'o' || event_id % 5] AS options FROM events)"


@query(_MERGE + f", c AS ({_CONFLICT}) SELECT type, blocking, count(*) AS n FROM (SELECT 'IDENTITY_CONFLICT' AS type, TRUE AS blocking FROM c UNION ALL SELECT 'DUPLICATE_EMAIL', FALSE FROM (SELECT 1 FROM rec WHERE {d_trim(_Q('customerEmail'))} <> '' GROUP BY lower({_CANON['customerEmail']}) HAVING count(*) > 1)) GROUP BY 1, 2")
def issue_union(spark, sf_dir):
    r = reconcile.merge(union_rows(spark, sf_dir), ORDER)
    d = reconcile.duplicates(r, ORDER).select(F.lit("DUPLICATE_EMAIL").alias("type"), F.lit(False).alias("blocking"))
    return issues.conflict_issues(r, ORDER).select("type", "blocking").unionAll(d).groupBy("type", "blocking").agg(F.count(F.lit(1)).alias("n"))


@query(_ISSUES + ", n AS (SELECT issue_id, 'again ' || reason AS reason, 'open' AS status FROM i WHERE event_id % 2 = 0) SELECT i.issue_id, coalesce(n.reason, i.reason) AS reason, i.status, i.resolution FROM i LEFT JOIN n USING (issue_id)")
def issue_upsert_sticky(spark, sf_dir):
    i = _issues(spark, sf_dir)
    new = i.filter("event_id % 2 = 0").select("issue_id", F.concat(F.lit("again "), "reason").alias("reason"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"))
    return review.upsert_issues(i.select("issue_id", "reason", "status", "resolution"), new)


@query(_ISSUES + " SELECT count(*) FILTER (WHERE blocking AND status = 'open') AS open_blocking, CASE WHEN count(*) FILTER (WHERE blocking AND status = 'open') > 0 THEN 'review' ELSE 'deliver' END AS route FROM i")
def route_blocking(spark, sf_dir):
    return review.route(_issues(spark, sf_dir))


@query(_ISSUES + ", d AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'issue:x' ELSE issue_id END AS issue_id, CASE WHEN event_id % 5 = 0 THEN 'explode' ELSE 'accept' END AS action, CASE WHEN event_id % 2 = 0 THEN 'o1' END AS option_id FROM i) SELECT issue_id, action, option_id, CASE WHEN i.issue_id IS NULL THEN 'unknown issue' WHEN action = 'explode' THEN 'unknown action' ELSE 'unknown option' END AS refused FROM d LEFT JOIN i USING (issue_id) WHERE i.issue_id IS NULL OR action = 'explode' OR (option_id IS NOT NULL AND NOT list_contains(options, option_id))")
def decision_validation(spark, sf_dir):
    i = _issues(spark, sf_dir)
    d = i.select(F.when(F.col("event_id") % 7 == 0, F.lit("issue:x")).otherwise(F.col("issue_id")).alias("issue_id"), F.when(F.col("event_id") % 5 == 0, F.lit("explode")).otherwise(F.lit("accept")).alias("action"), F.when(F.col("event_id") % 2 == 0, F.lit("o1")).alias("option_id"))
    return review.check_decisions(d, i)


@query(_MERGE + """ SELECT id, CASE WHEN CAST(right(key, 7) AS BIGINT) % 11 = 0 THEN 'fixed@example.com' ELSE "customerEmail" END AS "customerEmail", CAST(CASE WHEN CAST(right(key, 7) AS BIGINT) % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision, CAST(right(key, 7) AS BIGINT) % 17 = 0 AS excluded FROM rec""")
def record_corrections(spark, sf_dir):
    r = reconcile.merge(union_rows(spark, sf_dir), ORDER)
    number = F.right("key", F.lit(7)).cast("long")
    fixes = r.filter(number % 11 == 0).select(F.col("id").alias("record_id"), F.lit("customerEmail").alias("field"), F.lit("fixed@example.com").alias("value"), F.lit(1).alias("pos"))
    out = review.apply_corrections(r, fixes, r.filter(number % 17 == 0).select(F.col("id").alias("record_id")), ORDER)
    return out.select("id", "customerEmail", F.col("revision").cast("long").alias("revision"), "excluded")


def _rules(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("rule_"), "event_id").alias("rule_id"), F.when(F.col("event_id") % 2 == 0, F.lit("HEADER_ALIAS")).otherwise(F.lit("VALUE_ALIAS")).alias("kind"), F.lit("tier").alias("field_name"), F.concat(F.lit("t"), F.col("user_id") % 50).alias("term"), (F.col("event_id") % 9 != 0).alias("enabled"), F.lit(1).alias("layer"), F.col("event_id").alias("pos"), F.col("event_id").alias("n"))


@query("WITH r AS (SELECT 'rule_' || event_id AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'HEADER_ALIAS' ELSE 'VALUE_ALIAS' END AS kind, 't' || user_id % 50 AS term, event_id AS pos FROM events WHERE event_id % 9 <> 0 AND event_id % 4 <> 3) SELECT kind, term, arg_max(rule_id, pos) AS rule_id FROM r GROUP BY 1, 2")
def rule_layering(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    off = rules.filter("n % 4 = 3").select(F.col("rule_id").alias("targets_rule_id"), F.lit(True).alias("enabled"))
    return review.active_rules(rules, off).select("kind", "term", "rule_id")


@query("WITH r AS (SELECT 'rule_' || event_id AS rule_id FROM events), o AS (SELECT 'rule_' || event_id AS rule_id FROM events WHERE event_id % 4 = 3) SELECT rule_id, rule_id IN (SELECT rule_id FROM o) AS overridden FROM r")
def rule_listing_overridden(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    return review.overridden(rules, rules.filter("n % 4 = 3").select(F.col("rule_id").alias("targets_rule_id"), F.lit(True).alias("enabled"))).select("rule_id", "overridden")


_VALUES = ", ".join(f"('{a}', '{c}')" for a, c in ENUM.value_aliases.items())


@query(
    f"""{_COLS}, one AS (SELECT spelling, min(target) AS target FROM spell GROUP BY 1 HAVING count(*) = 1) SELECT 'HEADER_ALIAS' AS kind, target AS field_name, spelling AS term, CAST(NULL AS VARCHAR) AS canonical, count(*) AS n FROM one JOIN cols ON spelling = {_NORM} WHERE spelling <> lower(target) GROUP BY 2, 3
 UNION ALL SELECT 'VALUE_ALIAS', 'tier', term, canonical, count(*) FROM (VALUES {_VALUES}) v(term, canonical) JOIN orders ON term = regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') GROUP BY 3, 4"""
)
def builtin_rules(spark, sf_dir):
    """Rules that come with a contract, and how many headers and values of the tables each of them reads."""
    heads = columns(spark, sf_dir).select(text.normalize_header(F.col("header")).alias("term"), F.lit("HEADER_ALIAS").alias("kind"))
    read = table(spark, sf_dir, "orders").select(text.normalize_header(F.col("o_orderpriority")).alias("term"), F.lit("VALUE_ALIAS").alias("kind"))
    rules = review.builtin_rules(spark, TRADE).filter("kind = 'HEADER_ALIAS'").unionByName(review.builtin_rules(spark, ORDER).filter("kind = 'VALUE_ALIAS'"))
    return heads.unionByName(read).join(F.broadcast(rules), ["kind", "term"]).groupBy("kind", "field_name", "term", "canonical").agg(F.count(F.lit(1)).alias("n"))


_KIND_OF = ["HEADER_ALIAS", "VALUE_ALIAS", "DATE_ORDER", "COLUMN_IGNORE", "OVERRIDE"]
_FIELD_OF = ["orderRef", "tier", "placedDate", "color", None, "shippedDate"]
_TERM_OF = ["buyer", "date", "asap"]


def _pick(options: list, n):
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in options]), (n % len(options) + 1).cast("int"))


def _picked(options: list, n: str) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in options) + f"][CAST({n} % {len(options)} + 1 AS BIGINT)]"


@query(
    f"WITH {_SPELL}, {_DECLARED}, shared AS (SELECT spelling FROM spell GROUP BY 1 HAVING count(*) > 1), "
    f"r AS (SELECT event_id AS rule_id, {_picked(_KIND_OF, 'event_id')} AS k, {_picked(_FIELD_OF, 'user_id')} AS target, {_picked(_TERM_OF, 'event_id')} AS term, CASE WHEN user_id % 4 = 0 THEN 'urgent' ELSE 'now' END AS canonical FROM events) "
    f"""SELECT rule_id, CASE WHEN k = 'HEADER_ALIAS' AND term IN (SELECT spelling FROM shared) THEN 'header is claimed by several fields'
 WHEN declared.kind IS NULL AND (k IN ('HEADER_ALIAS', 'VALUE_ALIAS') OR k = 'DATE_ORDER' AND coalesce(target, '') <> '') THEN 'unknown field' WHEN k = 'VALUE_ALIAS' AND declared.kind <> 'enum' THEN 'not an enum field'
 WHEN k = 'VALUE_ALIAS' AND canonical NOT IN ({', '.join(repr(v) for v in ENUM.values)}) THEN 'not a permitted value' WHEN k = 'DATE_ORDER' AND declared.kind <> 'date' THEN 'not a date field' END AS refused
 FROM r LEFT JOIN declared USING (target)"""
)
def rule_schema_check_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rules = e.select(F.col("event_id").alias("rule_id"), _pick(_KIND_OF, F.col("event_id")).alias("kind"), _pick(_FIELD_OF, F.col("user_id")).alias("field_name"), _pick(_TERM_OF, F.col("event_id")).alias("term"), F.when(F.col("user_id") % 4 == 0, F.lit("urgent")).otherwise(F.lit("now")).alias("canonical"))
    return review.check_rules(rules, ORDER)


_PARTS_OF = {"schema_id": ("s", 13), "header": ("h", 2), "field_name": ("f", 3), "value": ("v", 5), "canonical": ("c", 7), "date_order": ("day_first", 4), "targets_rule_id": ("t", 6)}


@query(
    f"WITH r AS (SELECT event_id AS rule_id, {_picked(_KIND_OF, 'user_id')} AS kind, " + ", ".join(f"event_id % {m} <> 0 AS {n}" for n, (_, m) in _PARTS_OF.items()) + " FROM events) "
    """SELECT rule_id, CASE WHEN NOT schema_id THEN 'no schema' ELSE CASE kind WHEN 'HEADER_ALIAS' THEN CASE WHEN NOT header OR NOT field_name THEN 'needs header and field' END
 WHEN 'VALUE_ALIAS' THEN CASE WHEN NOT (field_name AND value AND canonical) THEN 'needs field, value and canonical value' END WHEN 'COLUMN_IGNORE' THEN CASE WHEN NOT header THEN 'needs header' END
 WHEN 'OVERRIDE' THEN CASE WHEN NOT targets_rule_id THEN 'needs the rule it disables' END ELSE CASE WHEN NOT date_order THEN 'needs a reading' WHEN NOT header AND NOT field_name THEN 'needs column or field' END END END AS lacks FROM r"""
)
def rule_shape_check_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [F.when(F.col("event_id") % m != 0, F.lit(v)).otherwise(F.lit("" if m % 2 else None).cast("string")).alias(n) for n, (v, m) in _PARTS_OF.items()]
    return e.select(F.col("event_id").alias("rule_id"), _pick(_KIND_OF, F.col("user_id")).alias("kind"), *parts).select("rule_id", rulebook.shape_error().alias("lacks"))


@query("SELECT c_custkey, left(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', '', 'g'), 120) AS header, c_name AS canonical, left(repeat(c_name, 20), 240) AS rationale FROM customer")
def rule_normalise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    padded = F.concat(F.lit("  "), "c_name", F.lit(" "))
    rules = c.select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("header"), padded.alias("canonical"), F.repeat("c_name", F.lit(20)).alias("rationale"))
    return rulebook.normalise_rules(rules)


@query("WITH s AS (SELECT DISTINCT user_id, user_id % 3 + 1 AS version, 'first' AS body FROM events), c AS (SELECT e.user_id, arg_min(event_type, event_id) AS body FROM events e WHERE event_id % 3 = e.user_id % 3 GROUP BY 1) SELECT s.user_id, CAST(s.version + CASE WHEN c.user_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version, coalesce(c.body, s.body) AS body FROM s LEFT JOIN c USING (user_id)")
def rule_version_lock(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.select("user_id", (F.col("user_id") % 3 + 1).cast("long").alias("version"), F.lit("first").alias("body")).distinct()
    changes = e.select("user_id", (F.col("event_id") % 3 + 1).alias("expected"), F.col("event_type").alias("body"), F.col("event_id").alias("pos"))
    return rulebook.update_versions(stored, changes, "user_id", "body")


@query("SELECT user_id AS owner, event_type AS targets_rule_id, 's' AS schema_id, arg_max(event_id % 3 = 0, (event_id % 2, event_id)) AS enabled FROM events GROUP BY 1, 2")
def rule_override_toggle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("targets_rule_id"), F.lit("s").alias("schema_id"), (F.col("event_id") % 3 == 0).alias("enabled"), F.col("event_id").alias("pos"))
    return rulebook.toggle_overrides(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"))


_SAMPLES = _CELLS + ", f AS (SELECT column_id, t AS sample, min(ord) AS o FROM cells WHERE t <> '' GROUP BY 1, 2), r AS (SELECT column_id, row_number() OVER (PARTITION BY column_id ORDER BY o, sample) AS position, sample FROM f), s AS (SELECT column_id, sample FROM r WHERE position <= 5)"


def _own_targets(spark):
    return spark.createDataFrame([(c, c) for c in _PROFILED], "column_id string, target string")


@query(_SAMPLES + " SELECT column_id, sample AS before, 'low' AS after FROM s WHERE column_id = 'tier' AND regexp_replace(lower(sample), '[^a-z0-9]+', '', 'g') = 'notspecified'")
def rule_preview_value(spark, sf_dir):
    return rulebook.preview_value(profile.profile_samples(_cells(spark, sf_dir)), _own_targets(spark), "tier", "notspecified", "low")


@query(duck("li_dates") + f" SELECT DISTINCT 'c' || l_linenumber AS column_id, raw AS before, {_D['dm']} AS after FROM li_dates WHERE l_linenumber <= 3 AND {_D['status']} = 'ambiguous'")
def rule_preview_date(spark, sf_dir):
    samples = view(spark, sf_dir, "li_dates").select(F.concat(F.lit("c"), "l_linenumber").alias("column_id"), F.col("raw").alias("sample")).distinct()
    mapped = spark.createDataFrame([(f"c{i}", "placedDate" if i <= 3 else "tier") for i in range(1, 8)], "column_id string, target string")
    return rulebook.preview_dates(samples, mapped, "placedDate", "day_first")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'signup') AND event_id % 4 NOT IN (1, 2) AND event_id % 5 <> 0")
def decisions_that_generalise(spark, sf_dir):
    n = F.col("event_id")
    action = F.when(n % 4 == 1, F.lit("reject")).when(n % 4 == 2, F.lit("exclude")).otherwise(F.lit("map"))
    kinds = {"click": "COMPETING_COLUMNS", "view": "AMBIGUOUS_DATE", "signup": "UNSAFE_CLEANUP", "error": "VALIDATION_FAILED_TWICE", "purchase": "IDENTITY_CONFLICT"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    d = table(spark, sf_dir, "events").select("event_id", kind.alias("type"), action.alias("action"), F.when(n % 5 == 0, F.lit(" Date ")).otherwise(F.lit("Warehouse")).alias("header"))
    return rulebook.generalisable(d, ORDER).select("event_id")


@query("SELECT 'rule_' || user_id % 40 AS rule_id, CAST(count(*) + CASE WHEN user_id % 40 < 10 THEN 100 ELSE 0 END AS BIGINT) AS hits FROM events GROUP BY user_id % 40")
def rule_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("rule_"), F.col("user_id") % 40).alias("rule_id"))
    before = spark.createDataFrame([(f"rule_{i}", 100) for i in range(10)], "rule_id string, hits long")
    return review.rule_hits(e, before)


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def accept_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return rulebook.accept_new(e, e.filter("event_type = 'view'"), ("event_type", "user_id"), "event_id")
