"""Queries of the mapping step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contract import COMPATIBLE, EMPLOYEE, ORDER, VOCABULARY
from ..functions import shapes
from ..functions.text import normalize_header
from ..operators import mapping
from .base import query, table
from .catalog import CELLS_SQL, NAMES, TRADE, columns, values
from .profile_queries import KINDS_SQL

# --- mapping ---
def spell_sql(contract) -> str:
    """spell(spelling, target, kind), derived in SQL from the declared names, labels, aliases and the vocabulary alone."""
    norm = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    cut = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    fields = values("fields", "name, kind, label, aliases", [(f.name, f.kind, f.label, list(f.aliases)) for f in contract.fields])
    return rf"""spell AS (WITH RECURSIVE {fields}, {values("voc", "word, others", [(w, list(o)) for w, o in VOCABULARY.items()])},
 own AS (SELECT *, {cut(r"regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')")} AS ws FROM fields),
 titled AS (SELECT *, CASE WHEN label <> '' THEN label ELSE upper(left(array_to_string(ws, ' '), 1)) || substr(array_to_string(ws, ' '), 2) END AS title FROM own),
 w AS (SELECT name, kind, aliases, title, CASE WHEN len(ws) > 1 OR len({cut("title")}) = 0 THEN ws ELSE {cut("title")} END AS ws FROM titled),
 alt AS (SELECT word, word AS other FROM (SELECT unnest(ws) AS word FROM w) UNION SELECT word, unnest(others) FROM voc),
 p AS (SELECT name, kind, ws, 0 AS i, '' AS made FROM w UNION ALL SELECT name, kind, ws, i + 1, made || other FROM p JOIN alt ON word = ws[i + 1] WHERE i < len(ws)),
 long AS (SELECT made AS spelling, name, kind FROM p WHERE i = len(ws) UNION SELECT {norm("name")}, name, kind FROM w UNION SELECT {norm("title")}, name, kind FROM w UNION SELECT ws[-1], name, kind FROM w WHERE len(ws) > 1)
 SELECT spelling, name AS target, kind FROM long WHERE length(spelling) >= 3 UNION SELECT {norm("a")}, name, kind FROM (SELECT unnest(aliases) AS a, name, kind FROM w) WHERE {norm("a")} <> '')"""


_SPELL = spell_sql(ORDER)
_TAKES = values("takes", "kind, allowed", [(k, list(v)) for k, v in COMPATIBLE.items()])
_DECLARED = values("declared", "target, kind, required", [(f.name, f.kind, f.required) for f in ORDER.fields])
#: The sources' columns with their kinds, and what the trade contract spells.
_ALL = f"WITH {CELLS_SQL.replace(' AS v FROM', ' AS t FROM')}, {KINDS_SQL}, {values('named', 'column_id, file_id, header', NAMES)}, cols AS (SELECT column_id, file_id, header, kinds FROM named JOIN kinds USING (column_id))"
_COLS = _ALL + ", " + spell_sql(TRADE) + ", " + _TAKES
_NORM = "regexp_replace(lower(header), '[^a-z0-9]+', '', 'g')"
_TRADE = values("fields", "target, label, kind, required, place", [(f.name, f.title, f.kind, f.required, i) for i, f in enumerate(TRADE.fields)])
_CAND = f"{_COLS}, cand AS (SELECT column_id, file_id, target, spelling AS h, CASE WHEN spelling = lower(target) THEN 'exact' ELSE 'alias' END AS basis, len(kinds) = 0 OR list_has_any(kinds, allowed) AS viable FROM cols JOIN spell ON spelling = regexp_replace(lower(header), '[^a-z0-9]+', '', 'g') JOIN takes USING (kind))"
_DECIDE = _CAND + """, shared AS (SELECT spelling AS h FROM spell GROUP BY 1 HAVING count(*) > 1), agg AS (SELECT column_id, count(*) AS n, count(*) FILTER (WHERE viable) AS v, min(CASE WHEN viable THEN target END) AS one FROM cand GROUP BY 1),
 r AS (SELECT c.column_id, c.file_id, a.n, a.v, a.one, s.h IS NOT NULL AS shared, CASE WHEN v = 1 AND s.h IS NULL THEN one END AS lone FROM cols c LEFT JOIN agg a USING (column_id) LEFT JOIN shared s ON s.h = regexp_replace(lower(header), '[^a-z0-9]+', '', 'g')),
 q AS (SELECT *, count(lone) OVER (PARTITION BY file_id, lone) AS rivals FROM r),
 decided AS (SELECT column_id, file_id, one, CASE WHEN shared THEN 'shared_header' WHEN lone IS NOT NULL AND rivals > 1 THEN 'contended' WHEN v = 1 THEN 'mapped' WHEN v > 1 THEN 'several' WHEN n > 0 THEN 'mismatch' ELSE 'unknown' END AS gate FROM q)"""


@query(_COLS + f" SELECT column_id, string_agg(target, ',' ORDER BY target) AS targets, count(*) > 1 AS ambiguous FROM cols JOIN spell ON spelling = {_NORM} GROUP BY 1")
def spelling_index(spark, sf_dir):
    """Which fields of the contract each column's header names."""
    found = mapping.spelling_index(spark, TRADE)
    return columns(spark, sf_dir).join(found, normalize_header(F.col("header")) == F.col("spelling")).select("column_id", F.array_join("targets", ",").alias("targets"), "ambiguous")


@query(f"{_ALL}, {spell_sql(EMPLOYEE)}, i AS (SELECT spelling, string_agg(target, ',' ORDER BY target) AS targets, count(*) > 1 AS ambiguous FROM spell GROUP BY 1) SELECT spelling, targets, ambiguous, column_id FROM i LEFT JOIN cols ON spelling = {_NORM}")
def spelling_index_employee(spark, sf_dir):
    """Every spelling of the contract, with the columns whose header it is (null: none)."""
    found = mapping.spelling_index(spark, EMPLOYEE)
    named = columns(spark, sf_dir).select("column_id", normalize_header(F.col("header")).alias("h"))
    return found.join(named, F.col("spelling") == F.col("h"), "left").select("spelling", F.array_join("targets", ",").alias("targets"), "ambiguous", "column_id")


@query(_ALL + " SELECT column_id, file_id, header, array_to_string(kinds, ',') AS kinds FROM cols")
def column_kinds(spark, sf_dir):
    """Columns joined with their profiles."""
    return columns(spark, sf_dir).select("column_id", "file_id", "header", F.array_join("kinds", ",").alias("kinds"))


@query(f"{_ALL}, {_TAKES} SELECT column_id, kind AS target, len(kinds) = 0 OR list_has_any(kinds, allowed) AS compatible FROM cols, takes")
def kinds_compatible_matrix(spark, sf_dir):
    """Every column against every kind of field."""
    kinds = spark.createDataFrame([(k,) for k in COMPATIBLE], "target string")
    return columns(spark, sf_dir).crossJoin(F.broadcast(kinds)).select("column_id", "target", shapes.kinds_compatible(F.col("target"), F.col("kinds")).alias("compatible"))  # six kinds


@query(_CAND + " SELECT column_id, target, basis, viable FROM cand")
def candidates(spark, sf_dir):
    return mapping.candidates(columns(spark, sf_dir), TRADE).select("column_id", "target", "basis", "viable")


@query(_DECIDE + " SELECT column_id, CASE WHEN gate = 'mapped' THEN one END AS target, CASE WHEN gate = 'mapped' THEN 'AUTO_MAPPED' ELSE 'ESCALATED' END AS outcome, gate FROM decided")
def mapping_gates(spark, sf_dir):
    return mapping.decide(columns(spark, sf_dir), TRADE).select("column_id", "target", "outcome", "gate")


@query(_DECIDE + " SELECT file_id, one AS target, count(*) AS n FROM decided WHERE gate = 'contended' GROUP BY 1, 2")
def contention(spark, sf_dir):
    cols = columns(spark, sf_dir)
    named = mapping.candidates(cols, TRADE).filter("viable").groupBy("column_id").agg(F.min("target").alias("target"))
    return mapping.decide(cols, TRADE).filter("gate = 'contended'").drop("target").join(named, "column_id").groupBy("file_id", "target").agg(F.count(F.lit(1)).alias("n"))


def decided_without_unknown(spark, sf_dir):
    """Columns, decisions and candidates once a reviewer has left out the columns that nothing places, and all called name."""
    cols = columns(spark, sf_dir)
    ignored = mapping.decide(cols, TRADE).filter("gate = 'unknown'").join(cols.select("column_id", "header"), "column_id").select(normalize_header(F.col("header")).alias("header")).union(spark.createDataFrame([("name",)], "header string")).distinct()
    return cols, mapping.decide(cols, TRADE, ignored=ignored), mapping.candidates(cols, TRADE, ignored=ignored)


#: A required field is missing if no column but those left out supplies or offers it.
_MISSING = _DECIDE + f""", {_TRADE}, left_out AS (SELECT column_id FROM decided JOIN cols USING (column_id) WHERE gate = 'unknown' OR header = 'name'),
 there AS (SELECT one AS target FROM decided WHERE gate = 'mapped' UNION SELECT target FROM cand JOIN decided USING (column_id) WHERE gate IN ('contended', 'mismatch', 'shared_header') AND column_id NOT IN (SELECT column_id FROM left_out)),
 missing AS (SELECT * FROM fields WHERE required AND target NOT IN (SELECT target FROM there))"""


@query(_MISSING + " SELECT target FROM missing")
def required_missing(spark, sf_dir):
    _, decisions, found = decided_without_unknown(spark, sf_dir)
    return mapping.required_missing(decisions, found, TRADE)


@query(f"{_COLS} SELECT column_id, CAST(NULL AS VARCHAR) AS before, 'orderStatus' AS after FROM cols, takes WHERE {_NORM} = 'eventtype' AND takes.kind = 'enum' AND list_has_any(kinds, allowed)")
def rule_preview_header(spark, sf_dir):
    return mapping.preview_change(columns(spark, sf_dir), TRADE, spark.createDataFrame([("eventtype", "orderStatus")], "header string, field_name string"))


@query("WITH d AS (SELECT user_id AS column_id, event_type AS target, event_id AS pos, CASE WHEN event_type = 'error' THEN 'ESCALATED' ELSE 'AUTO_MAPPED' END AS outcome FROM events) SELECT column_id, arg_max(target, pos) AS target, max(pos) AS pos FROM d WHERE outcome = 'AUTO_MAPPED' GROUP BY 1")
def effective_mappings(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("column_id"), F.col("event_type").alias("target"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", F.lit("ESCALATED")).otherwise(F.lit("AUTO_MAPPED")).alias("outcome"))
    return mapping.effective(d).select("column_id", "target", "pos")


_ASKED = ("orderKey", "orderStatus", "shippedOn", "buyerKey", "nothing")


@query(
    f"""{_COLS}, {_TRADE}, {values('asked', 'target, turn', [(t, i) for i, t in enumerate(_ASKED)])}, p AS (SELECT row_number() OVER (ORDER BY turn, c.column_id) AS pos, CASE WHEN c.column_id LIKE '%:c2' THEN c.column_id || '?' ELSE c.column_id END AS column_id, target FROM cols c, asked),
 r AS (SELECT p.pos, p.target, CASE WHEN c.column_id IS NULL THEN 'unknown column' WHEN d.kind IS NULL THEN 'unknown field' WHEN p.target = 'orderKey' THEN 'already taken'
 WHEN len(c.kinds) > 0 AND NOT list_has_any(c.kinds, allowed) THEN 'kinds disagree' END AS why FROM p LEFT JOIN cols c USING (column_id) LEFT JOIN fields d ON p.target = d.target LEFT JOIN takes t ON d.kind = t.kind),
 first AS (SELECT target, min(pos) AS pos FROM r WHERE why IS NULL GROUP BY 1), e AS (SELECT r.pos, coalesce(why, CASE WHEN first.pos < r.pos THEN 'already taken' END) AS reason FROM r LEFT JOIN first USING (target))
 SELECT pos, reason IS NULL AS accepted, reason FROM e"""
)
def proposal_verification(spark, sf_dir):
    """Every column proposed for some fields in turn; every third is named wrongly."""
    cols = columns(spark, sf_dir)
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(_ASKED)], "target string, turn int")
    p = cols.select("column_id").crossJoin(F.broadcast(asked)).withColumn("pos", F.row_number().over(Window.orderBy("turn", "column_id")).cast("long"))  # metadata: some rows a column
    p = p.withColumn("column_id", F.when(F.endswith("column_id", F.lit(":c2")), F.concat("column_id", F.lit("?"))).otherwise(F.col("column_id")))
    return mapping.accept_proposals(p, cols, TRADE, ["orderKey"]).select("pos", "accepted", "reason")
