"""Queries of stored rules under change, streamed receipts, payloads of whole texts, and contracts made from the tables' own schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import ORDER, Contract, Field, infer_contract, parse_spec, to_yaml
from ..functions import text
from ..operators import deliver, mapping, profile, review, rulebook, validate, versions, views
from ..storage import shared_dir
from .base import query, table
from .catalog import NAMES, SOURCES, TRADE, columns, duck, source_cells, view, values
from .mapping_queries import _ALL, _COLS, _DECIDE, _NORM
from .scalar_queries import _D

# --- stored rules under a batch of changes: one rule a user, every event a change ---
_ACTION = "CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' ELSE 'update' END"
_CHANGES = f"""e AS (SELECT event_id AS pos, {_ACTION} AS action, CASE WHEN event_type = 'signup' THEN 'n' || event_id ELSE 'u' || user_id END AS key, 'o' || user_id % 7 AS owner, event_id % 4 + 1 AS expected, event_type || event_id AS body FROM events),
s AS (SELECT DISTINCT 'u' || user_id AS key, 'o' || user_id % 7 AS owner, user_id % 3 + 1 AS version FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM e WHERE action <> 'insert'),
r AS (SELECT key, owner, CAST(0 AS BIGINT) AS i, CAST(version AS BIGINT) AS version, 'first' AS body, TRUE AS lives, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS outcome FROM s
 UNION ALL SELECT r.key, r.owner, c.i, CASE WHEN lives AND action = 'update' AND expected = version THEN version + 1 ELSE version END, CASE WHEN lives AND action = 'update' AND expected = version THEN c.body ELSE r.body END, lives AND action <> 'delete', c.pos,
 CASE WHEN NOT lives THEN 'missing' WHEN action = 'delete' OR expected = version THEN 'done' ELSE 'stale' END FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1)"""


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    stored = e.selectExpr("concat('u', user_id) AS key", "concat('o', user_id % 7) AS owner", "user_id % 3 + 1 AS version", "'first' AS body").distinct()
    changes = e.selectExpr("event_id AS pos", f"{_ACTION} AS action", "CASE WHEN event_type = 'signup' THEN concat('n', event_id) ELSE concat('u', user_id) END AS key", "concat('o', user_id % 7) AS owner", "event_id % 4 + 1 AS expected", "concat(event_type, event_id) AS body")
    return versions.apply_changes(stored, changes, cap=1_000_000)


@query(f"WITH RECURSIVE {_CHANGES} SELECT key, arg_max(owner, i) AS owner, arg_max(version, i) AS version, arg_max(body, i) AS body FROM r GROUP BY key HAVING arg_max(lives, i) UNION ALL SELECT key, owner, 1, body FROM e WHERE action = 'insert'")
def rule_changes(spark, sf_dir):
    return _changed(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_CHANGES} SELECT pos, outcome FROM r WHERE pos IS NOT NULL UNION ALL SELECT pos, 'done' FROM e WHERE action = 'insert'")
def rule_change_outcomes(spark, sf_dir):
    return _changed(spark, sf_dir)[1]


# --- receipts of a stream ---
@query("WITH f AS (SELECT user_id, min(event_id) AS p, arg_min(event_type, event_id) AS h FROM events GROUP BY 1) SELECT event_id AS pos, 'k' || user_id AS key, CASE WHEN event_id = p THEN 'stored' WHEN event_type = h THEN 'replay' ELSE 'conflict' END AS result FROM events JOIN f USING (user_id)")
def streamed_receipts(spark, sf_dir):
    from ..streaming.receipts import receipts_of, run_receipts

    folder, sent = shared_dir(spark, "receipts"), shared_dir(spark, "deliveries")
    table(spark, sf_dir, "events").select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_type").alias("payload_hash"), F.col("event_id").alias("pos")).write.parquet(sent)
    run_receipts(spark.readStream.schema("key string, payload_hash string, pos long").parquet(sent), f"{folder}/out", f"{folder}/state").awaitTermination()
    return receipts_of(spark, f"{folder}/out").select("pos", "key", "result")


# --- payloads of whole texts ---
NOTE = Contract("Note", (Field("source", "text"), Field("body", "text"), Field("docId", "identifier", required=True, identity=True)))
_CHAR = """CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) = 10 THEN '\\n' WHEN unicode(c) = 13 THEN '\\r' WHEN unicode(c) = 9 THEN '\\t' WHEN unicode(c) = 8 THEN '\\b' WHEN unicode(c) = 12 THEN '\\f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
 WHEN unicode(c) < 65536 THEN '\\u' || printf('%04x', unicode(c)) ELSE '\\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END"""
_BODY = f"array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {_CHAR}), '')"


@query(
    f"""WITH p AS (SELECT doc_id, CASE WHEN source <> '' THEN '"source":"' || source || '"' END AS s, CASE WHEN text <> '' THEN '"body":"' || {_BODY} || '"' END AS b, '"docId":"' || doc_id || '"' AS d FROM documents)
SELECT doc_id, md5('{{' || concat_ws(',', s, b, d) || '}}') AS sent, left(sha256('{{' || concat_ws(',', b, d, s) || '}}'), 32) AS payload_hash FROM p"""
)
def text_payloads(spark, sf_dir):
    """Payloads as they are sent, fields in contract order, and hashed, fields by name; texts beyond ASCII escaped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("body"), F.col("doc_id").cast("string").alias("docId"))
    return d.select("doc_id", F.md5(deliver.payload(NOTE).cast("binary")).alias("sent"), deliver.payload_hash(NOTE).alias("payload_hash"))


# --- contracts from the tables ---
_WORDS = "string_split(header, '_')"


@query(
    f"""{_ALL}, {values('numbered', 'column_id, i', [(n[0], i) for i, n in enumerate(NAMES)])}, h AS (SELECT {_NORM} AS h, arg_min(header, i) AS header, arg_min(kinds[1], i) AS kind FROM cols JOIN numbered USING (column_id) GROUP BY 1)
SELECT lower({_WORDS}[1]) || array_to_string(list_transform({_WORDS}[2:], lambda w: upper(w[1]) || w[2:]), '') AS name, array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || w[2:]), ' ') AS label,
 CASE kind WHEN 'enum' THEN 'text' ELSE kind END AS kind, FALSE AS required FROM h"""
)
def contract_fields(spark, sf_dir):
    """The view of a contract that is inferred from all columns of the tables and what their values show."""
    found = {r["column_id"]: r for r in columns(spark, sf_dir).collect()}  # one row a column
    contract = infer_contract([{"header": found[c]["header"], "kinds": list(found[c]["kinds"])} for c, _, _ in NAMES])
    return views.contract_view(contract, spark).select("name", "label", "kind", "required")


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS tab, column_name AS name, CASE WHEN column_type IN ('DATE', 'TIMESTAMP') THEN 'date' WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' WHEN column_name LIKE '%\\_name' ESCAPE '\\' THEN 'person_name' ELSE 'text' END AS kind, column_name = '{cs[0]}' AS required, column_name = '{cs[0]}' AND column_name LIKE '%\\_id' ESCAPE '\\' AS identity FROM (DESCRIBE {t})" for t, cs in SOURCES.items())
)
def spec_import(spark, sf_dir):
    """Each table's schema as a JSON Schema, read, written as YAML and read again."""
    rows = []
    for t, cs in SOURCES.items():
        props = {f.name: {"type": "string", "format": "date-time"} if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else {"type": "string"} for f in table(spark, sf_dir, t).schema.fields}
        contract = parse_spec(to_yaml(parse_spec(json.dumps({"title": t, "required": [cs[0]], "properties": props}))[0]))[0]
        rows += [(t, f.name, f.kind, f.required, f.identity) for f in contract.fields]
    return spark.createDataFrame(rows, "tab string, name string, kind string, required boolean, identity boolean")


_MOST = values("most", "kind, max_length, format", [("identifier", 64, None), ("person_name", 200, None), ("email", 254, "email"), ("date", None, "date"), ("text", 500, None), ("enum", None, None)])
_DECL = values("decl", "target, kind, required", [(f.name, f.kind, f.required) for f in TRADE.fields])


@query(_DECIDE + f", {_DECL}, {_MOST} SELECT column_id, one AS target, CAST(max_length AS BIGINT) AS max_length, format, required FROM decided JOIN decl ON one = target JOIN most USING (kind) WHERE gate = 'mapped'")
def column_properties(spark, sf_dir):
    """What the JSON Schema of the contract asks of the values of each mapped column."""
    schema = TRADE.json_schema()
    rows = [(n, p.get("maxLength"), p.get("format"), n in schema["required"]) for n, p in schema["properties"].items()]
    asked = spark.createDataFrame(rows, "target string, max_length long, format string, required boolean")
    return mapping.decide(columns(spark, sf_dir), TRADE).filter("gate = 'mapped'").join(F.broadcast(asked), "target").select("column_id", "target", "max_length", "format", "required")


# --- previews ---
@query(f"{_DECIDE} SELECT column_id, CASE WHEN gate = 'mapped' THEN one END AS before, CAST(NULL AS VARCHAR) AS after FROM decided JOIN cols USING (column_id) WHERE {_NORM} = 'nationkey' UNION ALL SELECT column_id, NULL, one FROM decided JOIN cols USING (column_id) WHERE {_NORM} = 'custkey' AND gate = 'contended'")
def rule_preview_ignore(spark, sf_dir):
    """Leaving ``nationkey`` out also ends what it contends for."""
    return mapping.preview_change(columns(spark, sf_dir), TRADE, ignored=spark.createDataFrame([("nationkey",)], "header string"))


@query(f"{_DECIDE} SELECT count(*) AS n, count(*) > 0 AS would_change FROM decided JOIN cols USING (column_id) WHERE {_NORM} = 'nationkey' OR {_NORM} = 'custkey' AND gate = 'contended'")
def rule_would_change(spark, sf_dir):
    return mapping.would_change(rule_preview_ignore(spark, sf_dir))


@query(duck("li_dates") + f" SELECT DISTINCT 'c' || l_linenumber AS column_id, raw AS before, {_D['md']} AS after FROM li_dates WHERE l_linenumber % 2 = 0 AND {_D['status']} = 'ambiguous'")
def rule_preview_date_header(spark, sf_dir):
    """A reading taught for one header alone."""
    samples = view(spark, sf_dir, "li_dates").select(F.concat(F.lit("c"), "l_linenumber").alias("column_id"), F.col("raw").alias("sample")).distinct()
    mapped = spark.createDataFrame([(f"c{i}", "placedDate", "Shipped On" if i % 2 == 0 else "Other") for i in range(1, 8)], "column_id string, target string, header string")
    return rulebook.preview_dates(samples, mapped, None, "month_first", "shippedon")


# --- repairs that were learned, fields that no contract has ---
_ORDER = "CASE WHEN l_partkey % 2 = 0 THEN {dm} ELSE {md} END".format(**_D)


def _line_records(spark, sf_dir):
    made = {"orderRef": F.concat_ws("-", F.lit("L"), "l_orderkey", "l_linenumber"), "customerEmail": F.lit("a@example.com"), "placedDate": F.col("raw"), "shippedDate": F.lit(None).cast("string"), "tier": F.lit("low")}
    return view(spark, sf_dir, "li_dates").select("l_orderkey", "l_linenumber", "l_partkey", F.col("raw").alias("given"), *[c.alias(n) for n, c in made.items()])


@query(
    duck("li_dates") + f""", d AS (SELECT l_orderkey, l_linenumber, raw, {_D['status']} AS status, coalesce({_D['value']}, CASE WHEN {_D['status']} = 'ambiguous' THEN {_ORDER} END) AS value FROM li_dates)
SELECT l_orderkey, l_linenumber, value, CASE WHEN value = raw THEN NULL WHEN status = 'ambiguous' THEN 'normalize_date_learned' ELSE 'normalize_date' END AS rule FROM d"""
)
def repair_learned_dates(spark, sf_dir):
    order = F.when(F.col("l_partkey") % 2 == 0, F.lit("day_first")).otherwise(F.lit("month_first"))
    done = validate.two_pass(_line_records(spark, sf_dir), ORDER, orders={"placedDate": order})
    return done.select("l_orderkey", "l_linenumber", F.col("placedDate").alias("value"), F.get("repairs", F.lit(0))["rule"].alias("rule"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['tier'] WHEN event_id % 3 = 1 THEN ['colour', 'tier'] ELSE ['colour', 'size'] END AS names FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ready' ELSE 'needs_review' END AS disposition, CASE event_id % 3 WHEN 1 THEN 'Additional properties are not allowed (''colour'' was unexpected) is not part of the target schema.' WHEN 2 THEN 'Additional properties are not allowed (''colour'', ''size'' were unexpected) is not part of the target schema.' END AS message FROM e"""
)
def unknown_field_errors(spark, sf_dir):
    n = F.col("event_id")
    one = F.lit("x")
    extra = F.when(n % 3 == 0, F.create_map(F.lit("tier"), one)).when(n % 3 == 1, F.create_map(F.lit("tier"), one, F.lit("colour"), one)).otherwise(F.create_map(F.lit("size"), one, F.lit("colour"), one))
    made = {"orderRef": F.concat(F.lit("E-"), n.cast("string")), "customerEmail": F.lit("a@example.com"), "placedDate": F.lit("2024-01-01"), "shippedDate": F.lit(None).cast("string"), "tier": F.lit("low")}
    records = table(spark, sf_dir, "events").select(n, extra.alias("extra"), *[c.alias(k) for k, c in made.items()])
    return validate.two_pass(records, ORDER, extra=F.col("extra")).select("event_id", "disposition", F.get("errors", F.lit(0))["message"].alias("message"))


# --- small views ---
@query("SELECT event_id, '***' AS token, event_type AS plain FROM events")
def masked_details(spark, sf_dir):
    m = F.create_map(F.lit("api_Token"), F.col("user_id").cast("string"), F.lit("plain"), F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", text.mask_secrets(m).alias("m"))
    return e.select("event_id", F.col("m")["api_Token"].alias("token"), F.col("m")["plain"].alias("plain"))


@query("SELECT DISTINCT user_id, 'user:' || left(sha256(encode('issuer') || '\\x00'::BLOB || encode(CAST(user_id AS VARCHAR))), 32) AS owner FROM events")
def owner_pseudonyms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", text.owner_pseudonym(F.lit("issuer"), F.col("user_id").cast("string")).alias("owner")).distinct()


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_rows(spark, sf_dir):
    return review.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id AS exchange_id, CASE WHEN event_id % 2 = 0 THEN 'propose' ELSE 'induce' END AS purpose, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 'ask ' || event_id END AS request FROM events")
def model_exchanges(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        n.alias("exchange_id"), F.col("user_id").alias("run_id"), F.when(n % 2 == 0, F.lit("propose")).otherwise(F.lit("induce")).alias("purpose"), F.col("event_type").alias("status"), F.col("ts").alias("at"),
        F.concat(F.lit("ask "), n.cast("string")).alias("request"), F.lit("answer").alias("response"),
    )
    whole, short = views.exchange_view(rows.filter("exchange_id % 2 = 0"), detail=True), views.exchange_view(rows.filter("exchange_id % 2 = 1"))
    return whole.drop("response").unionByName(short.withColumn("request", F.lit(None).cast("string"))).select("exchange_id", "purpose", "status", "request")


@query(f"""WITH cells AS (SELECT CAST(o_custkey AS VARCHAR) AS buyer, o_orderstatus AS state FROM orders) SELECT CAST(1 AS INTEGER) AS place, 'ref' AS name, (SELECT count(*) FROM orders) AS filled UNION ALL SELECT 2, 'buyer', (SELECT count(*) FROM cells WHERE buyer <> '') UNION ALL SELECT 3, 'state', (SELECT count(*) FROM cells WHERE state <> 'O')""")
def record_columns(spark, sf_dir):
    """Columns of a table of records as a reader sees them, the identity in front, with how many values each has."""
    contract = Contract("Sale", (Field("buyer"), Field("ref", "identifier", identity=True), Field("state")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("buyer"), F.col("o_orderkey").cast("string").alias("ref"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("state"))
    names = views.identity_first(contract)
    counted = rows.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "filled")
    places = F.array(*map(F.lit, names))
    return counted.select(F.array_position(places, F.col("name")).cast("int").alias("place"), "name", "filled")


@query(f"{_COLS}, firsts AS (SELECT column_id, min(t) AS sample, count(DISTINCT t) AS n FROM cells WHERE t <> '' GROUP BY 1) SELECT column_id, sample, CAST(n AS BIGINT) AS n FROM firsts")
def column_first_samples(spark, sf_dir):
    """The first sample of every column of the tables, and how many values it has."""
    cells = source_cells(spark, sf_dir)
    first = profile.profile_samples(cells, 1).select("column_id", "sample")
    return first.join(profile.profile_columns(cells).select("column_id", F.col("distinct_count").alias("n")), "column_id")


_FULL = values("full_", "place, target, kind, required, allowed", [(i + 3, f.name, f.kind, f.required, ", ".join(f'"{v}"' for v in f.values)) for i, f in enumerate(TRADE.fields)])


@query(
    _DECIDE + f""", {_FULL}, taken AS (SELECT DISTINCT one AS target FROM decided WHERE gate = 'mapped') SELECT 0 AS place, 'Target schema: "{TRADE.name}"' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'Permitted target fields:'
 UNION ALL SELECT place, '- ' || target || ' (' || CASE WHEN required THEN 'required' ELSE 'optional' END || ', ' || kind || ')' || CASE WHEN allowed <> '' THEN ' Allowed values: ' || allowed || '.' ELSE '' END FROM full_ WHERE target NOT IN (SELECT target FROM taken)
 UNION ALL SELECT 1000, '' UNION ALL SELECT 1001, 'Already supplied by another column, so not available: ' || (SELECT string_agg(target, ', ' ORDER BY target) FROM taken) || '.'"""
)
def schema_description(spark, sf_dir):
    """What a prompt says of the contract once the tables' columns are mapped."""
    taken = mapping.decide(columns(spark, sf_dir), TRADE).filter("gate = 'mapped'").select("target").distinct()
    return deliver.describe_schema(TRADE, taken)
