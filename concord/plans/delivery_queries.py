"""Queries of delivery, admission, audit, sources and contracts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..contract import ORDER, infer_contract
from ..functions import dates, text
from ..operators import admission, deliver, profile, review
from ..sources.csv_ranges import scan_csv
from ..sources.files import Limits, over_limits
from ..storage import shared_dir
from .base import query, table
from .merge_queries import _CANON, _VALID, validated
from .profile_queries import _PROFILED, _cells

# --- delivery, admission, audit ---
_JSON = "'{{' || concat_ws(',', {}) || '}}'".format(", ".join(f"CASE WHEN \"{n}\" <> '' THEN '\"{n}\":\"' || replace(\"{n}\", '/', '/') || '\"' END" for n in sorted(_CANON)))
_KEYS = _VALID + f", paid AS (SELECT id, left(sha256({_JSON}), 32) AS payload_hash, left(sha256('run-1:' || id || ':1'), 32) AS idempotency_key FROM valid WHERE e2 = '')"


def _ready(spark, sf_dir):
    v = validated(spark, sf_dir).filter("disposition = 'ready'")
    return v.select("id", deliver.payload_hash(ORDER).alias("payload_hash"), deliver.idempotency_key(F.lit("run-1"), F.col("id"), F.lit(1)).alias("idempotency_key"))


@query(_KEYS + " SELECT * FROM paid")
def payload_keys(spark, sf_dir):
    return _ready(spark, sf_dir)


_OUT = "CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN a = 1 THEN 503 ELSE 201 END WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 422 ELSE 200 END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'succeeded' WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'succeeded' END AS state, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN o_orderkey % 11 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts FROM orders")
def delivery_rounds(spark, sf_dir):
    k = F.col("o_orderkey")
    answer = lambda i: F.when(k % 10 == 0, F.lit(503 if i == 1 else 201)).when(k % 11 == 0, F.lit(None).cast("int")).when(k % 13 == 0, F.lit(422)).otherwise(F.lit(200))
    return deliver.deliver(table(spark, sf_dir, "orders").select("o_orderkey"), answer).select("o_orderkey", "state", F.col("attempts").cast("long").alias("attempts"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE o_orderkey % 11 = 0) > 0 THEN 'complete_with_failures' ELSE 'complete' END AS phase FROM orders")
def final_phase(spark, sf_dir):
    return deliver.final_phase(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, F.lit("failed")).otherwise(F.lit("succeeded")).alias("state")))


@query("WITH i AS (SELECT 'k' || user_id AS key, event_type AS payload_hash, event_id AS pos FROM events), h AS (SELECT 'k' || user_id AS key, 'click' AS payload_hash FROM events WHERE user_id % 3 = 0 GROUP BY user_id), f AS (SELECT key, arg_min(payload_hash, pos) AS ph, min(pos) AS p FROM i GROUP BY 1) SELECT i.pos, CASE WHEN h.key IS NULL AND i.pos = f.p THEN 'stored' WHEN i.payload_hash = coalesce(h.payload_hash, f.ph) THEN 'replay' ELSE 'conflict' END AS result FROM i JOIN f USING (key) LEFT JOIN h USING (key)")
def receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    incoming = e.select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_type").alias("payload_hash"), F.col("event_id").alias("pos"))
    held = e.filter("user_id % 3 = 0").select(F.concat(F.lit("k"), "user_id").alias("key"), F.lit("click").alias("payload_hash")).distinct()
    return deliver.store_receipts(held, incoming).select("pos", "result")


@query("SELECT event_id, CAST(sum(1 + event_id % 3) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, sum(1 + event_id % 3) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 40 AS admitted FROM events")
def budget_admission(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", dates.utc_day_key(F.col("ts"))).withColumn("n", 1 + F.col("event_id") % 3)
    return admission.admit_budget(e, "day", ["ts", "event_id"], "n", 40, F.date_trunc("hour", "ts")).select("event_id", "used", "admitted")


@query("WITH e AS (SELECT user_id % 20 AS owner, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, event_id // 2 AS run, min((ts, event_id)) AS first_at FROM events GROUP BY 1, 2, 3) SELECT owner, day, run, row_number() OVER (PARTITION BY owner, day ORDER BY first_at, run) <= 2 AS admitted FROM e")
def quota_admission(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("owner"), dates.local_day(F.col("ts")).cast("string").alias("day"), F.floor(F.col("event_id") / 2).alias("run"), "ts", "event_id")
    return admission.admit_starts(e, "owner", "day", "run", ["ts", "event_id"], 2).select("owner", "day", "run", "admitted")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, max(t - i * 86400000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 86400000 AS slot FROM e")
def rate_spacing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))
    return admission.space_out(e, "user_id", "t", ["ts", "event_id"], 86_400_000, F.to_date("ts")).select("event_id", "slot")


#: Milliseconds between two slots of a lane, and the longest wait.
_GAP, _BOUND = 900_000, 3_600_000


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 4 AS lane, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, lane, i, t AS slot, t AS last FROM e WHERE i = 1
 UNION ALL SELECT e.event_id, e.lane, e.i, CASE WHEN greatest(t, last + {_GAP}) - t <= {_BOUND} THEN greatest(t, last + {_GAP}) END, CASE WHEN greatest(t, last + {_GAP}) - t <= {_BOUND} THEN greatest(t, last + {_GAP}) ELSE last END
 FROM r JOIN e ON e.lane = r.lane AND e.i = r.i + 1) SELECT event_id, slot FROM r"""
)
def rate_spacing_bounded(spark, sf_dir):
    """One request in four lanes; who would wait an hour for a slot is refused and takes none."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("lane"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return admission.space_out_bounded(e, "lane", "t", ["ts", "event_id"], _GAP, _BOUND, F.to_date("ts")).select("event_id", "slot")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 20 AS owner, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, event_type = 'error' AS free,
 row_number() OVER (PARTITION BY user_id % 20, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, owner, day, i, CASE WHEN free THEN 0 ELSE 1 END AS used, NOT free AS admitted FROM e WHERE i = 1
 UNION ALL SELECT e.event_id, e.owner, e.day, e.i, CASE WHEN free THEN greatest(used - 1, 0) ELSE least(used + 1, 3) END, NOT free AND used < 3 FROM r JOIN e ON e.owner = r.owner AND e.day = r.day AND e.i = r.i + 1)
SELECT event_id, used, admitted FROM r"""
)
def quota_release(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 20).alias("owner"), dates.local_day(F.col("ts")).cast("string").alias("day"))
    return admission.quota_with_release(e, ["owner", "day"], ["ts", "event_id"], F.col("event_type") == "error", 3, F.date_trunc("hour", "ts")).select("event_id", "used", "admitted")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 10 AS seq FROM events")
def audit_events_seq(spark, sf_dir):
    return review.number_events(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 10, F.to_date("ts")).select("event_id", "user_id", "seq")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500")
def events_since(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id > 500").select("event_id", "event_type")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def top_recent_runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 12")
def checkpoint_retention(spark, sf_dir):
    return review.newest(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", [F.desc("event_id")], 12)


@query(_VALID + ", st AS (SELECT CASE WHEN e2 = '' THEN 'ready' ELSE 'needs_review' END AS disposition FROM valid) SELECT count(*) AS records, count(*) FILTER (WHERE disposition = 'ready') AS ready, count(*) FILTER (WHERE disposition = 'needs_review') AS review, (SELECT CAST(sum(n_rows) AS BIGINT) FROM rec) - count(*) AS merged FROM st")
def counters(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("disposition") == "ready").alias("ready"), F.count_if(F.col("disposition") == "needs_review").alias("review"), (F.sum("n_rows") - F.count(F.lit(1))).alias("merged"))


@query()
def scrub_prompt_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_value(F.col("text")).alias("value"), text.safe_header(F.col("source")).alias("header"))


@query("SELECT event_id, user_id, event_type, 'events.csv' AS file, CAST(row_number() OVER (ORDER BY event_id) + 1 AS BIGINT) AS row, event_id % 5 = 0 AS extra FROM events WHERE event_id % 7 <> 0")
def csv_scan(spark, sf_dir):
    """An export with rows of blanks and rows that are too long, written from the events and read by ranges."""
    folder = shared_dir(spark, "csv-export")
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    line = F.when(n % 7 == 0, F.lit(" ,, ")).otherwise(F.concat_ws(",", n.cast("string"), F.col("user_id").cast("string"), "event_type", F.when(n % 5 == 0, F.lit("more"))))
    text = e.select(n, line.alias("value")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("event_id, user_id ,event_type").alias("value")))
    # one file is the point: it is read by ranges. The task that writes it sorts blocks of lines, not lines
    blocks = text.groupBy(F.floor(F.col("event_id") / 4096).alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("of"))
    blocks = blocks.select("block", F.array_join(F.col("of.value"), "\n").alias("value"))
    blocks.coalesce(1).sortWithinPartitions("block").select("value").write.text(folder)
    back = scan_csv(spark, folder, line_breaks_in_quotes=False)
    cell = lambda i: F.get("cells", F.lit(i))
    return back.select(cell(0).cast("long").alias("event_id"), cell(1).cast("long").alias("user_id"), cell(2).alias("event_type"), F.lit("events.csv").alias("file"), "row", F.col("warning").isNotNull().alias("extra"))


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest, source FROM documents")
def csv_quoted_scan(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through an export and back."""
    folder = shared_dir(spark, "csv-export")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    cell = lambda i: F.get("cells", F.lit(i))
    back = scan_csv(spark, folder + "/*.csv").select(cell(0).cast("long").alias("doc_id"), cell(1).alias("text"), cell(2).alias("source"))
    return back.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"), "source")


_LIMITS = Limits(columns=2, rows=3000, cell=20_000)


@query(
    """WITH f AS (SELECT 'source-' || source AS name, count(*) AS n, arg_min(length(text) > 20000, doc_id) AS x, max(length(text)) AS longest FROM documents GROUP BY source)
SELECT name || '.csv' AS file_name, name || '.csv: 3 columns exceeds the limit of 2.' AS error FROM f
UNION ALL SELECT name || '.csv', name || '.csv: ' || n || ' rows exceeds the limit of 3000.' FROM f WHERE n > 3000
UNION ALL SELECT name || '.csv', name || '.csv: a cell in column "text" is too long (limit 20000 characters).' FROM f WHERE longest > 20000
UNION ALL SELECT NULL, 'At most 3 files per migration.' FROM f HAVING count(*) > 3
UNION ALL SELECT NULL, sum(n) || ' rows exceeds the limit of 100.' FROM f HAVING sum(n) > 100"""
)
def import_limits(spark, sf_dir):
    """Limits of files and of the run, over rows as a scan gives them: one file a source."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("source-"), "source", F.lit(".csv")).alias("file_name"), F.col("doc_id").alias("row"), F.array(*map(F.lit, ("doc_id", "text", "lang"))).alias("header"), F.array(F.col("doc_id").cast("string"), "text", "lang").alias("cells"))
    return over_limits(rows, _LIMITS, files=3, total_rows=100)


@query("SELECT * FROM (VALUES ('orderref', 'identifier'), ('customeremail', 'email'), ('placeddate', 'date'), ('shippeddate', 'date'), ('tier', 'identifier')) t(name, kind)")
def infer_schema_fields(spark, sf_dir):
    found = {r["column_id"]: list(r["detected_kinds"]) for r in profile.profile_columns(_cells(spark, sf_dir)).collect()}  # one row for each column
    contract = infer_contract([{"header": c.lower(), "kinds": found[c]} for c in _PROFILED])
    return spark.createDataFrame([(f.name, f.kind) for f in contract.fields], "name string, kind string")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_days(spark, sf_dir):
    """The streaming layer's windowed count, run as a batch."""
    from ..streaming.feed import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")
