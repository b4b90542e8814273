"""What a reader of a run sees: counters, summaries, and the rows and sentences of mappings, records, issues and events.

Each view is a join or an aggregate over the run's tables; counters are one partial aggregate a table. Sentences are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from .issues import field_table

#: Phases and what they are called.
PHASES = {
    "ingested": "Files received", "analyzing": "Working out the mapping", "review": "Waiting for your decision", "ready": "Ready to deliver", "delivering": "Delivering to the destination",
    "complete": "Complete", "complete_with_failures": "Complete, with failures", "blocked": "Blocked",
}
BASES = ("deterministic", "model", "human", "rule", "unknown")


def _n(cond) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def latest_decisions(mappings: DataFrame) -> DataFrame:
    """The last decision (by pos) of each column, by a partial aggregate."""
    rest = [c for c in mappings.columns if c != "column_id"]
    return mappings.filter(F.col("column_id").isNotNull()).groupBy("column_id").agg(F.max_by(F.struct(*rest), "pos").alias("d")).select("column_id", "d.*")


def counters(records: DataFrame, mappings: DataFrame, issues: DataFrame, source_rows: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row. records: disposition, n_repairs; mappings: column_id, pos, outcome, basis; issues: status, blocking; source_rows: n;
    requests: n, what each step has asked the model."""
    state = F.col("disposition")
    r = records.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("n_repairs"), F.lit(0)).cast("long").alias("repairs"),
        *[_n(state == s).alias(n) for n, s in (("delivered", "delivered"), ("failed", "failed"), ("excluded", "excluded"), ("retrying", "retry_wait"))],
    )
    m = latest_decisions(mappings).agg(
        _n(F.col("outcome") == "AUTO_MAPPED").alias("auto_mapped"), _n(F.col("outcome") == "ESCALATED").alias("escalated"),
        _n(F.col("basis").isin("alias", "learned")).alias("rule_hits"), _n(F.col("basis") == "learned").alias("learned_hits"),
    )
    i = issues.agg(_n((F.coalesce("status", F.lit("open")) == "open") & F.coalesce("blocking", F.lit(True))).alias("awaiting_review"))
    n = source_rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("source_rows"))
    merged = F.when(F.col("records") > 0, F.greatest(F.lit(0), F.col("source_rows") - F.col("records"))).otherwise(F.lit(0)).cast("long")
    asked = F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("model_requests")
    n = n.withColumn("model_requests", F.lit(0).cast("long")) if requests is None else n.crossJoin(requests.agg(asked))
    return r.crossJoin(m).crossJoin(i).crossJoin(n).withColumns({"merged": merged, "model_requests_avoided": F.col("learned_hits")})  # four single rows


def mapping_summary(mappings: DataFrame) -> DataFrame:
    """Over all decisions, corrected ones included: auto, escalated, learned."""
    return mappings.agg(_n(F.col("outcome") == "AUTO_MAPPED").alias("auto"), _n(F.col("outcome") == "ESCALATED").alias("escalated"), _n(F.col("basis") == "learned").alias("learned"))


def delivery_summary(intents: DataFrame) -> DataFrame:
    return intents.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def mapping_view(mappings: DataFrame, columns: DataFrame, contract: Contract) -> DataFrame:
    """The last decision by file and header, with the field's label."""
    rows = mappings.join(columns.select("column_id", "header", "file_name"), "column_id", "left")
    rows = rows.withColumns({"column": F.coalesce("header", "column_id"), "file": F.coalesce("file_name", F.lit(""))})
    keep = [c for c in ("target", "outcome", "basis", "decided_by") if c in rows.columns]
    last = rows.groupBy("file", "column").agg(F.max_by(F.struct(*keep), "pos").alias("d")).select("file", "column", "d.*")
    return last.join(F.broadcast(field_table(contract, mappings.sparkSession).select("target", F.col("label").alias("target_label"))), "target", "left")


def last_refusal(attempts: Column) -> Column:
    """The last attempt's words that are not empty, with its HTTP status; attempts: array of (status, detail)."""
    said = F.filter(attempts, lambda a: F.coalesce(a["detail"], F.lit("")) != "")
    last = F.try_element_at(said, F.lit(-1))
    return F.when(F.coalesce(last["status"], F.lit(0)) != 0, F.concat(last["detail"], F.lit(" (HTTP "), last["status"].cast("string"), F.lit(")"))).otherwise(last["detail"])


def record_view(records: DataFrame, deliveries: DataFrame, contract: Contract) -> DataFrame:
    """id, subject, disposition, messages, target_id. A failed record shows the destination's reason in place of its errors.
    deliveries: record_id, target_id, attempts; at most one row a record."""
    d = deliveries.select(F.col("record_id").alias("id"), "target_id", last_refusal(F.col("attempts")).alias("refusal"))
    own = F.transform("errors", lambda e: e["message"])
    refused = F.array(F.coalesce("refusal", F.lit("The destination refused this record.")))
    rows = records.join(d, "id", "left")
    disposition = F.coalesce("disposition", F.lit("candidate"))
    return rows.select("id", subject(contract).alias("subject"), disposition.alias("disposition"), F.when(disposition == "failed", refused).otherwise(own).alias("messages"), "target_id")


def subject(contract: Contract) -> Column:
    """How people name a record: its naming field, else its id."""
    f = contract.naming
    return F.coalesce(F.nullif(F.trim(F.col(f.name)), F.lit("")), F.col("id")) if f else F.col("id")


def issue_view(issues: DataFrame, columns: DataFrame, contract: Contract) -> DataFrame:
    """Issues with the labels of their fields and the headers and files of their columns. issues: issue_id, type, status, reason,
    blocking, field, column_id, record_ids."""
    labels = F.broadcast(field_table(contract, issues.sparkSession).select(F.col("target").alias("field"), F.col("label").alias("field_label")))
    rows = issues.join(labels, "field", "left").join(columns.select("column_id", F.col("header").alias("column"), F.col("file_name").alias("column_file")), "column_id", "left")
    affected = F.coalesce(F.greatest(F.size("record_ids"), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("issue_id", "type", F.coalesce("status", F.lit("open")).alias("status"), "reason", F.coalesce("blocking", F.lit(True)).alias("blocking"), "field", "field_label", affected.alias("affected"), "column", "column_file")


def basis_or_unknown(c: Column) -> Column:
    """The basis an event was recorded with, where it is a known one."""
    return F.when(c.isin(*BASES), c).otherwise(F.lit("unknown"))


def event_view(events: DataFrame, since: int = 0) -> DataFrame:
    """Events after a sequence number; of their detail (a map) only the rule's id and origin."""
    detail = lambda k: F.try_element_at("detail", F.lit(k)).alias(k)
    return events.filter(F.col("seq") > since).select("seq", F.coalesce("actor", F.lit("agent")).alias("actor"), basis_or_unknown(F.col("execution_basis")).alias("execution_basis"), "action", detail("rule_id"), detail("rule_origin"))


def merge_events(held: DataFrame, polled: DataFrame) -> DataFrame:
    """What a client holds after a poll: its own events and those of the poll that it lacks; an older poll adds nothing."""
    return held.unionByName(polled.join(held.select("seq"), "seq", "left_anti"))


def exchange_view(exchanges: DataFrame, detail: bool = False) -> DataFrame:
    """Model exchanges by time; bodies only in the detail."""
    short = ["exchange_id", "run_id", "purpose", "status", "at"]
    return exchanges.select(*short, *(["request", "response"] if detail else []))


def run_view(run: DataFrame, counted: DataFrame, events: DataFrame) -> DataFrame:
    """One row: phase and its label, whether it is active, counters, the headline and the latest sequence number.
    run: run_id, phase, paused, n_files, blocked_reason."""
    latest = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("phase")), F.col("phase"))
    rows = run.crossJoin(counted).crossJoin(latest)  # single rows
    active = F.col("phase").isin("ingested", "analyzing", "ready", "delivering") & ~F.col("paused")
    return rows.withColumns({"phase_label": label, "active": active, "headline": headline(), "reconciled": reconcile_sentence()})


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def headline() -> Column:
    """One sentence from phase and counters."""
    c, phase = F.col, F.col("phase")
    asks = F.when(c("awaiting_review") == 1, F.lit("One question needs your judgment")).otherwise(F.concat(c("awaiting_review").cast("string"), F.lit(" questions need your judgment")))
    return (
        F.when(phase == "blocked", F.coalesce("blocked_reason", F.lit("This migration cannot continue."))).when(c("awaiting_review") > 0, asks)
        .when(phase == "ingested", F.concat(F.lit("Reading "), plural(c("n_files"), "file"))).when(phase == "analyzing", F.lit("Working out which column means what"))
        .when(phase == "review", F.lit("Reviewing what was found")).when(phase == "ready", F.concat(F.lit("Getting ready to send "), plural(c("records"), "record")))
        .when(phase == "delivering", F.concat(F.lit("Sending "), (c("delivered") + 1).cast("string"), F.lit(" of "), plural(c("records") - c("excluded"), "record")))
        .when(phase == "complete", F.concat(plural(c("delivered"), "record"), F.lit(" sent to the destination")))
        .when(phase == "complete_with_failures", F.concat(plural(c("delivered"), "record"), F.lit(" sent, "), (c("failed") + c("excluded")).cast("string"), F.lit(" did not go")))
    )


def reconcile_sentence() -> Column:
    became = F.concat(plural(F.col("source_rows"), "row"), F.lit(" across your files became "), plural(F.col("records"), "record"))
    return F.when(F.col("merged") > 0, F.concat(became, F.lit(" after combining "), plural(F.col("merged"), "duplicate row"), F.lit("."))).otherwise(F.concat(became, F.lit(".")))


def stage_details() -> Column:
    """What each stage of a run says of itself, as a struct; null where it has nothing to say yet."""
    c = F.col
    placed, sent = c("auto_mapped") + c("escalated"), c("delivered") + c("failed")
    parts = F.array_compact(F.array(F.when(c("merged") > 0, F.concat(F.lit("combined "), plural(c("merged"), "duplicate row"))), F.when(c("repairs") > 0, F.concat(F.lit("tidied "), plural(c("repairs"), "value")))))
    tidy = F.array_join(parts, ", ")
    return F.struct(
        F.when(c("source_rows") > 0, F.concat(plural(c("source_rows"), "row"), F.lit(" from "), plural(c("n_files"), "file"))).alias("read"),
        F.when(placed > 0, F.concat(c("auto_mapped").cast("string"), F.lit(" of "), placed.cast("string"), F.lit(" columns matched automatically"))).alias("match"),
        F.when(F.size(parts) > 0, F.concat(F.upper(F.left(tidy, F.lit(1))), F.substring(tidy, 2, 1000))).alias("check"),
        F.when(sent > 0, F.concat(c("delivered").cast("string"), F.lit(" of "), (sent + c("retrying")).cast("string"), F.lit(" sent"))).alias("send"),
        F.when(c("phase").isin("complete", "complete_with_failures"), F.concat(plural(c("delivered"), "record"), F.lit(" in the destination"))).alias("done"),
    )


def identity_first(contract: Contract) -> list[str]:
    """Field names with the identity in front, the others in contract order."""
    return [f.name for f in sorted(contract.fields, key=lambda f: not f.identity)]


def contract_view(contract: Contract, spark) -> DataFrame:
    """Fields as a reader sees them, with their spellings in order."""
    rows = [(f.name, f.title, f.required, f.kind, f.identity, f.unique, list(f.values), sorted(f.spellings())) for f in contract.fields]
    return spark.createDataFrame(rows, "name string, label string, required boolean, kind string, is_identity boolean, is_unique boolean, allowed_values array<string>, spellings array<string>")
