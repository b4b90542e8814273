"""Idempotent delivery: payloads, keys, outcome classification, bounded retry rounds, insert-only receipts, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract

MAX_ATTEMPTS = 3
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def json_string(c: Column) -> Column:
    """A text as a JSON string in ASCII: quotes, backslashes and control characters escaped, everything else beyond ASCII as the hex
    digits of its UTF-16 units (two for a character beyond the first plane). All in JVM expressions; a text goes by runs of
    plain and other characters, and one without others as it is."""
    escape = F.lit("\\\\u$1")
    units = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), F.lit("(.{4})"), escape)
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", '"': '\\"', "\\": "\\\\"}
    short = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    runs = F.regexp_extract_all(c, F.lit(r'[\x20-\x7e&&[^"\\]]+|["\\\n\r\t\x08\f]|[^\x20-\x7e"\\\n\r\t\x08\f]+'), F.lit(0))
    plain = r'\A[\x20-\x7e&&[^"\\]]*\z'
    made = F.transform(runs, lambda r: F.coalesce(F.try_element_at(short, r), F.when(r.rlike(plain), r).otherwise(units(r))))
    return F.concat(F.lit('"'), F.when(c.rlike(plain), c).otherwise(F.array_join(made, "")), F.lit('"'))


def payload(contract: Contract, ordered: bool = False) -> Column:
    """JSON of the filled fields without blanks between them: in contract order as it is sent, or by name for hashing."""
    fields = sorted(contract.fields, key=lambda f: f.name) if ordered else contract.fields
    entry = lambda f: F.when(F.col(f.name) != "", F.concat(F.lit(f'"{f.name}":'), json_string(F.col(f.name))))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*map(entry, fields))), ","), F.lit("}"))


def payload_hash(contract: Contract) -> Column:
    return F.left(F.sha2(payload(contract, True).cast("binary"), 256), F.lit(32))


def idempotency_key(run: Column, record: Column, revision: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", run, record, revision.cast("string")).cast("binary"), 256), F.lit(32))


def classify(status: Column, attempt: Column) -> Column:
    """State after an attempt; a null status is a timeout."""
    again = F.when(attempt < MAX_ATTEMPTS, F.lit("retry_wait")).otherwise(F.lit("failed"))
    return F.when(status.isin(200, 201), F.lit("succeeded")).when(status.isNull() | status.isin(*RETRYABLE), again).otherwise(F.lit("failed"))


def deliver(intents: DataFrame, status_of) -> DataFrame:
    """Adds attempts and state. ``status_of(attempt)`` gives the destination's answer as a column; rounds are bounded."""
    df = intents.withColumn("state", F.lit("retry_wait")).withColumn("attempts", F.lit(0))
    for i in range(1, MAX_ATTEMPTS + 1):
        waiting = F.col("state") == "retry_wait"
        df = df.withColumns({"state": F.when(waiting, classify(status_of(i), F.lit(i))).otherwise(F.col("state")), "attempts": F.when(waiting, F.lit(i)).otherwise(F.col("attempts"))})
    return df


def final_phase(states: DataFrame) -> DataFrame:
    """One row, from disposition of all records."""
    has = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    return states.agg(F.when(has("retry_wait"), F.lit("delivering")).when(has("failed"), F.lit("complete_with_failures")).when(has("needs_review"), F.lit("review")).otherwise(F.lit("complete")).alias("phase"))


def store_receipts(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, payload_hash, pos -> key, pos, result: stored, replay or conflict. The first write of a key wins."""
    first = incoming.groupBy("key").agg(F.min(F.struct("pos", "payload_hash")).alias("first"))
    rows = incoming.join(first, "key").join(held.select("key", F.col("payload_hash").alias("held")), "key", "left")
    against = F.coalesce("held", "first.payload_hash")
    fresh = F.col("held").isNull() & (F.col("pos") == F.col("first.pos"))
    return rows.select("key", "pos", F.when(fresh, F.lit("stored")).when(F.col("payload_hash") == against, F.lit("replay")).otherwise(F.lit("conflict")).alias("result"))


def backoff(status: Column, attempt: Column, retry_after: Column | None = None) -> Column:
    """Seconds before the next attempt of an answer that may be tried again: what the destination asks for, else a power of two;
    two seconds after a timeout (null status). Null where no attempt follows."""
    asked = F.lit(None).cast("double") if retry_after is None else retry_after.cast("double")
    wait = F.when(status.isNull(), F.lit(2.0)).otherwise(F.coalesce(asked, F.pow(F.lit(2.0), attempt)))
    return F.when(classify(status, attempt) == "retry_wait", wait)


def deliverable(records: DataFrame, intents: DataFrame) -> DataFrame:
    """Records (id, disposition) that are to be sent: ready, waiting, or failed while their intent (record_id, state) still waits."""
    rows = records.join(intents.select(F.col("record_id").alias("id"), F.col("state").alias("intent_state")), "id", "left")
    again = (F.col("disposition") == "failed") & (F.col("intent_state") == "retry_wait")
    return rows.filter(F.col("disposition").isin("ready", "retry_wait") | F.coalesce(again, F.lit(False))).drop("intent_state")


ANSWER = "struct<detail:struct<message:string,errors:array<struct<message:string>>>>"


def failure_text(body: Column, status: Column, attempt: Column) -> Column:
    """Why a destination refused a record: its message and the first three of its errors; else the status, where it was tried
    again, or the answer's own words (200 characters)."""
    parsed = F.from_json(body, ANSWER)["detail"]
    listed = F.array_join(F.transform(F.slice(parsed["errors"], 1, 3), lambda e: F.coalesce(e["message"], F.lit(""))), "; ")
    message = F.coalesce(parsed["message"], F.lit("The destination rejected the record."))
    worded = F.when(F.coalesce(F.size(parsed["errors"]), F.lit(0)) > 0, F.trim(F.concat(message, F.lit(" "), listed))).otherwise(message)
    tried = F.concat(F.lit("The destination returned "), status.cast("string"), F.lit(" on every one of "), attempt.cast("string"), F.lit(" attempts. It may need checking before retrying."))
    return F.when(parsed.isNotNull(), worded).when(status.isin(*RETRYABLE), tried).otherwise(F.coalesce(F.get_json_object(body, "$.detail"), F.left(body, F.lit(200))))



def count_receipts(receipts: DataFrame, run: str) -> DataFrame:
    return receipts.filter(F.col("run_id") == run).agg(F.count(F.lit(1)).alias("n"))


def schema_envelope(contract: Contract) -> str:
    """What a destination needs of a contract, as one header value: Base64 of compact JSON."""
    import base64
    import json

    fields = []
    for f in contract.fields:
        row: dict = {"name": f.name, "label": f.title, "kind": f.kind, "required": f.required}
        row |= {"enum_values": list(f.values)} if f.values else {}
        row |= {"not_before": f.not_before} if f.not_before else {}
        row |= {"max_length": f.max_length} if f.max_length else {}
        fields.append(row)
    return base64.b64encode(json.dumps({"name": contract.name, "fields": fields}, separators=(",", ":")).encode()).decode("ascii")


def read_envelope(c: Column) -> Column:
    """Name and fields of an envelope column; null where it cannot be read."""
    text = F.try_to_binary(c, F.lit("base64")).cast("string")
    return F.from_json(text, "struct<name:string,fields:array<struct<name:string,label:string,kind:string,required:boolean,enum_values:array<string>,not_before:string,max_length:int>>>")


def remaining(used: Column, limit: int) -> Column:
    return F.greatest(F.lit(0), F.lit(limit) - used)


def may_ask(used: Column, per_run: int = 6) -> Column:
    """Whether a run may make one more model request."""
    return used < per_run


def retryable_error(name: Column) -> Column:
    """Whether the class of an error names something that passes."""
    return F.lower(name).rlike("rate|timeout|connection|server|apierror")


def describe_columns(columns: DataFrame, profiles: DataFrame, samples: int = 3) -> DataFrame:
    """column_id and one line for a prompt: id, header, shape, how full and how varied the column is, and a few samples."""
    from ..functions.text import safe_value

    rows = columns.select("column_id", "header").join(profiles, "column_id", "left").withColumn("few", F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, samples))
    each = rows.select("*", F.posexplode_outer("few").alias("place", "sample")).withColumn("safe", F.when(F.col("sample").isNotNull(), safe_value(F.col("sample"))))
    shown = each.groupBy("column_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("safe").isNotNull(), F.struct("place", "safe")))), lambda x: x["safe"]), ", ").alias("examples"))
    number = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        " ", F.concat(F.lit("- id="), F.col("column_id")), F.concat(F.lit("header="), safe_value(F.col("header"))),
        F.when(F.col("total_count").isNotNull(), F.concat(F.lit("shape="), F.coalesce(F.get("detected_kinds", F.lit(0)), F.lit("unknown")))),
        F.concat(F.lit("filled="), number("non_empty_count"), F.lit("/"), number("total_count")), F.concat(F.lit("distinct="), number("distinct_count")),
        F.when(F.col("examples") != "", F.concat(F.lit("examples=["), F.col("examples"), F.lit("]"))),
    )
    return rows.join(shown, "column_id").select("column_id", line.alias("line"))


def describe_schema(contract: Contract, taken: DataFrame) -> DataFrame:
    """place and line of what a prompt says of a contract: its name, the fields that no column supplies yet (``taken``: target), and
    which are gone. Metadata: one line a field."""
    from ..functions.text import safe_value

    spark = taken.sparkSession
    fields = spark.createDataFrame([(i + 3, f.name, f.required, f.kind, list(f.values)) for i, f in enumerate(contract.fields)], "place int, target string, required boolean, kind string, allowed array<string>")
    each = fields.select("*", F.posexplode_outer("allowed").alias("at", "one")).withColumn("safe", F.when(F.col("one").isNotNull(), safe_value(F.col("one"))))
    each = each.groupBy("place", "target", "required", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("safe").isNotNull(), F.struct("at", "safe")))), lambda x: x["safe"]), ", ").alias("values"))
    asks = F.when(F.col("required"), F.lit("required")).otherwise(F.lit("optional"))
    line = F.concat(F.lit("- "), F.col("target"), F.lit(" ("), asks, F.lit(", "), F.col("kind"), F.lit(")"), F.when(F.col("values") != "", F.concat(F.lit(" Allowed values: "), F.col("values"), F.lit("."))).otherwise(F.lit("")))
    free = each.join(taken.select("target"), "target", "left_anti").select("place", line.alias("line"))
    title = spark.createDataFrame([(contract.name,)], "name string").select(F.lit(0).alias("place"), F.concat(F.lit("Target schema: "), safe_value(F.col("name"))).alias("line"))
    fixed = spark.createDataFrame([(1, ""), (2, "Permitted target fields:")], "place int, line string")
    gone = taken.filter("target IS NOT NULL").agg(F.array_sort(F.collect_set("target")).alias("t")).filter("size(t) > 0")
    last = F.concat(F.lit("Already supplied by another column, so not available: "), F.array_join("t", ", "), F.lit("."))
    end = gone.select(F.explode(F.array(F.struct(F.lit(1000).alias("place"), F.lit("").alias("line")), F.struct(F.lit(1001).alias("place"), last.alias("line")))).alias("x")).select("x.*")
    return title.unionByName(fixed).unionByName(free).unionByName(end)
