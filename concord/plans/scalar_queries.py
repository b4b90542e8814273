"""Queries of single values: text, dates and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, shapes, text
from .base import ENUM, d_date, d_email, d_strict_email, d_tier, d_trim, query, table
from .catalog import duck, values, view

# --- scalars ---


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', '', 'g') AS header FROM customer")
def normalize_headers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.normalize_header(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("header"))


@query(duck("ord_a") + f' SELECT k, {d_trim("orderRef")} AS trimmed, FALSE AS blank FROM ord_a')
def trim_values(spark, sf_dir):
    return view(spark, sf_dir, "ord_a").select("k", text.trim_surrounding(F.col("orderRef")).alias("trimmed"), text.is_blank(F.col("orderRef")).alias("blank"))


@query(duck("ord_a") + f' SELECT k, {d_email("customerEmail")} AS email FROM ord_a')
def email_domain_lower(spark, sf_dir):
    return view(spark, sf_dir, "ord_a").select("k", text.normalize_email(text.trim_surrounding(F.col("customerEmail"))).alias("email"))


@query(duck("ord_a") + f" SELECT k, {d_tier('tier')} AS tier FROM ord_a")
def enum_canonical(spark, sf_dir):
    return view(spark, sf_dir, "ord_a").select("k", text.canonical_enum(F.col("tier"), ENUM).alias("tier"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'urgent' WHEN 'click' THEN 'low' END AS tier FROM events")
def enum_canonical_with_rules(spark, sf_dir):
    rules = {"error": "urgent", "click": "low", "view": "nothing"}
    return table(spark, sf_dir, "events").select("event_id", text.canonical_enum(F.concat(F.lit("E.R-"), "event_type"), ENUM, {f"er{k}": v for k, v in rules.items()}).alias("tier"))


_D = d_date("raw")


@query(duck("li_dates") + f" SELECT l_orderkey, l_linenumber, l_partkey, {_D['status']} AS status, {_D['value']} AS value FROM li_dates")
def date_parse(spark, sf_dir):
    return dates.with_dates(view(spark, sf_dir, "li_dates"), {"p": F.col("raw")}).select("l_orderkey", "l_linenumber", "l_partkey", "p.status", "p.value")


@query(duck("li_dates") + f" SELECT l_orderkey, l_linenumber, l_partkey, {_D['dm']} AS day_first, {_D['md']} AS month_first FROM li_dates WHERE {_D['status']} = 'ambiguous'")
def date_ambiguous_interpretations(spark, sf_dir):
    p = dates.with_dates(view(spark, sf_dir, "li_dates"), {"p": F.col("raw")})
    return p.filter("p.status = 'ambiguous'").select("l_orderkey", "l_linenumber", "l_partkey", "p.day_first", "p.month_first")


@query(duck("li_dates") + f" SELECT l_orderkey, l_linenumber, l_partkey, coalesce({_D['value']}, CASE WHEN l_partkey % 2 = 0 THEN {_D['dm']} ELSE {_D['md']} END) AS value FROM li_dates")
def date_learned_order(spark, sf_dir):
    order = F.when(F.col("l_partkey") % 2 == 0, F.lit("day_first")).otherwise(F.lit("month_first"))
    p = dates.with_dates(view(spark, sf_dir, "li_dates"), {"p": F.col("raw")})
    return p.select("l_orderkey", "l_linenumber", "l_partkey", dates.settle_with(F.col("p"), order).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%-d %B %Y') END AS written FROM orders")
def date_write_long(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.write_long(F.when(F.col("o_orderkey") % 4 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("written"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS ist_day, 'model:' || strftime(ts, '%Y-%m-%d') AS utc_key, strftime(date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 1110 MINUTE, '%Y-%m-%d %H:%M:%S') AS resets_at, strftime(ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 7 DAY ELSE INTERVAL 2 DAY END, '%Y-%m-%d %H:%M:%S') AS expires_at FROM events")
def day_windows(spark, sf_dir):
    e, ts = table(spark, sf_dir, "events"), F.col("ts")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    kind = F.when(F.col("user_id") % 2 == 0, F.lit("user")).otherwise(F.lit("demo"))
    return e.select("event_id", dates.local_day(ts).cast("string").alias("ist_day"), dates.utc_day_key(ts).alias("utc_key"), stamp(dates.next_local_midnight(ts)).alias("resets_at"), stamp(dates.retention_deadline(ts, kind)).alias("expires_at"))


@query(duck("ord_b") + rf""" SELECT k, regexp_matches("customerEmail", '^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$') AS shape, {d_strict_email('"customerEmail"')} AS strict FROM ord_b""")
def email_shapes(spark, sf_dir):
    c = F.col("customerEmail")
    return view(spark, sf_dir, "ord_b").select("k", c.rlike(shapes.EMAIL).alias("shape"), shapes.strict_email(c).alias("strict"))


@query(r"""SELECT p_partkey, regexp_matches(replace(p_brand, '#', '-'), '^[A-Za-z0-9][A-Za-z0-9._/-]*$') AS identifier, regexp_matches(p_name, '^[A-Za-z][^0-9_]*\s[^0-9_]+$') AS person, regexp_matches(p_type, '^[A-Za-z][A-Za-z0-9_\s-]{0,40}$') AS enum FROM part""")
def value_shapes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("-")).rlike(shapes.IDENTIFIER).alias("identifier"), F.col("p_name").rlike(shapes.PERSON).alias("person"), F.col("p_type").rlike(shapes.ENUM).alias("enum"))
