"""Deterministic messy views over the driver tables. One SQL text serves Spark and DuckDB but for how dates are written."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Field
from ..operators.mapping import with_profiles
from ..operators.profile import profile_columns
from ..storage import materialise

SPARK = {"long": "date_format({0}, 'd MMMM yyyy')", "us": "date_format({0}, 'MMMM d, yyyy')", "dmy": "date_format({0}, 'dd/MM/yyyy')", "mdy": "date_format({0}, 'MM/dd/yyyy')", "ymd": "date_format({0}, 'yyyy/MM/dd')", "iso": "date_format({0}, 'yyyy-MM-dd')"}
DUCK = {"long": "strftime({0}, '%-d %B %Y')", "us": "strftime({0}, '%B %-d, %Y')", "dmy": "strftime({0}, '%d/%m/%Y')", "mdy": "strftime({0}, '%m/%d/%Y')", "ymd": "strftime({0}, '%Y/%m/%d')", "iso": "strftime({0}, '%Y-%m-%d')"}

_SHAPED = "CASE {k} % 6 WHEN 0 THEN {iso} WHEN 1 THEN {long} WHEN 2 THEN {us} WHEN 3 THEN {dmy} WHEN 4 THEN {mdy} ELSE {ymd} END"
VIEWS = {
    "ord_a": (
        "orders", "o_orderdate", "o_orderkey",
        """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN '  O-' || lpad(CAST(o_orderkey AS STRING), 7, '0') || ' ' ELSE 'O-' || lpad(CAST(o_orderkey AS STRING), 7, '0') END AS "orderRef",
        'User.' || CAST(o_custkey AS STRING) || '@EXAMPLE.COM' AS "customerEmail", {shaped} AS "placedDate", CAST(NULL AS STRING) AS "shippedDate",
        CASE o_orderkey % 3 WHEN 0 THEN split_part(o_orderpriority, '-', 2) WHEN 1 THEN replace(lower(o_orderpriority), '-', '_') ELSE o_orderpriority END AS tier FROM orders""",
    ),
    "ord_b": (
        "orders", "o_orderdate + CASE WHEN o_orderkey % 7 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END", "o_orderkey",
        """SELECT o_orderkey AS k, 'O-' || lpad(CAST(o_orderkey AS STRING), 7, '0') AS "orderRef",
        CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'User.' || CAST(o_custkey AS STRING) || '@@example..com' ELSE 'User.' || CAST(o_custkey AS STRING) || '@example.com' END AS "customerEmail",
        {iso} AS "placedDate", CASE WHEN o_orderkey % 13 = 0 THEN '1990-01-01' END AS "shippedDate", replace(lower(split_part(o_orderpriority, '-', 2)), ' ', '_') AS tier FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "li_dates": ("lineitem", "l_shipdate", "l_orderkey + l_linenumber", """SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey + l_linenumber AS k, {shaped} AS raw FROM lineitem"""),
}


def sql(name: str, dialect: dict[str, str]) -> str:
    _, date, key, text = VIEWS[name]
    made = {k: v.format(date) for k, v in dialect.items()}
    out = text.format(shaped=_SHAPED.format(k=f"({key})", **made), **made)
    return out if dialect is DUCK else out.replace('"', "`")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = VIEWS[name][0]
    return spark.sql(sql(name, SPARK).replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(*names: str) -> str:
    """WITH clause of the views, for oracles."""
    return "WITH " + ",\n".join(f"{n} AS ({sql(n, DUCK)})" for n in names)


#: Columns of the given tables as exports of their names: whole and text columns, dates as days.
SOURCES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "events": ("event_id", "user_id", "event_type"),
    "labels": ("doc_id", "quality", "toxic"),
}
#: column_id, file_id, header: a column's name without the letters of its table.
NAMES = [(f"{t}:c{i}", t, re.sub("^[a-z]_", "", c)) for t, cs in SOURCES.items() for i, c in enumerate(cs)]
#: A contract whose fields those columns name: alone, together, wrongly, or not at all.
TRADE = Contract(
    "Trade",
    (
        Field("orderKey", "identifier", "Order key", required=True, identity=True), Field("buyerKey", "identifier", "Buyer key", aliases=("custkey", "nationkey")), Field("partyName", "person_name", "Party name", required=True),
        Field("goodName", "text", "Good name"), Field("orderDate", "date", "Order date", required=True), Field("orderStatus", "enum", "Order status", values=("O", "F", "P")),
        Field("priorityMail", "email", "Priority mail", required=True, aliases=("orderpriority",)), Field("brandCode", "identifier", "Brand code", aliases=("brand", "type")),
        Field("documentId", "identifier", "Document id", required=True, aliases=("doc_id",)), Field("shippedOn", "date", "Shipped on", required=True),
    ),
)


def _cell(column: str) -> str:
    return "CAST(CAST(o_orderdate AS DATE) AS STRING)" if column == "o_orderdate" else f"CAST({column} AS STRING)"


def source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, column_id, value of all cells of the sources."""
    out = None
    for t, cs in SOURCES.items():
        wide = spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr("0 AS ord", *[f"{_cell(c)} AS `{t}:c{i}`" for i, c in enumerate(cs)])
        part = wide.unpivot(["ord"], [f"`{t}:c{i}`" for i in range(len(cs))], "column_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """column_id, file_id, file_name, header and the kinds that the values of a column show."""
    names = spark.createDataFrame(NAMES, "column_id string, file_id string, header string").withColumn("file_name", F.concat("file_id", F.lit(".csv")))
    return materialise(with_profiles(names, profile_columns(source_cells(spark, sf_dir))), "columns")


#: The cells in SQL.
CELLS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT '{t}:c{i}' AS column_id, {_cell(c)} AS v FROM {t}" for t, cs in SOURCES.items() for i, c in enumerate(cs)) + ")"


def _text(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_text, x)) + "]::VARCHAR[]"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A VALUES list as a named query, for oracles."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns}))"
