"""Queries of column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import profile
from .base import d_date, d_trim, query
from .catalog import duck, view

# --- profiles ---
_PROFILED = ["orderRef", "customerEmail", "placedDate", "shippedDate", "tier"]
_CELLS = duck("ord_b") + ", cells AS (" + " UNION ALL ".join(f"SELECT k AS ord, '{c}' AS column_id, {d_trim(chr(34) + c + chr(34))} AS t FROM ord_b" for c in _PROFILED) + ")"


def _cells(spark, sf_dir):
    return profile.long_form(view(spark, sf_dir, "ord_b"), _PROFILED, "k")


@query(_CELLS + " SELECT column_id, count(*) AS total_count, count(*) FILTER (WHERE t <> '') AS non_empty_count, count(DISTINCT CASE WHEN t <> '' THEN t END) AS distinct_count FROM cells GROUP BY 1")
def profile_columns(spark, sf_dir):
    return profile.profile_columns(_cells(spark, sf_dir)).select("column_id", "total_count", "non_empty_count", "distinct_count")


@query(_CELLS + ", f AS (SELECT column_id, t AS sample, min(ord) AS o FROM cells WHERE t <> '' GROUP BY 1, 2), r AS (SELECT column_id, CAST(row_number() OVER (PARTITION BY column_id ORDER BY o, sample) AS BIGINT) AS position, sample FROM f) SELECT * FROM r WHERE position <= 5")
def profile_samples(spark, sf_dir):
    p = profile.profile_samples(_cells(spark, sf_dir))
    return p.select("column_id", F.col("position").cast("long").alias("position"), "sample")


_VALUE_SHAPES = {"e": shapes.EMAIL, "p": shapes.PERSON.removeprefix("(?U)"), "i": shapes.IDENTIFIER, "x": shapes.ENUM.removeprefix("(?U)")}


#: Kinds by column, from cells(column_id, t).
KINDS_SQL = (
    f"s AS (SELECT column_id, count(*) AS n, count(DISTINCT lower(t)) AS few, count(*) FILTER (WHERE {d_date('t')['status']} IN ('parsed', 'ambiguous')) AS d, "
    + ", ".join(f"count(*) FILTER (WHERE regexp_matches(t, '{v}')) AS {k}" for k, v in _VALUE_SHAPES.items())
    + """ FROM cells WHERE t <> '' GROUP BY 1), k AS (SELECT column_id, 5 * e >= 4 * n AS e, 5 * d >= 4 * n AS d, 5 * p >= 4 * n AS p, 5 * i >= 4 * n AS i, 5 * x >= 4 * n AND few <= greatest(8, n // 5) AS x FROM s),
 kinds AS (SELECT column_id, list_filter([CASE WHEN e THEN 'email' END, CASE WHEN d THEN 'date' END, CASE WHEN p THEN 'person_name' END, CASE WHEN i AND NOT e AND NOT d THEN 'identifier' END,
 CASE WHEN x AND NOT d THEN 'enum' END, CASE WHEN e IS NOT NULL THEN 'text' END], lambda v: v IS NOT NULL) AS kinds FROM (SELECT DISTINCT column_id FROM cells) LEFT JOIN k USING (column_id))"""
)


@query(_CELLS + f", {KINDS_SQL} SELECT column_id, coalesce(array_to_string(kinds, ','), '') AS kinds FROM kinds")
def detect_kinds(spark, sf_dir):
    return profile.profile_columns(_cells(spark, sf_dir)).select("column_id", F.array_join("detected_kinds", ",").alias("kinds"))
