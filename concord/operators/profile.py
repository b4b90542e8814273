"""Column profiles: one partial aggregate over the long form, samples by first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, shapes, text


def long_form(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """ord, column_id, value of every cell, as text."""
    cells = df.select(F.col(order).alias("ord"), *[F.col(c).cast("string").alias(c) for c in columns])
    return cells.unpivot(["ord"], columns, "column_id", "value")


def profile_columns(cells: DataFrame) -> DataFrame:
    """Counts, share of distinct values and kinds of each column. Values are grouped first, so shapes are tested once for each."""
    t = text.trim_surrounding(F.col("value"))
    each = cells.groupBy("column_id", t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.coalesce(F.col("t") != "", F.lit(False))
    n_if = lambda cond: F.sum(F.when(filled & cond, F.col("n")).otherwise(0))
    v = F.col("t")
    out = each.groupBy("column_id").agg(
        F.sum("n").alias("total_count"), n_if(F.lit(True)).alias("non_empty_count"), F.count_if(filled).alias("distinct_count"),
        n_if(v.rlike(shapes.EMAIL)).alias("_e"), n_if(dates.parse_date(v)["status"].isin("parsed", "ambiguous")).alias("_d"), n_if(v.rlike(shapes.PERSON)).alias("_p"),
        n_if(v.rlike(shapes.IDENTIFIER)).alias("_i"), n_if(v.rlike(shapes.ENUM)).alias("_n"), F.count_distinct(F.when(filled, F.lower(v))).alias("_l"),
    )
    n = F.col("non_empty_count")
    ratio = F.when(n > 0, F.col("distinct_count") / n).otherwise(F.lit(0.0))
    kinds = shapes.detected_kinds(n, F.col("_e"), F.col("_d"), F.col("_p"), F.col("_i"), F.col("_n"), F.col("_l"))
    return out.select("column_id", "total_count", "non_empty_count", "distinct_count", ratio.alias("unique_ratio"), kinds.alias("detected_kinds"))


def profile_samples(cells: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct values of each column, in order of first occurrence."""
    t = text.trim_surrounding(F.col("value"))
    first = cells.filter(t != "").groupBy("column_id", t.alias("sample")).agg(F.min("ord").alias("first_ord"))
    order = Window.partitionBy("column_id").orderBy("first_ord", "sample")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("column_id", "position", text.truncate_sample(F.col("sample")).alias("sample"))
