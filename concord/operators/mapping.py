"""Which column feeds which field: candidates, ordered gates, contention, gaps. All inputs are metadata-sized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.shapes import kinds_compatible
from ..functions.text import normalize_header


def spellings(spark: SparkSession, contract: Contract) -> DataFrame:
    rows = [(s, f.name, f.kind, f.required) for f in contract.fields for s in sorted(f.spellings())]
    return spark.createDataFrame(rows, "spelling string, target string, kind string, required boolean")


def spelling_index(spark: SparkSession, contract: Contract) -> DataFrame:
    found = spellings(spark, contract).groupBy("spelling").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    return found.withColumn("ambiguous", F.size("targets") >= 2)


def candidates(columns: DataFrame, contract: Contract, learned: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """columns: column_id, file_id, header, kinds. One row for each field that a header may name, with its basis; none for ignored
    headers (header, in normal form)."""
    spark = columns.sparkSession
    h = normalize_header(F.col("header"))
    if ignored is not None:
        columns = columns.join(ignored.select(F.col("header").alias("_ignored")), h == F.col("_ignored"), "left_anti")
    known = spellings(spark, contract)
    named = columns.withColumn("h", h).join(F.broadcast(known), F.col("h") == F.col("spelling"))
    basis = F.when(F.col("h") == F.lower("target"), F.lit("exact")).otherwise(F.lit("alias"))
    out = named.select("column_id", "file_id", "h", "target", basis.alias("basis"), kinds_compatible(F.col("kind"), F.col("kinds")).alias("viable"), "required")
    if learned is not None:
        fields = spark.createDataFrame([(f.name, f.kind, f.required) for f in contract.fields], "f string, kind string, required boolean")
        more = columns.withColumn("h", h).join(learned.select(F.col("header").alias("lh"), F.col("field_name").alias("target")), F.col("h") == F.col("lh")).join(fields, F.col("target") == F.col("f"))
        more = more.select("column_id", "file_id", "h", "target", F.lit("learned").alias("basis"), kinds_compatible(F.col("kind"), F.col("kinds")).alias("viable"), "required")
        out = out.unionByName(more.join(out.select("column_id", "target"), ["column_id", "target"], "left_anti"))
    return out


def decide(columns: DataFrame, contract: Contract, learned: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """column_id, file_id, target, outcome, gate: the first gate that applies decides.

    A header that several fields claim stays a question unless a learned rule sends this very header to one of them; contention
    looks at the contract alone. Ignored columns (header) leave before the gates.
    """
    spark = columns.sparkSession
    rows = columns.withColumn("h", normalize_header(F.col("header"))).withColumn("skip", F.lit(False))
    if ignored is not None:
        rows = rows.drop("skip").join(ignored.select(F.col("header").alias("h"), F.lit(True).alias("skip")).distinct(), "h", "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
    index = spelling_index(spark, contract).filter("ambiguous").select(F.col("spelling").alias("h"), "targets", F.lit(True).alias("claimed"))
    index = index.withColumn("settled", F.lit(False))
    if learned is not None:
        by_rule = index.drop("settled").join(learned.select(F.col("header").alias("h"), "field_name"), "h").filter(F.array_contains("targets", F.col("field_name"))).select("h", F.lit(True).alias("s")).distinct()
        index = index.join(by_rule, "h", "left").withColumn("settled", F.coalesce("s", F.lit(False)))
    found = candidates(columns, contract, learned, ignored)
    each = found.groupBy("column_id").agg(F.count_if("viable").alias("n_viable"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("viable"), F.col("target"))).alias("one"))
    rows = rows.join(each, "column_id", "left").join(F.broadcast(index.select("h", "claimed", "settled")), "h", "left")
    lone = F.when((F.col("n_viable") == 1) & F.col("claimed").isNull() & ~F.col("skip"), F.col("one"))
    rows = rows.withColumn("lone", lone).withColumn("rivals", F.count("lone").over(Window.partitionBy("file_id", "lone")))
    gate = (
        F.when(F.col("skip"), F.lit("ignored")).when(F.col("claimed") & ~F.col("settled"), F.lit("shared_header")).when(F.col("lone").isNotNull() & (F.col("rivals") > 1), F.lit("contended"))
        .when(F.col("n_viable") == 1, F.lit("mapped")).when(F.col("n_viable") > 1, F.lit("several")).when(F.col("n") > 0, F.lit("mismatch")).otherwise(F.lit("unknown"))
    )
    outcome = F.when(gate == "mapped", F.lit("AUTO_MAPPED")).when(gate == "ignored", F.lit("EXCLUDED")).otherwise(F.lit("ESCALATED"))
    return rows.select("column_id", "file_id", F.when(gate == "mapped", F.col("one")).alias("target"), outcome.alias("outcome"), gate.alias("gate"))


def preview_change(columns: DataFrame, contract: Contract, rule: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """column_id, before, after of the columns whose target or outcome a header rule (header, field_name) or a rule that leaves
    headers out (header) would change."""
    a, b = decide(columns, contract).alias("a"), decide(columns, contract, rule, ignored).alias("b")
    changed = a.join(b, "column_id").filter(~F.col("a.target").eqNullSafe(F.col("b.target")) | ~F.col("a.outcome").eqNullSafe(F.col("b.outcome")))
    return changed.select("column_id", F.col("a.target").alias("before"), F.col("b.target").alias("after"))


def would_change(preview: DataFrame) -> DataFrame:
    """One row: how many places a rule would change, and whether any."""
    return preview.agg(F.count(F.lit(1)).alias("n")).withColumn("would_change", F.col("n") > 0)


def with_profiles(columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Columns with the kinds of their profile; none where there is no profile."""
    kinds = profiles.select("column_id", F.col("detected_kinds").alias("kinds"))
    return columns.join(kinds, "column_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def required_missing(decisions: DataFrame, found: DataFrame, contract: Contract) -> DataFrame:
    """Required fields that no decision supplies and no undecided column offers; none while a column is unknown. A column with a
    header of several fields or a mismatch, or one of several for a field, offers its candidates; an ignored one nothing."""
    spark = decisions.sparkSession
    wanted = spark.createDataFrame([(f.name,) for f in contract.fields if f.required], "target string")
    open_ = decisions.filter("gate = 'unknown'").limit(1)
    offers = found.join(decisions.select("column_id", "gate"), "column_id")
    offers = offers.filter("gate IN ('contended', 'mismatch') OR gate = 'several' AND viable OR gate = 'shared_header' AND basis <> 'learned'").select("target")
    there = offers.union(decisions.filter("outcome = 'AUTO_MAPPED'").select("target")).distinct()
    return wanted.join(there, "target", "left_anti").join(open_.select(F.lit(1).alias("one")), F.lit(True), "left_anti")


def effective(decisions: DataFrame) -> DataFrame:
    """The latest accepted decision (column_id, target, outcome, pos) of each column, by a partial aggregate."""
    rest = [c for c in decisions.columns if c != "column_id"]
    last = decisions.filter(F.col("outcome").isin("AUTO_MAPPED", "HUMAN_CORRECTION")).groupBy("column_id").agg(F.max_by(F.struct(*rest), "pos").alias("d"))
    return last.select("column_id", "d.*")


def project(rows: DataFrame, mapping: dict[str, str], contract: Contract, order: str, file_id: str, file_ordinal: int) -> DataFrame:
    """A file's rows as target fields; the last column that feeds a field wins. mapping: column -> field, in column order."""
    feeds = {target: column for column, target in mapping.items()}
    cells = [F.col(feeds[f.name]).cast("string").alias(f.name) if f.name in feeds else F.lit(None).cast("string").alias(f.name) for f in contract.fields]
    return rows.select(F.struct(F.lit(file_ordinal).alias("file"), F.col(order).cast("long").alias("row")).alias("ord"), F.lit(file_id).alias("file_id"), *cells)


def accept_proposals(proposals: DataFrame, columns: DataFrame, contract: Contract, taken: list[str]) -> DataFrame:
    """proposals: pos, column_id, target. In order: known column, known field, free field, kinds that agree; the first acceptable
    one takes a field for the whole run."""
    spark = proposals.sparkSession
    fields = spark.createDataFrame([(f.name, f.kind) for f in contract.fields], "target string, kind string")
    rows = proposals.join(columns.select("column_id", "kinds", F.lit(True).alias("known")), "column_id", "left").join(F.broadcast(fields), "target", "left")
    reason = (
        F.when(F.col("known").isNull(), F.lit("unknown column")).when(F.col("kind").isNull(), F.lit("unknown field"))
        .when(F.col("target").isin(taken) if taken else F.lit(False), F.lit("already taken")).when(~kinds_compatible(F.col("kind"), F.col("kinds")), F.lit("kinds disagree"))
    )
    rows = rows.withColumn("reason", reason)
    turn = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(Window.partitionBy("target").orderBy("pos"))
    final = F.coalesce("reason", F.when(turn > 1, F.lit("already taken")))
    return rows.select("pos", "column_id", "target", final.isNull().alias("accepted"), final.alias("reason"))
