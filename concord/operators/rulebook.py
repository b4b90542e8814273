"""Rules and contracts as stored rows: shape, normal form, guarded versions, overrides, previews and what a decision can teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.dates import settle_with, with_dates
from ..functions.text import normalize_header, trim_surrounding
from ..storage import materialise

#: What values of enums mean: dictionaries by field, or a table (field, term, canonical; ``pos`` where terms repeat, the last wins).
Rules = dict[str, dict[str, str]] | DataFrame | None
#: Learned texts that a task may hold; beyond that rows and texts are joined by a shuffle.
MOST_TEXTS = 1_000_000
#: Rows with one text from which on it counts as a crowd, whose rows one task of a shuffle should not all receive.
CROWD = 10_000

MAX_VALUE, MAX_RATIONALE = 120, 240


def shape_error() -> Column:
    """The first thing a rule of its kind lacks (null: nothing); null and empty count as lacking."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.col("kind")
    return (
        F.when(~has("schema_id"), F.lit("no schema"))
        .when((kind == "HEADER_ALIAS") & ~(has("header") & has("field_name")), F.lit("needs header and field"))
        .when((kind == "VALUE_ALIAS") & ~(has("field_name") & has("value") & has("canonical")), F.lit("needs field, value and canonical value"))
        .when((kind == "DATE_ORDER") & ~has("date_order"), F.lit("needs a reading"))
        .when((kind == "DATE_ORDER") & ~(has("header") | has("field_name")), F.lit("needs column or field"))
        .when((kind == "COLUMN_IGNORE") & ~has("header"), F.lit("needs header"))
        .when((kind == "OVERRIDE") & ~has("targets_rule_id"), F.lit("needs the rule it disables"))
    )


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Matches in the form they are compared in, other texts trimmed, all within their length."""
    form = {c: F.left(normalize_header(F.col(c)), F.lit(MAX_VALUE)) for c in ("header", "value")}
    form |= {c: F.left(trim_surrounding(F.col(c)), F.lit(MAX_VALUE)) for c in ("field_name", "canonical", "targets_rule_id", "schema_id")}
    form["rationale"] = F.left(trim_surrounding(F.col("rationale")), F.lit(MAX_RATIONALE))
    return rules.withColumns({c: e for c, e in form.items() if c in rules.columns})


def update_versions(stored: DataFrame, changes: DataFrame, key: str, body: str) -> DataFrame:
    """``stored`` (key, version, body) after ``changes`` (key, expected, body, pos): a change takes effect only if it
    expects the stored version; of several that do, the first. The version then rises by one."""
    current = stored.select(F.col(key).alias("_k"), F.col("version").alias("_v"))
    valid = changes.join(current, (changes[key] == F.col("_k")) & (changes["expected"] == F.col("_v")))
    taken = valid.groupBy("_k").agg(F.min_by(F.struct(F.col(body).alias("b")), "pos").alias("new"))
    out = stored.join(taken, stored[key] == taken["_k"], "left")
    hit = F.col("new").isNotNull()
    return out.select(key, (F.col("version") + F.when(hit, 1).otherwise(0)).alias("version"), F.when(hit, F.col("new.b")).otherwise(F.col(body)).alias(body))


def learned_values(contract: Contract, rules: Rules) -> dict[str, dict[str, str]]:
    """The rules that are given as dictionaries; a table has none of them."""
    return {} if rules is None or isinstance(rules, DataFrame) else rules


def learned_texts(df: DataFrame, contract: Contract, rules: Rules) -> DataFrame:
    """Where rules are a table: adds l_<field> to rows with t_<field>, what a rule makes of the text of an enum, else null.

    The distinct texts of the rows meet the rules, of which there may be any number, and only those with a rule that the contract
    permits come back to the rows: as a copy in each task where they are few, by a shuffle where not. Texts that crowds of rows share
    are copied to all tasks even then, and their rows are dealt out evenly.
    """
    if not isinstance(rules, DataFrame):
        return df
    enums = [f for f in contract.fields if f.kind == "enum"]
    term = lambda f: normalize_header(F.col(f"t_{f.name}"))
    permitted = df.sparkSession.createDataFrame([(f.name, v) for f in enums for v in f.values], "field string, canonical string")
    last = F.max_by("canonical", "pos") if "pos" in rules.columns else F.max("canonical")
    fine = rules.join(F.broadcast(permitted), ["field", "canonical"]).groupBy("field", "term").agg(last.alias("canonical"))
    texts = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), term(f).alias("term")) for f in enums])).alias("e")).select("e.*").filter("term <> ''")
    texts = texts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))
    met = materialise(texts.join(fine, ["field", "term"], "left").filter(F.col("canonical").isNotNull() | (F.col("n") >= CROWD)), "texts")
    crowds = met.filter(F.col("n") >= CROWD).select("field", "term", "canonical")  # at most one in CROWD texts
    found = met.filter(F.col("n") < CROWD).select("field", "term", "canonical")
    few_texts = met.count() <= MOST_TEXTS
    for f in enums:
        own = lambda t, c: t.filter(F.col("field") == f.name).select(F.col("term").alias("_term"), F.col("canonical").alias(c))  # noqa: B023, E731
        df = df.withColumn("_term", term(f))
        if few_texts:
            df = df.join(F.broadcast(own(met.filter("canonical IS NOT NULL"), f"l_{f.name}")), "_term", "left").drop("_term")
            continue
        # rows with a text of a crowd, or with none, meet no text in the shuffle: a number that is no term deals them out evenly
        df = df.join(F.broadcast(own(crowds, "_crowd").withColumn("_in", F.lit(True))), "_term", "left")
        spread = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
        df = df.withColumn("_term", F.when(F.col("_in") | (F.coalesce("_term", F.lit("")) == ""), spread).otherwise(F.col("_term")))
        df = df.join(own(found, "_own"), "_term", "left").withColumn(f"l_{f.name}", F.coalesce("_crowd", "_own")).drop("_term", "_crowd", "_in", "_own")
    return df


def toggle_overrides(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("owner", "targets_rule_id", "schema_id")) -> DataFrame:
    """One row for each key: the last state by ``pos``, those of ``new`` after all of ``old``."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by("enabled", F.struct("_late", "pos")).alias("enabled"))


def preview_value(samples: DataFrame, mapped: DataFrame, field: str, value: str, canonical: str) -> DataFrame:
    """Samples (column_id, sample) of columns mapped to the field that a value rule would rewrite."""
    mine = mapped.filter(F.col("target") == field).select("column_id").distinct()
    hit = samples.join(mine, "column_id", "left_semi").filter(normalize_header(F.col("sample")) == value)
    return hit.select("column_id", F.col("sample").alias("before"), F.lit(canonical).alias("after"))


def preview_dates(samples: DataFrame, mapped: DataFrame, field: str | None, order: str, header: str | None = None) -> DataFrame:
    """Ambiguous date samples as the reading settles them: of columns mapped to the field, or of those with the header (mapped:
    column_id, target and, for a header, header)."""
    mine = mapped.filter(F.col("target") == field if header is None else normalize_header(F.col("header")) == header).select("column_id").distinct()
    read = with_dates(samples.join(mine, "column_id", "left_semi"), {"_p": F.col("sample")}).filter("_p.status = 'ambiguous'")
    return read.select("column_id", F.col("sample").alias("before"), settle_with(F.col("_p"), F.lit(order)).alias("after"))


#: Types of issue whose decisions are about a pattern and not about one record.
TEACHABLE = ("AMBIGUOUS_MAPPING", "COMPETING_COLUMNS", "REQUIRED_FIELD_UNMAPPED", "AMBIGUOUS_DATE", "UNSAFE_CLEANUP")


def generalisable(decisions: DataFrame, contract: Contract, types: tuple[str, ...] = TEACHABLE) -> DataFrame:
    """Decisions (type, action, header) that could teach a rule: of the types, not declined, not about a header several fields claim."""
    shared = [s for s, names in contract.spelling_index().items() if len(names) > 1]
    claimed = normalize_header(F.coalesce("header", F.lit(""))).isin(*shared) if shared else F.lit(False)
    return decisions.filter(F.col("type").isin(*types) & ~F.coalesce("action", F.lit("")).isin("reject", "exclude") & ~claimed)


_KEYS = ("kind", "header", "field_name", "value", "canonical", "date_order", "schema_id")


def accept_new(proposed: DataFrame, held: DataFrame, keys: tuple[str, ...] = _KEYS, order: str = "pos") -> DataFrame:
    """Proposed rules whose content (null-safe on all keys) neither a held rule nor an earlier proposal has."""
    rest = [c for c in proposed.columns if c not in keys]
    first = proposed.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").alias("n")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return first.join(held.select(*keys).distinct().alias("h"), same, "left_anti")


DRAFTABLE, READINGS = ("HEADER_ALIAS", "VALUE_ALIAS", "DATE_ORDER", "COLUMN_IGNORE"), ("day_first", "month_first")


def verify_drafts(drafts: DataFrame, contract: Contract) -> DataFrame:
    """rule_id, refused, scope: the first reason against a drafted rule (null: none), and whether it helps the run that made it
    (value) or later ones (column). drafts: rule_id, generalises, kind and the parts of a rule."""
    from .review import check_rules

    form = drafts.withColumn("term", F.when(F.col("kind") == "HEADER_ALIAS", normalize_header(F.coalesce("header", F.lit("")))).otherwise(F.col("value")))
    checked = check_rules(form.select("rule_id", "kind", "field_name", "term", "canonical"), contract).withColumnRenamed("refused", "by_schema")
    kind = F.col("kind")
    reason = (
        F.when(~F.coalesce("generalises", F.lit(False)), F.lit("The model judged that this decision does not generalise."))
        .when(~kind.isin(*DRAFTABLE), F.lit("The model proposed a kind of rule the engine does not accept."))
        .when((kind == "DATE_ORDER") & ~F.coalesce(F.col("date_order").isin(*READINGS), F.lit(False)), F.lit("The drafted date rule named no usable reading."))
        .otherwise(F.coalesce(shape_error(), F.col("by_schema")))
    )
    return drafts.join(checked, "rule_id").select("rule_id", reason.alias("refused"), F.when(kind.isin("VALUE_ALIAS", "DATE_ORDER"), F.lit("value")).otherwise(F.lit("column")).alias("scope"))


def learned_from_mappings(verified: DataFrame, columns: DataFrame, contract: Contract, schema_id: str) -> DataFrame:
    """Header rules (kind, header, field_name, schema_id, scope) that verified mappings (column_id, target) teach, but those
    that the contract refuses."""
    from .review import check_rules

    rows = verified.join(columns.select("column_id", normalize_header(F.col("header")).alias("header")), "column_id").filter("header <> ''")
    rows = rows.select(F.concat_ws(":", "header", "target").alias("rule_id"), F.lit("HEADER_ALIAS").alias("kind"), "header", F.col("target").alias("field_name")).distinct()
    fine = check_rules(rows.select("rule_id", "kind", "field_name", F.col("header").alias("term"), F.lit(None).cast("string").alias("canonical")), contract).filter("refused IS NULL")
    return rows.join(fine.select("rule_id"), "rule_id", "left_semi").select("kind", "header", "field_name", F.lit(schema_id).alias("schema_id"), F.lit("column").alias("scope"))


def search(rules: DataFrame, text: str) -> DataFrame:
    """Rules that mention the text: field and canonical value as they are, header and value in normal form; case does not count."""
    import re

    needle = text.strip().lower()
    if not needle:
        return rules
    plain = re.sub(r"[^a-z0-9]+", "", needle)
    has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x))
    return rules.filter(has("header", plain) | has("field_name", needle) | has("value", plain) | has("canonical", needle))
