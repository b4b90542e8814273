"""Validation in two passes with one round of safe repairs between them, as generated expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.dates import settle_with
from ..functions.shapes import IDENTIFIER, strict_email
from ..functions.text import with_meanings
from .rulebook import Rules


def _error(cond: Column, name: str, code: str, message: Column | str) -> Column:
    m = message if isinstance(message, Column) else F.lit(message)
    return F.when(cond, F.array(F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), m.alias("message"))))


def errors(contract: Contract, col=F.col) -> Column:
    """Errors in their order: fields by name (enum, format, lengths, pattern), then required, then e-mail syntax and date order."""
    out, missing, extra = [], [], []
    for f in sorted(contract.fields, key=lambda f: f.name):
        v = col(f.name)
        there = v.isNotNull() & ((v != "") | F.lit(f.required))
        missing.append(_error(~there, f.name, "required", f"{f.name} is required but was not supplied.") if f.required else None)
        least, most = {"identifier": (1, 64), "person_name": (1, 200), "email": (0, 254), "text": (0, 500)}.get(f.kind, (0, None))
        most = f.max_length if f.max_length is not None and f.kind != "enum" else most
        if f.kind == "enum":
            out.append(_error(there & ~v.isin(*f.values), f.name, "enum", f"{f.name} must be one of the permitted values."))
        if f.kind == "email":
            out.append(_error(there & ~F.contains(v, F.lit("@")), f.name, "format", f"{f.name} is not a valid email."))
        if f.kind == "date":
            real = v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v), "yyyy-MM-dd").isNotNull()
            out.append(_error(there & ~real, f.name, "format", f"{f.name} is not a valid date."))
        if most is not None:
            out.append(_error(there & (F.length(v) > most), f.name, "maxLength", f"{f.name}: is too long"))
        if least:
            out.append(_error(there & (F.length(v) < least), f.name, "minLength", f"{f.name} must not be empty."))
        if f.kind == "identifier":
            out.append(_error(there & ~v.rlike(IDENTIFIER), f.name, "pattern", f"{f.name} contains characters the target does not accept."))
    for f in contract.fields:
        v = col(f.name)
        if f.kind == "email":
            extra.append(_error((v != "") & ~strict_email(v), f.name, "email_syntax", F.concat(F.lit('"'), v, F.lit('" is not a usable email address.'))))
        if f.not_before:
            earlier = col(f.not_before)
            text = F.concat_ws(" ", F.lit(f.title), v, F.lit("is before"), F.lit(contract[f.not_before].title), F.concat(earlier, F.lit(".")))
            extra.append(_error((v != "") & (earlier != "") & (v < earlier), f.name, "end_before_start", text))
    return _joined([*out, *[m for m in missing if m is not None], *extra], ERROR)


def _joined(entries: list[Column], kind: str) -> Column:
    """The entries that are there (arrays of one, or null), in their order, as generated code: array_compact and lambdas run outside of it,
    with all that stands below them."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*[F.coalesce(e, none) for e in entries])


ERROR, REPAIR = "struct<field:string,code:string,message:string>", "struct<field:string,rule:string,before:string,after:string>"


def unknown_fields(values: Column, contract: Contract) -> Column:
    """The error for the keys of a record (a map) that the contract does not have, all in one; it names no field."""
    names = F.array_sort(F.array_except(F.map_keys(values), F.array(*[F.lit(f.name) for f in contract.fields])))
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    verb = F.when(F.size(names) == 1, F.lit(" was")).otherwise(F.lit(" were"))
    message = F.concat(F.lit("Additional properties are not allowed ("), quoted, verb, F.lit(" unexpected) is not part of the target schema."))
    error = F.struct(F.lit(None).cast("string").alias("field"), F.lit("additionalProperties").alias("code"), message.alias("message"))
    return F.when(F.size(names) > 0, F.array(error)).otherwise(F.slice(F.array(error), 1, 0))


_RULE = {"email": "lowercase_email_domain", "date": "normalize_date", "enum": "canonicalize_enum"}


def two_pass(
    records: DataFrame, contract: Contract, rules: Rules = None, orders: dict[str, Column] | None = None, extra: Column | None = None, excluded: Column | None = None
) -> DataFrame:
    """Adds first_errors, errors, repairs, passes, disposition. A record that is valid as it is stays untouched, and so does one that
    is ``excluded``, which is not validated at all. ``orders`` has the learned reading of dates by field, ``extra`` a map of
    values that the contract may not know: those errors come first, and no repair mends them. Repairs are worked out for invalid
    records alone."""
    orders, names = orders or {}, [f.name for f in contract.fields]
    out = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    checked = errors(contract)
    if extra is not None:
        checked = F.concat(F.coalesce(unknown_fields(extra, contract), F.array().cast(f"array<{ERROR}>")), checked)
    df = records.withColumn("_out", out).withColumn("first_errors", F.when(F.col("_out"), F.slice(checked, 1, 0)).otherwise(checked))
    # the row number keeps filters on the outcome above this point, where first_errors is a column and no expression to repeat
    df = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_bad", (F.size("first_errors") > 0) & (F.col("_at") >= 0))
    bad = F.col("_bad")
    df, fixed = with_meanings(df, contract, rules, bad), {}
    for f in contract.fields:
        made = settle_with(F.col(f"p_{f.name}"), orders[f.name]) if f.name in orders else F.nullif(F.col(f"c_{f.name}"), F.lit(""))
        fixed[f"x_{f.name}"] = F.coalesce(made, F.col(f"t_{f.name}")) if f.kind in _RULE else F.col(f"t_{f.name}")
    df, entries = df.withColumns(fixed), []
    for f in contract.fields:
        raw, t, x = (F.col(p + f.name) for p in ("", "t_", "x_"))
        rule = F.lit(_RULE.get(f.kind, "trim_whitespace"))
        if f.name in orders:
            rule = F.when(F.col(f"p_{f.name}.status") == "ambiguous", F.lit("normalize_date_learned")).otherwise(rule)
        for before, after, name in ((raw, t, F.lit("trim_whitespace")), (t, x, rule)):
            entries.append(F.when(bad & (before != after), F.array(F.struct(F.lit(f.name).alias("field"), name.alias("rule"), before.alias("before"), after.alias("after")))))
    df = df.withColumn("repairs", _joined(entries, REPAIR))
    df = df.withColumns({n: F.when(bad, F.col(f"x_{n}")).otherwise(F.col(n)) for n in names})
    df = df.withColumns({"errors": F.when(bad, checked).otherwise(F.col("first_errors")), "_end": F.monotonically_increasing_id()})
    # once more: filters on what comes out stay above the columns that they would otherwise work out a second time
    once = {n: F.when(F.col("_end") >= 0, F.col(n)) for n in ("first_errors", "errors", "repairs")}
    state = F.when(F.col("_out"), F.lit("excluded")).when((F.size("errors") == 0) & (F.col("_end") >= 0), F.lit("ready")).otherwise(F.lit("needs_review"))
    df = df.withColumns(once | {"disposition": state, "passes": F.when(F.col("_out"), 0).when(bad, 2).otherwise(1)})
    return df.drop("_out", "_at", "_bad", "_end", *[p + n for n in names for p in ("t_", "c_", "p_", "x_", "l_")])
