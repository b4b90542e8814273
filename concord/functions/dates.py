"""Calendar dates in many spellings, as one struct-valued expression, and day arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Months by name, first three letters, and one more spelling; years that count.
MONTH_NUMBERS = {m: i + 1 for i, m in enumerate(MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: The shapes of dates - numbers, month first, day first - and the names of their formats.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85-]+"
_NUMBERS = r"(\d{1,4})([/.-])(\d{1,2})([/.-])(\d{1,4})"
_MONTH_FIRST = rf"([a-z]{{3,9}})\.?{_SPACE}(\d{{1,2}})(?:st|nd|rd|th)?,?{_SPACE}(\d{{4}})"
_DAY_FIRST = rf"(\d{{1,2}})(?:st|nd|rd|th)?\.?{_SPACE}([a-z]{{3,9}})\.?,?{_SPACE}(\d{{4}})"
ISO, MONTH_DAY, DAY_MONTH, YEAR_FIRST, EITHER_WAY, DMY, MDY = "ISO-8601", "MMMM D YYYY", "D MMMM YYYY", "YYYY/MM/DD", "identical either way", "DD/MM/YYYY", "MM/DD/YYYY"
#: All parts by one replacement; a text of no shape gives empty parts.
_PARTS = rf"(?i)^(?:{_NUMBERS}|{_MONTH_FIRST}|{_DAY_FIRST}|[\s\S]*)$"
_OUT = "$1\x01$2$4\x01$3\x01$5\x01$6\x01$7\x01$8\x01$9\x01$10\x01$11"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _iso(y: Column, m: Column, d: Column) -> Column:
    """The date as text if it is in the calendar and its year counts; else null."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= last)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(real, F.concat(y.cast("string"), F.lit("-"), two(m), F.lit("-"), two(d)))


def _read_parts(g: Column) -> dict[str, Column]:
    """The parts as numbers, in the first reading (day first, where numbers leave a choice), and what shape they have."""
    n = lambda i: F.nullif(g[i], F.lit("")).cast("int")  # noqa: E731 - digits or nothing, so no cast fails
    names = F.expr("map(" + ", ".join(f"'{m}', {i}" for m, i in MONTH_NUMBERS.items()) + ")")
    shape = (
        F.when(g[4] != "", F.lit(MONTH_DAY)).when(g[7] != "", F.lit(DAY_MONTH)).when(g[0] == "", F.lit("")).when((F.length(g[0]) == 4) & (g[1] == "--") & (F.length(g[3]) <= 2), F.lit(ISO))
        .when(F.length(g[0]) == 4, F.lit(YEAR_FIRST)).when(F.length(g[3]) == 4, F.lit(DMY)).otherwise(F.lit("no year"))
    )
    word = F.concat(g[4], g[8])
    return {
        "shape": shape, "word": word, "y": F.coalesce(n(6), n(9), F.when(F.length(g[0]) == 4, n(0)).otherwise(n(3))),
        "m": F.when(word != "", F.try_element_at(names, F.lower(word))).otherwise(n(2)), "d": F.coalesce(n(5), n(7), F.when(F.length(g[0]) == 4, n(3)).otherwise(n(0))),
    }


def _read(t: Column, g: Column) -> Column:
    return F.struct(t.alias("t"), *[c.alias(n) for n, c in _read_parts(g).items()])


def _settled(r: Column) -> Column:
    return _outcome(*[r["r"][n] for n in ("t", "shape", "word", "m")], r["one"], r["two"])


def _outcome(t: Column, shape: Column, word: Column, m: Column, one: Column, two: Column, always: Column | None = None) -> Column:
    """status (empty, parsed, ambiguous, invalid), value, format, day_first, month_first, reason. ``always`` is a condition that holds
    for every row and that status and value shall depend on."""
    ambiguous = F.coalesce(one != two, F.lit(False))
    value = F.when(~ambiguous if always is None else ~ambiguous & always, F.coalesce(one, two))
    status = F.when(t.isNull() | (t == ""), F.lit("empty")).when(ambiguous, F.lit("ambiguous")).when(value.isNotNull(), F.lit("parsed")).otherwise(F.lit("invalid"))
    fmt = F.when(shape != DMY, shape).when(one == two, F.lit(EITHER_WAY)).when(one.isNotNull(), F.lit(DMY)).otherwise(F.lit(MDY))
    reason = (
        F.when(shape == "", F.concat(F.lit('"'), t, F.lit('" is not a recognised date format'))).when(shape == "no year", F.concat(t, F.lit(" has no four-digit year, so the century would be a guess")))
        .when((word != "") & m.isNull(), F.concat(F.lit('unrecognised month "'), word, F.lit('"'))).otherwise(F.concat(t, F.lit(" is not a real calendar date")))
    )
    return F.struct(
        status.alias("status"), value.alias("value"), F.when(value.isNotNull(), fmt).alias("format"), F.when(shape == DMY, one).alias("day_first"), F.when(shape == DMY, two).alias("month_first"),
        F.when((t != "") & value.isNull() & ~ambiguous, reason).alias("reason"),
    )


def _parts(t: Column) -> Column:
    return F.split(F.regexp_replace(t, _PARTS, _OUT), "\x01")


def _readings(r: Column) -> Column:
    fits = r["shape"] != "no year"
    return F.struct(r.alias("r"), F.when(fits, _iso(r["y"], r["m"], r["d"])).alias("one"), F.when(r["shape"] == DMY, _iso(r["y"], r["d"], r["m"])).alias("two"))


def parse_date(c: Column) -> Column:
    """The calendar date that a text spells, as a struct: one regular expression, then numbers. Every step is bound once, so a
    filter on the result that the optimizer moves below it repeats one small expression."""
    from .text import trim_surrounding

    parts = lambda t: F.struct(t.alias("t"), _parts(t).alias("g"))
    return let(let(let(let(trim_surrounding(c), parts), lambda x: _read(x["t"], x["g"])), _readings), _settled)


def with_dates(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Adds a parsed struct, as ``parse_date`` makes it, for each named text. Here each step is a plain column, so all of it is
    generated code; the row number keeps filters on the outcome above the steps, which they would repeat."""
    from .text import trim_surrounding

    if not made:
        return df
    own = {n: f"_{i}_dates" for i, n in enumerate(made)}
    at = lambda n, part: F.col(f"{own[n]}_{part}")
    out = df.withColumns({f"{own[n]}_t": trim_surrounding(c) for n, c in made.items()})
    out = out.withColumns({f"{own[n]}_g": _parts(at(n, "t")) for n in made})
    # every column below is used several times by the next step and is no struct, so the optimizer leaves it a column
    read = {n: _read_parts(at(n, "g")) for n in made}
    out = out.withColumns({f"{own[n]}_{part}": c for n in made for part, c in read[n].items()})
    shape, number = (lambda n: at(n, "shape")), lambda n: [at(n, x) for x in "ymd"]
    fits = {n: F.when(shape(n) != "no year", _iso(*number(n))) for n in made}
    swapped = {n: F.when(shape(n) == DMY, _iso(at(n, "y"), at(n, "d"), at(n, "m"))) for n in made}
    out = out.withColumns({f"{own[n]}_one": fits[n] for n in made} | {f"{own[n]}_two": swapped[n] for n in made} | {"_at_dates": F.monotonically_increasing_id()})
    out = out.withColumns({n: _outcome(*[at(n, x) for x in ("t", "shape", "word", "m", "one", "two")], F.col("_at_dates") >= 0) for n in made})
    return out.drop("_at_dates", *[f"{o}_{x}" for o in own.values() for x in ("t", "g", "shape", "word", "y", "m", "d", "one", "two")])


def learned_date(c: Column, order: Column) -> Column:
    """An ambiguous spelling settled by a learned reading (day_first or month_first); else null."""
    return settle_with(parse_date(c), order)


def settle_with(parsed: Column, order: Column) -> Column:
    return F.coalesce(parsed["value"], F.when(parsed["status"] == "ambiguous", F.when(order == "day_first", parsed["day_first"]).when(order == "month_first", parsed["month_first"])))


def local_day(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def next_local_midnight(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_utc_timestamp(F.date_add(local_day(ts, zone), 1).cast("timestamp"), zone)


def utc_day_key(ts: Column) -> Column:
    return F.concat(F.lit("model:"), F.date_format(ts, "yyyy-MM-dd"))


def retention_deadline(ts: Column, kind: Column) -> Column:
    return ts + F.when(kind == "user", F.make_dt_interval(F.lit(7))).otherwise(F.make_dt_interval(F.lit(2)))


def write_long(c: Column) -> Column:
    """2024-03-05 as 5 March 2024; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd"), "d MMMM yyyy"), c)
