"""Shapes of values, and the kinds a column shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import COMPATIBLE

#: The shapes that values are tested for.
EMAIL = r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._/-]*$"
PERSON = r"(?U)^[\p{L}\p{Nl}\p{No}][^\p{Nd}_]*\s[^\p{Nd}_]+$"
ENUM = r"(?U)^\p{L}[\w\s-]{0,40}$"
_LOCAL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$"
_DOMAIN = r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


def strict_email(c: Column) -> Column:
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    two = F.size(F.split(c, "@")) == 2
    return two & ~F.startswith(c, F.lit(".")) & ~F.contains(c, F.lit("..")) & local.rlike(_LOCAL) & ~F.endswith(local, F.lit(".")) & ~F.startswith(domain, F.lit("-")) & domain.rlike(_DOMAIN)


def kinds_compatible(target: Column, kinds: Column) -> Column:
    allowed = F.create_map(*[x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (F.size(kinds) == 0) | F.coalesce(F.arrays_overlap(kinds, F.try_element_at(allowed, target)), F.lit(False))


def detected_kinds(n, email, date, person, identifier, low_enum, distinct_lower) -> Column:
    """Kinds in order of detection, from counts over a column's non-empty values."""
    most = lambda x: x >= n * F.lit(0.8)
    is_email, is_date = most(email), most(date)
    few = distinct_lower <= F.greatest(F.lit(8), F.floor(n * F.lit(0.2)))
    found = F.array_compact(
        F.array(
            F.when(is_email, F.lit("email")), F.when(is_date, F.lit("date")), F.when(most(person), F.lit("person_name")),
            F.when(~is_email & ~is_date & most(identifier), F.lit("identifier")), F.when(~is_date & most(low_enum) & few, F.lit("enum")), F.lit("text"),
        )
    )
    return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))
