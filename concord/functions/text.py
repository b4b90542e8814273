"""String expressions of the reconciler. All stay inside code generation but ``prompt_text`` and ``mask_secrets_json``."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BOM = "﻿"
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def trim_surrounding(c: Column) -> Column:
    """Without byte-order marks anywhere and Unicode white space at both ends."""
    return F.regexp_replace(F.replace(c, F.lit(BOM), F.lit("")), _EDGE, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, _EDGE, "") == "")


def normalize_email(c: Column) -> Column:
    """Lower case after the last @; unchanged where @ is missing or first."""
    domain = F.substring_index(c, "@", -1)
    cut = F.length(c) - F.length(domain)
    return F.when(F.contains(c, F.lit("@")) & (cut > 1), F.concat(F.left(c, cut), F.lower(domain))).otherwise(c)


def enum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_surrounding(c)), r"[\s_-]+", "")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]), key)


def canonical_enum(c: Column, field, rules: dict[str, str] | None = None, known: Column | None = None) -> Column:
    """A member, a learned spelling (by ``rules``, or ``known`` already), or an alias of one; else null."""
    members = {v.lower().replace(" ", "").replace("_", "").replace("-", ""): v for v in reversed(field.values)}
    learned = {k: v for k, v in (rules or {}).items() if v in field.values}
    aliases = {k.lower().replace(" ", "").replace("_", "").replace("-", ""): v for k, v in field.value_aliases.items()}
    return F.coalesce(_lookup(members, enum_key(c)), _lookup(learned, normalize_header(c)) if known is None else known, _lookup(aliases, enum_key(c)))


def canonical_meaning(t: Column, field, rules: dict[str, str] | None = None, parsed: Column | None = None, known: Column | None = None) -> Column:
    """What two spellings of one trimmed value share: blank is '', an unsettled date or enum is null. ``parsed`` is the
    struct of a date's text, ``known`` what a rule makes of an enum's."""
    if field.kind == "date":
        from .dates import parse_date

        meaning = (parsed if parsed is not None else parse_date(t))["value"]
    elif field.kind == "enum":
        meaning = canonical_enum(t, field, rules, known)
    elif field.kind == "email":
        meaning = normalize_email(t)
    else:
        meaning = t
    return F.when(t == "", F.lit("")).otherwise(meaning)


def with_meanings(df, contract, rules=None, only: Column | None = None):
    """Adds t_<field> (trimmed) and c_<field> (canonical meaning) of every field, for rows where ``only`` holds."""
    from ..operators.rulebook import learned_texts, learned_values
    from .dates import with_dates

    value = lambda n: F.col(n) if only is None else F.when(only, F.col(n))
    df = df.withColumns({f"t_{f.name}": trim_surrounding(value(f.name)) for f in contract.fields})
    df = learned_texts(df, contract, rules)
    day = [f.name for f in contract.fields if f.kind == "date"]
    df = with_dates(df, {f"p_{n}": F.col(f"t_{n}") for n in day})
    known = lambda f: F.col(f"l_{f.name}") if f"l_{f.name}" in df.columns else None
    given = learned_values(contract, rules)
    made = {f"c_{f.name}": canonical_meaning(F.col(f"t_{f.name}"), f, given.get(f.name), F.col(f"p_{f.name}") if f.kind == "date" else None, known(f)) for f in contract.fields}
    return df.withColumns(made)


def truncate_sample(c: Column, limit: int = 120) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


@functools.cache
def _prompt_patterns():
    """Zero-width and bidirectional characters; all of Cc and Cf; what imitates the structure of a prompt."""
    control = (x for x in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(x) in ("Cc", "Cf"))
    return (
        re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufeff]"),
        re.compile("[" + "".join(map(re.escape, control)) + "]"),
        re.compile(r"(?i)(<\|[^|>]*\|>|</?(?:system|user|assistant|instructions?)>|```|^\s*#{1,6}\s)"),
    )


def prompt_text(c: Column, limit: int) -> Column:
    """Text that may stand in a prompt, by the rule NRM-08 with Python's own Unicode tables and patterns: no invisible characters;
    control characters, prompt structure and white space become blanks, one at a time; cut to the limit."""

    @F.pandas_udf(StringType())
    def cleaned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        invisible, control, structure = _prompt_patterns()

        def one(x):
            if x is None:
                return None
            t = control.sub(" ", invisible.sub("", unicodedata.normalize("NFC", x)))
            t = re.sub(r"\s+", " ", structure.sub(" ", t)).strip()
            return t if len(t) <= limit else t[: limit - 1].rstrip() + "…"

        for s in parts:
            yield s.map(one)

    return cleaned(c)


def safe_header(c: Column) -> Column:
    return F.coalesce(F.nullif(prompt_text(c, 80), F.lit("")), F.lit("(blank)"))


def safe_value(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(prompt_text(c, 60), F.lit('"'), F.lit("'")), F.lit('"'))


_SECRET = r"secret|token|authorization|api_key"


def mask_secrets(m: Column) -> Column:
    """A map with the values of secret-looking keys masked."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike(_SECRET), F.lit("***")).otherwise(v))


def mask_secrets_json(c: Column) -> Column:
    """JSON text with the values of secret-looking keys masked at every depth; text that is no JSON stays as it is."""

    @F.pandas_udf(StringType())
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def walk(x):
            if isinstance(x, dict):
                return {k: "***" if re.search(_SECRET, k.lower()) else walk(v) for k, v in x.items()}
            return [walk(v) for v in x] if isinstance(x, list) else x

        def one(x):
            try:
                return None if x is None else json.dumps(walk(json.loads(x)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return x

        for s in parts:
            yield s.map(one)

    return masked(c)


def owner_pseudonym(issuer: Column, subject: Column) -> Column:
    return F.concat(F.lit("user:"), F.left(F.sha2(F.concat(issuer, F.lit("\0"), subject).cast("binary"), 256), F.lit(32)))
