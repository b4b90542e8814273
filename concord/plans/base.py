"""The registry of queries, and DuckDB texts of the expressions that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..contract import ORDER
from ..functions import dates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ENUM = ORDER["tier"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- DuckDB texts of the shared expressions (inputs here are ASCII) ---


def d_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_email(x: str) -> str:
    t = d_trim(x)
    dom = f"split_part({t}, '@', -1)"
    return f"CASE WHEN strpos({t}, '@') > 1 THEN left({t}, length({t}) - length({dom})) || lower({dom}) ELSE {t} END"


def d_tier(x: str) -> str:
    pairs = {v.replace("_", ""): v for v in ENUM.values} | ENUM.value_aliases
    return rf"CASE regexp_replace(lower({d_trim(x)}), '[\s_-]+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def d_date(x: str) -> dict[str, str]:
    t = d_trim(x)
    names = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"

    def real(y, m, d):
        s = f"(lpad({y}, 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0'))"
        return f"CASE WHEN try_cast({s} AS DATE) BETWEEN DATE '1900-01-01' AND DATE '2100-12-31' THEN {s} END"

    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    iso, mf, df, num = (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^([A-Za-z]+) (\d{1,2}), (\d{4})$", r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$", r"^(\d{1,4})[/.-](\d{1,2})[/.-](\d{1,4})$")
    month = lambda w: f"list_position({names}, lower({w}))"
    dm, md, ymd = real(g(num, 3), g(num, 2), g(num, 1)), real(g(num, 3), g(num, 1), g(num, 2)), real(g(num, 1), g(num, 2), g(num, 3))
    value = (
        f"CASE WHEN regexp_matches({t}, '{iso}') THEN {real(g(iso, 1), g(iso, 2), g(iso, 3))} WHEN regexp_matches({t}, '{mf}') THEN {real(g(mf, 3), month(g(mf, 1)), g(mf, 2))} "
        f"WHEN regexp_matches({t}, '{df}') THEN {real(g(df, 3), month(g(df, 2)), g(df, 1))} WHEN length({g(num, 1)}) = 4 THEN {ymd} "
        f"WHEN ({dm}) IS NOT NULL AND ({md}) IS NOT NULL AND ({dm}) <> ({md}) THEN NULL ELSE coalesce({dm}, {md}) END"
    )
    both = f"regexp_matches({t}, '{num}') AND NOT regexp_matches({t}, '{iso}') AND length({g(num, 1)}) <= 2 AND ({dm}) IS NOT NULL AND ({md}) IS NOT NULL AND ({dm}) <> ({md})"
    status = f"CASE WHEN {x} IS NULL OR {t} = '' THEN 'empty' WHEN {both} THEN 'ambiguous' WHEN ({value}) IS NOT NULL THEN 'parsed' ELSE 'invalid' END"
    return {"value": f"({value})", "status": status, "dm": f"CASE WHEN {both} THEN {dm} END", "md": f"CASE WHEN {both} THEN {md} END"}


def d_strict_email(v: str) -> str:
    local, dom = f"split_part({v}, '@', 1)", f"split_part({v}, '@', -1)"
    return (
        f"(len(string_split({v}, '@')) = 2 AND NOT starts_with({v}, '.') AND NOT contains({v}, '..') AND regexp_matches({local}, '^[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~.-]+$') "
        f"AND NOT ends_with({local}, '.') AND NOT starts_with({dom}, '-') AND regexp_matches({dom}, '^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}$'))"
    )
