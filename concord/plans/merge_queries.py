"""Queries of merge, validation and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import ORDER
from ..operators import issues, mapping, reconcile, validate
from .base import ENUM, d_date, d_email, d_strict_email, d_tier, d_trim, query, table
from .catalog import duck, view
from .profile_queries import _PROFILED

# --- merge, validation, repair ---
def union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exports, projected onto the contract and in file order."""
    feeds = {c: c for c in _PROFILED}
    a, b = view(spark, sf_dir, "ord_a"), view(spark, sf_dir, "ord_b")
    return mapping.project(a, feeds, ORDER, "k", "f0", 0).unionByName(mapping.project(b, feeds, ORDER, "k", "f1", 1))


_Q = lambda n: f'"{n}"'
_CANON = {"orderRef": d_trim(_Q("orderRef")), "customerEmail": d_email(_Q("customerEmail")), "placedDate": d_date(_Q("placedDate"))["value"], "shippedDate": d_date(_Q("shippedDate"))["value"], "tier": d_tier("tier")}


def _merge_sql() -> str:
    u = ", ".join(f"{d_trim(_Q(n))} AS t_{n}, CASE WHEN {d_trim(_Q(n))} = '' THEN '' ELSE {c} END AS c_{n}" for n, c in _CANON.items())
    base = duck("ord_a", "ord_b") + f", u0 AS (SELECT 0 AS file, * FROM ord_a UNION ALL SELECT 1 AS file, * FROM ord_b), u AS (SELECT *, lower({d_trim(_Q('orderRef'))}) AS key, {u} FROM u0)"
    one = ", ".join(f'arg_min("{n}", (file, k)) FILTER (WHERE t_{n} <> \'\') AS f_{n}, arg_min(t_{n}, (file, k)) FILTER (WHERE t_{n} <> \'\') AS ft_{n}, arg_min({{\'c\': c_{n}}}, (file, k)) FILTER (WHERE t_{n} <> \'\') AS fc0_{n}, min((file, k)) FILTER (WHERE t_{n} <> \'\') AS fo_{n}, arg_min("{n}", (file, k)) AS b_{n}' for n in _CANON)
    base += f", firsts0 AS (SELECT key, count(*) AS n_rows, {one} FROM u GROUP BY key), firsts AS (SELECT *, {', '.join(f'fc0_{n}.c AS fc_{n}' for n in _CANON)} FROM firsts0)"
    late = ", ".join(f"u.t_{n} <> '' AND (u.file, u.k) > g.fo_{n} AS later_{n}, coalesce(u.t_{n} = g.ft_{n}, FALSE) OR coalesce(u.c_{n} = g.fc_{n}, FALSE) AS same_{n}" for n in _CANON)
    base += f", marked AS (SELECT u.*, {late} FROM u JOIN firsts g USING (key))"
    agg = ", ".join(f"coalesce(bool_or(later_{n} AND same_{n}), FALSE) AS eq_{n}, list_sort(list_distinct(list(t_{n}) FILTER (WHERE later_{n} AND NOT same_{n}))) AS cs_{n}" for n in _CANON)
    base += f", more AS (SELECT key, {agg} FROM marked GROUP BY key)"
    out = ", ".join(f"CASE WHEN eq_{n} THEN coalesce(nullif(fc_{n}, ''), f_{n}) ELSE coalesce(f_{n}, b_{n}) END AS \"{n}\"" for n in _CANON)
    return base + f", rec AS (SELECT 'rec:' || key AS id, key, n_rows, {out}, {', '.join(f'cs_{n}, ft_{n}, fc_{n}, eq_{n}' for n in _CANON)} FROM firsts JOIN more USING (key))"


_MERGE = _merge_sql()
_FIELDS = ", ".join(map(_Q, _CANON))


@query(_MERGE + f" SELECT id, n_rows, {_FIELDS} FROM rec")
def identity_merge(spark, sf_dir):
    return reconcile.merge(union_rows(spark, sf_dir), ORDER).select("id", "n_rows", *_PROFILED)


@query(duck("ord_a", "ord_b") + f" SELECT 'f0' AS file_id, k AS row, {_FIELDS} FROM ord_a UNION ALL SELECT 'f1', k, {_FIELDS} FROM ord_b")
def multi_file_union(spark, sf_dir):
    return union_rows(spark, sf_dir).select("file_id", F.col("ord.row").alias("row"), *_PROFILED)


_CONFLICT = " UNION ALL ".join(f"SELECT id, '{n}' AS field, array_to_string(list_sort(list_distinct(list_append(cs_{n}, ft_{n}))), '|') AS options FROM rec WHERE len(cs_{n}) > 0" for n in _CANON)


@query(_MERGE + f", c AS ({_CONFLICT}) SELECT 'issue:conflict:' || id || ':' || field AS issue_id, options FROM c")
def merge_conflicts(spark, sf_dir):
    found = issues.conflict_issues(reconcile.merge(union_rows(spark, sf_dir), ORDER), ORDER)
    return found.select("issue_id", F.array_join(F.transform("options", lambda o: o["value"]), "|").alias("options"))


@query(_MERGE + " SELECT 'rec:' || key AS id, string_agg('f' || file || ' row ' || k, ';' ORDER BY file, k) AS sources FROM u GROUP BY key")
def provenance_lists(spark, sf_dir):
    p = reconcile.provenance(union_rows(spark, sf_dir), ORDER)
    named = F.transform(F.array_sort(F.collect_list(F.struct("file_id", "row"))), lambda x: F.concat_ws(" ", x["file_id"], F.lit("row"), x["row"].cast("string")))
    return p.groupBy("id").agg(F.array_join(named, ";").alias("sources"))


@query(_MERGE + " SELECT CAST(sum(n_rows) - count(*) AS BIGINT) AS merged, count(*) AS records, CAST(sum(n_rows) AS BIGINT) AS source_rows FROM rec")
def merged_rows(spark, sf_dir):
    r = reconcile.merge(union_rows(spark, sf_dir), ORDER)
    return r.agg((F.sum("n_rows") - F.count(F.lit(1))).alias("merged"), F.count(F.lit(1)).alias("records"), F.sum("n_rows").alias("source_rows"))


@query(_MERGE + f", v AS (SELECT id, lower({_CANON['customerEmail']}) AS value FROM rec) SELECT 'customerEmail' AS field, value, count(*) AS n_records, min(id) AS first_id, max(id) AS last_id FROM v WHERE value <> '' GROUP BY value HAVING count(*) > 1")
def duplicate_unique(spark, sf_dir):
    return reconcile.duplicates(reconcile.merge(union_rows(spark, sf_dir), ORDER), ORDER)


def d_errors(t: str) -> str:
    c = lambda n: f'{t}."{n}"'
    iso = lambda x: f"(regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast({x} AS DATE) IS NOT NULL)"
    e, p, s, o, r = c("customerEmail"), c("placedDate"), c("shippedDate"), c("orderRef"), c("tier")
    there = lambda x, req: f"({x} IS NOT NULL{'' if req else f' AND {x} <> ' + repr('')})"
    tests = [
        (f"{there(e, 1)} AND NOT contains({e}, '@')", "customerEmail:format"), (f"{there(e, 1)} AND length({e}) > 254", "customerEmail:maxLength"), (f"{there(o, 1)} AND length({o}) > 64", "orderRef:maxLength"), (f"{there(o, 1)} AND length({o}) < 1", "orderRef:minLength"),
        (f"{there(o, 1)} AND NOT regexp_matches({o}, '^[A-Za-z0-9][A-Za-z0-9._/-]*$')", "orderRef:pattern"), (f"{there(p, 1)} AND NOT {iso(p)}", "placedDate:format"), (f"{there(s, 0)} AND NOT {iso(s)}", "shippedDate:format"),
        (f"{there(r, 0)} AND {r} NOT IN ({', '.join(repr(v) for v in ENUM.values)})", "tier:enum"), (f"{e} IS NULL", "customerEmail:required"), (f"{o} IS NULL", "orderRef:required"), (f"{p} IS NULL", "placedDate:required"),
        (f"{e} <> '' AND NOT {d_strict_email(e)}", "customerEmail:email_syntax"), (f"{s} <> '' AND {p} <> '' AND {s} < {p}", "shippedDate:end_before_start"),
    ]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in tests) + ")"


_FIXED = {"orderRef": _CANON["orderRef"], "customerEmail": _CANON["customerEmail"], "tier": f"coalesce({_CANON['tier']}, {d_trim('tier')})"} | {n: f"coalesce({_CANON[n]}, {d_trim(_Q(n))})" for n in ("placedDate", "shippedDate")}
_VALID = _MERGE + f", one AS (SELECT rec.*, {d_errors('rec')} AS e1 FROM rec), fixed AS (SELECT id, e1, n_rows, " + ", ".join(f"CASE WHEN e1 = '' THEN \"{n}\" ELSE {_FIXED[n]} END AS \"{n}\", \"{n}\" AS raw_{n}" for n in _CANON) + f" FROM one), valid AS (SELECT *, {d_errors('fixed')} AS e2 FROM fixed)"


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.two_pass(reconcile.merge(union_rows(spark, sf_dir), ORDER), ORDER)


def _codes(c: str):
    return F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["field"], e["code"])), ",")


@query(_VALID + " SELECT id, e1 AS first_errors, e2 AS errors FROM valid")
def validate_errors(spark, sf_dir):
    return validated(spark, sf_dir).select("id", _codes("first_errors").alias("first_errors"), _codes("errors").alias("errors"))


@query(_VALID + f" SELECT id, CAST(CASE WHEN e1 = '' THEN 1 ELSE 2 END AS BIGINT) AS passes, CASE WHEN e2 = '' THEN 'ready' ELSE 'needs_review' END AS disposition, {_FIELDS} FROM valid")
def two_pass_outcome(spark, sf_dir):
    return validated(spark, sf_dir).select("id", F.col("passes").cast("long").alias("passes"), "disposition", *_PROFILED)


_REPAIRS = " UNION ALL ".join(
    f"SELECT id, '{n}' AS field, 'trim_whitespace' AS rule, raw_{n} AS before, {d_trim('raw_' + n)} AS after FROM valid WHERE e1 <> '' AND raw_{n} <> {d_trim('raw_' + n)}"
    + (f" UNION ALL SELECT id, '{n}', '{rule}', {d_trim('raw_' + n)}, \"{n}\" FROM valid WHERE e1 <> '' AND {d_trim('raw_' + n)} <> \"{n}\"" if rule else "")
    for n, rule in (("orderRef", ""), ("customerEmail", "lowercase_email_domain"), ("placedDate", "normalize_date"), ("shippedDate", "normalize_date"), ("tier", "canonicalize_enum"))
)


@query(_VALID + f" SELECT * FROM ({_REPAIRS})")
def repair_log(spark, sf_dir):
    return validated(spark, sf_dir).select("id", F.explode("repairs").alias("r")).select("id", "r.*")


@query(_VALID + ", r AS (" + _REPAIRS + ") SELECT 'issue:invalid:' || id AS issue_id, split_part(split_part(e2, ',', 1), ':', 1) AS field, split_part(split_part(e2, ',', 1), ':', 2) AS code, \"orderRef\" || ' failed validation twice. ' || CASE WHEN id IN (SELECT id FROM r) THEN 'Safe repairs were applied and it is still invalid.' ELSE 'No safe automatic repair existed for this value.' END AS reason FROM valid WHERE e2 <> ''")
def validation_issues(spark, sf_dir):
    found = issues.validation_issues(validated(spark, sf_dir), ORDER)
    return found.select("issue_id", "field", F.col("detected_errors")[0]["code"].alias("code"), "reason")


@query(_VALID + f", c AS ({_CONFLICT}), r AS (" + _REPAIRS + ") SELECT CASE WHEN e2 = '' THEN 'ready' ELSE 'needs_review' END AS disposition, count(*) AS records, CAST(sum(n_rows - 1) AS BIGINT) AS merged, count(*) FILTER (WHERE id IN (SELECT id FROM c)) AS conflicted, CAST(coalesce(sum(nr), 0) AS BIGINT) AS repairs FROM valid LEFT JOIN (SELECT id, count(*) AS nr FROM r GROUP BY 1) USING (id) GROUP BY 1")
def reconcile_orders(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.groupBy("disposition").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("n_rows") - 1).alias("merged"), F.count_if(F.size("conflicts") > 0).alias("conflicted"), F.sum(F.size("repairs")).alias("repairs"))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE strftime(l_shipdate, '%Y-%m-%d') < strftime(o_orderdate, '%Y-%m-%d')) AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_order_violation(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return j.agg(F.count(F.lit(1)).alias("lines"), F.count_if(iso("l_shipdate") < iso("o_orderdate")).alias("early"))
