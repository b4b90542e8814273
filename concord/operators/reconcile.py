"""One record for each identity: first value wins, agreement makes it canonical, disagreement is a conflict.

The order-dependent fold has a closed form: every later value is compared with the first non-blank one. So two rounds of
partial aggregates and one join on the key do it, the second round only for keys of several rows. The exports are read once, into a
written table of keys and trimmed texts that both rounds read. No window or list ever holds all rows of a key - the options of
a conflict list its distinct texts, which is what they are for; a hot key is aggregated where its rows are read, and Spark may split its
side of the join. Rows without a key skip the shuffle; their number in the whole run is a rank in bitmaps of row numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.dates import with_dates
from ..functions.text import canonical_meaning, trim_surrounding
from ..storage import materialise
from .rulebook import Rules, learned_texts, learned_values


def identity_key(contract: Contract):
    f = contract.identity
    return F.nullif(F.lower(trim_surrounding(F.col(f.name))), F.lit("")) if f else F.lit(None).cast("string")


def global_index(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of the rows (with ``ord``: file, row) with ``index``, their number from 0 among all rows, by file and row.

    Row numbers of a file are counted in bitmaps of 32768, built where the rows are read, so one bit a row is shuffled; bitmaps
    are summed along a file and files along the run (one small row each), and a rank within a bitmap counts its bits. Rows
    are numbered from 1 and no number repeats within a file.
    """
    row = F.col("ord.row")
    bits = rows.groupBy(F.col("ord.file").alias("_file"), F.bitmap_bucket_number(row).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("_bits"))
    bits = bits.withColumn("_n", F.bitmap_count("_bits"))
    before = lambda by, of: f"coalesce(sum({of}) over ({by} rows between unbounded preceding and 1 preceding), 0L)"
    files = bits.groupBy("_file").agg(F.sum("_n").alias("_all")).select("_file", F.expr(before("order by _file", "_all")).alias("_files"))
    pieces = bits.withColumn("_pieces", F.expr(before("partition by _file order by _bucket", "_n"))).join(files, "_file")
    at = some.withColumns({"_file": F.col("ord.file"), "_bucket": F.bitmap_bucket_number(row), "_at": F.bitmap_bit_position(row)}).join(pieces, ["_file", "_bucket"])
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 + 1 as int), 1)), 16, 10) as int)"
    rank = f"bitmap_count(substring(_bits, 1, cast(_at div 8 as int))) + bit_count({byte} & (shiftleft(1, cast(_at % 8 as int)) - 1))"
    return at.withColumn("index", F.expr(f"_files + _pieces + {rank}")).drop("_file", "_bucket", "_at", "_bits", "_n", "_pieces", "_files")


def row_id(index: str = "index"):
    return F.concat(F.lit("rec:row-"), F.col(index).cast("string"))


def merge(rows: DataFrame, contract: Contract, rules: Rules = None) -> DataFrame:
    """ord, file_id and the fields -> id, key, n_rows, first_ord, the fields, conflicts (array of field and sorted values) and the
    disposition that conflicts leave. ``rules``: what values of enums mean, by field as dictionaries or as a table
    (field, term, canonical) of any size. Rows that are only a part of a run have their number in it as ``index``."""
    names = [f.name for f in contract.fields]
    trims = {f"t_{n}": trim_surrounding(F.col(n)) for n in names}
    known = ["index"] if "index" in rows.columns else []
    base = materialise(rows.withColumn("key", identity_key(contract)).select("ord", "key", *known, *names, *[e.alias(c) for c, e in trims.items()]), "rows")
    base = learned_texts(base, contract, rules)
    some = base.filter("key IS NOT NULL")
    learned = {n: f", 'l', l_{n}" for n in names if f"l_{n}" in base.columns}
    firsts = some.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ord").alias("first_ord"),
        *[F.expr(f"min(CASE WHEN t_{n} <> '' THEN named_struct('ord', ord, 'v', `{n}`, 't', t_{n}{learned.get(n, '')}) END) AS f_{n}") for n in names],
        *[F.expr(f"min_by(`{n}`, ord) AS b_{n}") for n in names],
    )
    # meanings only where there is something to compare: of the first value of keys with several rows, and of texts unlike it
    days = [f.name for f in contract.fields if f.kind == "date"]
    several = with_dates(firsts.filter("n_rows > 1"), {f"p_{n}": F.col(f"f_{n}.t") for n in days})
    given = learned_values(contract, rules)
    mean = lambda f, t, known: canonical_meaning(t, f, given.get(f.name), F.col(f"p_{f.name}") if f.kind == "date" else None, F.col(known) if f.name in learned else None)
    several = several.withColumns({f"g_{f.name}": mean(f, F.col(f"f_{f.name}.t"), f"f_{f.name}.l") for f in contract.fields}).drop(*[f"p_{n}" for n in days])
    joined = some.select("key", "ord", *[f"t_{n}" for n in names], *[f"l_{n}" for n in learned]).join(several, "key")
    joined = joined.withColumns({f"u_{n}": F.expr(f"CASE WHEN t_{n} <> f_{n}.t THEN t_{n} END") for n in names})
    joined = with_dates(joined, {f"p_{n}": F.col(f"u_{n}") for n in days})
    joined = joined.withColumns({f"c_{f.name}": mean(f, F.col(f"u_{f.name}"), f"l_{f.name}") for f in contract.fields})
    later = "coalesce(t_{0} <> '' AND ord > f_{0}.ord, false)"
    same = "(t_{0} = f_{0}.t OR coalesce(c_{0} = g_{0}, false))"
    marks = {"eq": f"{later} AND {same}", "ne": f"{later} AND NOT {same}"}
    joined = joined.withColumns({f"{m}_{n}": F.expr(text.format(n)) for n in names for m, text in marks.items()})
    parts = {"at": "min(CASE WHEN eq_{0} THEN ord END)", "lo": "min(CASE WHEN ne_{0} THEN ord END)", "hi": "max(CASE WHEN ne_{0} THEN ord END)", "cs": "collect_set(CASE WHEN ne_{0} THEN t_{0} END)"}
    carried = ["n_rows", "first_ord", *[f"{p}_{n}" for p in "fbg" for n in names]]  # alike in all rows of a key
    both = joined.groupBy("key").agg(*[F.expr(f"any_value({c}) AS {c}") for c in carried], *[F.expr(f"{text.format(n)} AS {p}_{n}") for n in names for p, text in parts.items()])
    fields = [F.expr("CASE WHEN at_{0} IS NOT NULL THEN coalesce(nullif(g_{0}, ''), f_{0}.v) ELSE coalesce(f_{0}.v, b_{0}) END AS `{0}`".format(n)) for n in names]
    plain, agreed = "CASE WHEN at_{0} IS NULL OR lo_{0} < at_{0} THEN f_{0}.t END", "CASE WHEN hi_{0} > at_{0} THEN coalesce(nullif(g_{0}, ''), f_{0}.t) END"
    options = f"array_sort(array_distinct(concat(cs_{{0}}, array_compact(array({plain}, {agreed})))))"
    conflicts = ", ".join(f"CASE WHEN size(cs_{{0}}) > 0 THEN named_struct('field', '{{0}}', 'options', {options}) END".format(n) for n in names)
    record = F.concat(F.lit("rec:"), F.col("key")).alias("id")
    merged = both.select(record, "key", "n_rows", "first_ord", *fields, F.expr(f"array_compact(array({conflicts})) AS conflicts"))
    none = F.array().cast("array<struct<field:string,options:array<string>>>")
    single = firsts.filter("n_rows = 1").select(record, "key", "n_rows", "first_ord", *[F.expr(f"coalesce(f_{n}.v, b_{n}) AS `{n}`") for n in names], none.alias("conflicts"))
    alone = base.filter("key IS NULL").select("ord", "key", *known, *names)
    alone = alone if known else global_index(base.select("ord"), alone)
    alone = alone.select(row_id().alias("id"), "key", F.lit(1).cast("long").alias("n_rows"), F.col("ord").alias("first_ord"), *names, none.alias("conflicts"))
    disposition = F.when(F.size("conflicts") > 0, F.lit("needs_review")).otherwise(F.lit("candidate"))
    return merged.unionByName(single).unionByName(alone).withColumn("disposition", disposition)


def provenance(rows: DataFrame, contract: Contract) -> DataFrame:
    """id, file_id, row: where each record comes from, one row for each source row."""
    keyed = rows.select("ord", "file_id", identity_key(contract).alias("key"))
    known = keyed.filter("key IS NOT NULL").withColumn("id", F.concat(F.lit("rec:"), F.col("key")))
    alone = global_index(keyed.select("ord"), keyed.filter("key IS NULL")).withColumn("id", row_id()).drop("index")
    return known.unionByName(alone).select("id", "file_id", F.col("ord.row").alias("row"))


def duplicate_values(records: DataFrame, contract: Contract, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """field, value, id of each record's values of unique fields, in the form they are compared in."""
    out = None
    for f in (f for f in contract.fields if f.unique):
        value = F.lower(canonical_meaning(trim_surrounding(F.col(f.name)), f, (rules or {}).get(f.name)))
        found = records.select(F.lit(f.name).alias("field"), value.alias("value"), "id", *(["first_ord"] if "first_ord" in records.columns else [])).filter("value <> ''")
        out = found if out is None else out.unionByName(found)
    return out


def duplicates(records: DataFrame, contract: Contract, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """field, value, n_records, first_id, last_id of values of unique fields that several records share."""
    found = duplicate_values(records, contract, rules)
    counted = None if found is None else found.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return None if counted is None else counted.filter("n_records > 1")
