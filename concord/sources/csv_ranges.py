"""CSV of any size, line breaks in quotes included, split over tasks.

Spark's text source cuts files into byte ranges and gives their lines; a line may begin within a quoted field, and only what
stands before it says so. Each line is read as a function of that: whether it ends within quotes if it began outside, and if it
began inside. The functions of a range's lines compose to one (two truth values a range), a fold over a file's ranges in order
gives the state in which each begins, and then every range is parsed once, in the right state. A record that runs over the end
of a range leaves its beginning there and its rest in the ranges behind; those two texts meet by the range that the record
began in, so a task holds a record, never a file. Counts of records by range give every row its number in the file.

The rules are those of the plain parser: a quote opens a field at its beginning alone, two quotes within stand for one, text after
the closing quote belongs to the field, rows end at line feeds, carriage returns or both, rows of blanks do not count. A quote that never
closes takes what is left of its file, without a line feed at the very end.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_surrounding
from ..storage import few, materialise

_QUOTED = r'(?:[^"]++|"")*+'
_REST = r"(?:[^\",\r][^,\r]*+)?+"
_FIELDS = rf'(?:(?:"{_QUOTED}"{_REST}|[^",\r][^,\r]*+|)[,\r])*+'
#: Lines that end within quotes: those that begin outside of them, and those that begin inside.
OPENS = re.compile(rf'{_FIELDS}"{_QUOTED}\Z')
STAYS_OPEN = re.compile(rf'{_QUOTED}(?:\Z|"{_REST}[,\r]{_FIELDS}"{_QUOTED}\Z)')
#: Ranges (one small row each) and files that a task may hold as a whole; beyond that they are joined by shuffles.
MOST_RANGES, MOST_FILES = 1_000_000, 20_000


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes."""
    return inside if '"' not in line else (STAYS_OPEN if inside else OPENS).match(line) is not None


def rows_of(text: str) -> list[list[str]]:
    """The rows of whole records that are not blank."""
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    return [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, range, serial, value: lines in their order within a range, without their line feeds."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("serial"), "value")


def _states(given: DataFrame) -> DataFrame:
    """path, range, inside: whether a range begins within quotes."""

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, f = None, (False, True)
        for part in parts:
            out = []
            for path, start, line in zip(part["path"], part["range"], part["value"]):
                if at != (path, start):
                    out += [] if at is None else [(*at, *f)]
                    at, f = (path, start), (False, True)
                f = (inside_after(line, f[0]), inside_after(line, f[1]))
            yield pd.DataFrame(out, columns=["path", "range", "outside_to", "inside_to"])
        if at is not None:
            yield pd.DataFrame([(*at, *f)], columns=["path", "range", "outside_to", "inside_to"])

    # lines without a quote change nothing, so only the others leave the JVM
    found = given.filter(F.contains("value", F.lit('"'))).select("path", "range", "value").mapInPandas(ends, "path string, range long, outside_to boolean, inside_to boolean")
    every = given.groupBy("path", "range").agg(F.count(F.lit(1)).alias("n_lines")).join(found, ["path", "range"], "left")
    # a range leaves one state whatever it finds, turns it over, or keeps it: what counts is the last that fixed it and the turns since
    out, kept = F.coalesce("outside_to", F.lit(False)), F.coalesce("inside_to", F.lit(True))
    every = every.select("path", "range", F.when(out == kept, out).alias("fixed"), (out & ~kept).cast("int").alias("turn"))
    order = Window.partitionBy("path").orderBy("range")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("turns", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(earlier)
    every = every.select("path", "range", last.alias("last"), F.coalesce(F.lag("turns").over(order), F.lit(0)).alias("before"))
    odd = (F.col("before") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return every.select("path", "range", (F.coalesce("last.fixed", F.lit(False)) != odd).alias("inside"))


def _with(given: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with the row of their range, still in order."""
    small, n = few(ranges, MOST_RANGES)
    joined = given.join(small, ["path", "range"])
    return joined if n <= MOST_RANGES else joined.repartition("path", "range").sortWithinPartitions("path", "range", "serial")


def _records(part_lines: Iterator[tuple], whole, edge):
    """Calls ``whole(range row, rows)`` for complete records, in order, and ``edge(range row, head, tail)`` once a range."""
    at, inside, head, held = None, False, None, []

    def end():
        if at is not None:
            return edge(at, None if head is None else "\n".join(head), "\n".join(held) if held else None)

    for key, line in part_lines:
        if at is None or key[:2] != at[:2]:
            yield from end() or ()
            at, inside, held = key, bool(key[2]), []
            head = [] if inside else None
            into_head = inside
            if key[1] == 0 and line.startswith("\ufeff"):
                line = line[1:]
        began = inside
        inside = inside_after(line, inside)
        if into_head:
            head.append(line)
            into_head = inside
        elif inside or began:
            held.append(line)
            if not inside:
                yield from whole(at, rows_of("\n".join(held))) or ()
                held = []
        else:
            yield from whole(at, rows_of(line)) or ()
    yield from end() or ()


def scan_csv(spark: SparkSession, path: str, line_breaks_in_quotes: bool = True) -> DataFrame:
    """file_name, row, header, cells, warning of all CSV files below ``path``. The header is row 1 and rows of blanks do not count;
    short rows are padded, extra cells cut with a warning. Files without a row that is not blank give nothing. Where it
    is known that no field holds a line break, the pass that looks for them can be left out."""
    given = lines(spark, path)
    states = _states(given) if line_breaks_in_quotes else given.select("path", "range").distinct().withColumn("inside", F.lit(False))
    states = materialise(states, "csv-states")

    def keyed(part: pd.DataFrame, *more: str):
        return zip(zip(part["path"], part["range"], part["inside"], *(part[m] for m in more)), part["value"])

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first = 0, None

        def whole(_, rows):
            nonlocal n, first
            first = rows[0] if first is None and rows else first
            n += len(rows)

        def edge(at, head, tail):
            nonlocal n, first
            yield (at[0], at[1], n, first, head, tail)
            n, first = 0, None

        columns = ["path", "range", "n", "first", "head", "tail"]
        for row in _records((x for part in parts for x in keyed(part)), whole, edge):
            yield pd.DataFrame([row], columns=columns)

    kinds = "path string, range long, n long, first array<string>, head string, tail string"
    ends = materialise(_with(given, states).select("path", "range", "inside", "value").mapInPandas(edges, kinds), "csv-ends")

    # a record over several ranges: its beginning, and the heads up to the range where the next record begins
    order = Window.partitionBy("path").orderBy("range")
    owner = F.last(F.when(F.col("tail").isNotNull(), F.col("range")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = ends.filter("tail IS NOT NULL").select("path", F.col("range").alias("owner"), F.lit(-1).cast("long").alias("at"), F.col("tail").alias("text"))
    parts = parts.unionByName(ends.withColumn("owner", owner).filter("head IS NOT NULL").select("path", "owner", F.col("range").alias("at"), F.col("head").alias("text")))
    texts = parts.groupBy("path", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, o, i, r) for p, o, t in zip(part["path"], part["owner"], part["text"]) for i, r in enumerate(rows_of(t))]
            yield pd.DataFrame(rows, columns=["path", "range", "i", "cells"])

    spread = materialise(texts.mapInPandas(over, "path string, range long, i long, cells array<string>"), "csv-spread")
    counts = ends.select("path", "range", "n").join(spread.groupBy("path", "range").agg(F.count(F.lit(1)).alias("more")), ["path", "range"], "left")
    base = F.coalesce(F.sum(F.col("n") + F.coalesce("more", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialise(counts.withColumn("base", base).select("path", "range", "n", "base"), "csv-bases")

    firsts = ends.filter("first IS NOT NULL").select("path", F.struct("range", F.lit(0).cast("long").alias("i")).alias("at"), F.col("first").alias("cells"))
    later = spread.join(bases.select("path", "range", "n"), ["path", "range"]).select("path", F.struct("range", (F.col("n") + F.col("i")).alias("i")).alias("at"), "cells")
    headers = firsts.unionByName(later).groupBy("path").agg(F.min_by("cells", "at").alias("header"))
    headers, _ = few(headers.select("path", F.transform("header", trim_surrounding).alias("header")), MOST_FILES)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done, out = None, 0, []

        def whole(key, rows):
            nonlocal at, done
            if at != key[:2]:
                at, done = key[:2], 0
            for r in rows:
                done += 1
                yield (key[0], key[3] + done, r)

        for row in _records((x for part in parts for x in keyed(part, "base")), whole, lambda *_: None):
            out.append(row)
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=["path", "row", "cells"])
                out = []
        yield pd.DataFrame(out, columns=["path", "row", "cells"])

    inner = _with(given, states.join(bases, ["path", "range"])).select("path", "range", "inside", "base", "value").mapInPandas(parse, "path string, row long, cells array<string>")
    outer = spread.join(bases, ["path", "range"]).select("path", (F.col("base") + F.col("n") + F.col("i") + 1).alias("row"), "cells")
    rows = inner.unionByName(outer).filter("row > 1").join(headers, "path")
    size = F.size("header")
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    extra = F.concat(name, F.lit(" row "), F.col("row").cast("string"), F.lit(" has more cells than headers; the extras were ignored."))
    full = F.slice(F.concat("cells", F.array_repeat(F.lit(""), size)), F.lit(1), size)
    return rows.select(name.alias("file_name"), "row", "header", full.alias("cells"), F.when(F.size("cells") > size, extra).alias("warning"))
