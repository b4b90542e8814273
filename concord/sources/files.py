"""CSV and XLSX exports as rows of text, each file whole in one task and files in parallel, and limits over what was read.
CSV files of any size are read by ``csv_ranges``."""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SHEETS, MAX_EXPANDED = 32, 16 * 1024 * 1024
ROWS = "file_name string, checksum string, sheet string, row long, header array<string>, cells array<string>, warning string, error string"


@dataclass(frozen=True)
class Limits:
    """Caps per file; None is no cap."""

    columns: int | None = None
    rows: int | None = None
    cell: int | None = None


def parse_csv(content: bytes, limits: Limits) -> tuple[list[str], Iterator[tuple[int, list[str], str | None]]]:
    """Header and rows as (number, cells, warning); the header is row 1. Blank rows go before numbering, short rows are padded,
    extra cells ignored with a warning. Every limit is checked over the whole file first, so a file gives all its rows or none."""
    text = content.decode("utf-8-sig")
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))

    def filled() -> Iterator[list[str]]:
        return (r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r))

    grid = filled()
    first = next(grid, None)
    if first is None:
        raise ValueError("the file is empty.")
    header = [c.strip() for c in first]
    if not any(header):
        raise ValueError("the header row is empty.")
    if limits.columns is not None and len(header) > limits.columns:
        raise ValueError(f"{len(header)} columns exceeds the limit of {limits.columns}.")
    n, long = 0, None
    for r in grid:
        n += 1
        if long is None and limits.cell is not None:
            long = next((i for i, c in enumerate(r) if len(c) > limits.cell), None)
    if not n:
        raise ValueError("the file has headers but no data rows.")
    if limits.rows is not None and n > limits.rows:
        raise ValueError(f"{n} rows exceeds the limit of {limits.rows}.")
    if long is not None:
        raise ValueError(f'a cell in column "{header[long] if long < len(header) else long + 1}" is too long (limit {limits.cell} characters).')

    def rows() -> Iterator[tuple[int, list[str], str | None]]:
        again = filled()
        next(again)
        for number, r in enumerate(again, 2):
            extra = f"row {number} has more cells than headers; the extras were ignored." if len(r) > len(header) else None
            yield number, (r + [""] * len(header))[: len(header)], extra

    return header, rows()


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates, and spreadsheet error literals.
_DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}
_ERRORS = {"#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NUM!", "#NULL!"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def number_text(raw: str) -> str:
    """A stored number as text: whole numbers without a point, others in their shortest form."""
    if re.fullmatch(r"-?\d+", raw):
        return str(int(raw))
    return repr(float(raw))


def parse_xlsx(content: bytes) -> tuple[str, list[str], list[tuple[int, list[str]]]]:
    """Sheet, header and rows with their true numbers, of the one populated sheet. Formulas and error values are refused."""
    book = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in book.infolist()) > MAX_EXPANDED:
        raise ValueError("the workbook expands to too much text")
    xml = lambda name: ElementTree.fromstring(book.read(name))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        styles = xml("xl/styles.xml")
        own = {int(x.get("numFmtId")): bool(re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "").lower()))) for x in styles.iterfind("m:numFmts/m:numFmt", _NS)}
        dates = [(i := int(x.get("numFmtId", 0))) in _DATE_FORMATS or own.get(i, False) for x in styles.iterfind("m:cellXfs/m:xf", _NS)]
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    sheets = xml("xl/workbook.xml").findall("m:sheets/m:sheet", _NS)
    if len(sheets) > MAX_SHEETS:
        raise ValueError(f"more than {MAX_SHEETS} sheets")
    populated = []
    for s in sheets:
        if s.get("state") == "veryHidden":
            continue
        rows: dict[int, dict[int, str]] = {}
        for row in xml("xl/" + targets[s.get(_REL)].lstrip("/").removeprefix("xl/")).iterfind("m:sheetData/m:row", _NS):
            for c in row.iterfind("m:c", _NS):
                v, kind = c.find("m:v", _NS), c.get("t", "n")
                if c.find("m:f", _NS) is not None:
                    raise ValueError(f"{s.get('name')}!{c.get('r')} is a formula")
                text = v.text if v is not None and v.text else ""
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "n" and text and dates and dates[int(c.get("s", 0))]:
                    text = (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(float(text)))).isoformat()
                elif kind == "n" and text:
                    text = number_text(text)
                if kind == "e" or text in _ERRORS:
                    raise ValueError(f"{s.get('name')}!{c.get('r')} holds an error value")
                if text:
                    rows.setdefault(int(row.get("r")), {})[_column(c.get("r"))] = text
        if any(n >= 2 for n in rows):
            populated.append((s.get("name"), rows))
    if len(populated) != 1:
        raise ValueError(f"{len(populated)} sheets hold rows; one is expected")
    name, rows = populated[0]
    first = min(rows)
    header = [rows[first].get(i, "").strip() for i in range(max(rows[first]) + 1)]
    return name, header, [(n, [r.get(i, "") for i in range(len(header))]) for n, r in sorted(rows.items()) if n > first and any(x.strip() for x in r.values())]


def read_exports(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Rows of all files below ``path`` (.csv, .txt, .xlsx) with name, checksum, sheet and row number; a file that cannot be
    read gives one row with its error and no other. Each file is whole in one task: for exports of the size that people upload.
    ``csv_ranges.scan_csv`` reads CSV files of any size."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in ROWS.split(", ")]
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                name, check = p.rsplit("/", 1)[-1], hashlib.sha256(content).hexdigest()[:32]
                try:
                    if name.lower().endswith(".xlsx"):
                        sheet, header, cells = parse_xlsx(content)
                        rows = iter([(n, c, None) for n, c in cells])
                    else:
                        sheet, (header, rows) = None, parse_csv(content, limits)
                except (ValueError, LookupError, TypeError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    yield pd.DataFrame([(name, check, None, None, None, None, None, f"{name}: {e}")], columns=columns)
                    continue
                while some := [(name, check, sheet, n, header, cells, warning and f"{name} {warning}", None) for n, cells, warning in itertools.islice(rows, 5000)]:
                    yield pd.DataFrame(some, columns=columns)

    return files.mapInPandas(read, ROWS)


def over_limits(rows: DataFrame, limits: Limits = Limits(), files: int | None = None, total_rows: int | None = None) -> DataFrame:
    """What breaks a limit, as sentences: for each file its columns, rows and longest cell, for the run its files and rows in all.
    One partial aggregate over the scanned rows; what is compared is one row a file."""
    each = rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("header")).alias("width"), F.any_value("header").alias("header"),
        F.min(F.when(F.array_max(F.transform("cells", lambda c: F.length(c))) > (limits.cell or 0), F.struct("row", "cells"))).alias("long"),
    )
    number = lambda c: F.col(c).cast("string")
    named = lambda *parts: F.concat(F.col("file_name"), F.lit(": "), *parts)
    place = F.array_position(F.transform("long.cells", lambda c: F.length(c) > (limits.cell or 0)), True)
    texts = []
    if limits.columns is not None:
        texts.append(F.when(F.col("width") > limits.columns, named(number("width"), F.lit(f" columns exceeds the limit of {limits.columns}."))))
    if limits.rows is not None:
        texts.append(F.when(F.col("n") > limits.rows, named(number("n"), F.lit(f" rows exceeds the limit of {limits.rows}."))))
    if limits.cell is not None:
        texts.append(F.when(F.col("long").isNotNull(), named(F.lit('a cell in column "'), F.get("header", (place - 1).cast("int")), F.lit(f'" is too long (limit {limits.cell} characters).'))))
    broken = each.select("file_name", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *texts))).alias("error"))
    run = each.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    said = [F.when(F.col("files") > files, F.lit(f"At most {files} files per migration."))] if files is not None else []
    said += [F.when(F.col("total") > total_rows, F.concat(number("total"), F.lit(f" rows exceeds the limit of {total_rows}.")))] if total_rows is not None else []
    return broken.unionByName(run.select(F.lit(None).cast("string").alias("file_name"), F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *said))).alias("error")))


def columns_of(rows: DataFrame) -> DataFrame:
    """column_id, file_id, header of each file, files numbered by name; positions keep repeated headers apart."""
    heads = rows.filter("header is not null").groupBy("file_name").agg(F.first("header").alias("header"))
    heads = heads.withColumn("file_id", F.concat(F.lit("f"), F.row_number().over(Window.orderBy("file_name")) - 1))  # one row for each file
    return heads.select("file_name", "file_id", F.posexplode("header").alias("i", "header")).select("file_name", "file_id", F.concat_ws(":", "file_id", F.concat(F.lit("c"), "i")).alias("column_id"), F.col("i").alias("position"), "header")
