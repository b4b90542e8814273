"""The CSV scan by ranges against the plain parser, on files cut into many ranges."""

import csv
import io
import random

import pytest

from concord.sources.csv_ranges import inside_after, scan_csv
from concord.sources.files import Limits, over_limits, parse_csv


def test_lines_as_functions():
    """A line's end state is that of the plain parser, from either side."""
    r = random.Random(2)
    for _ in range(20000):
        line = "".join(r.choice('"",a\r ') for _ in range(r.randrange(9)))
        for inside in (False, True):
            begun = 'x,"' if inside else ""
            rows = list(csv.reader(io.StringIO(begun + line + "\nEND", newline="")))
            assert inside_after(line, inside) == (not rows or rows[-1] != ["END"]), (line, inside)


def long_quotes(r, n):
    cells = lambda: [str(r.randrange(99)), r.choice(["", "x", 'say "no", twice', "a\nb\n\nc", "\r\n", ",\n,", '"', 'end"\n"', "é日\n本" * 3])]
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["id", "text"])
    for _ in range(n):
        w.writerow(cells())
    return out.getvalue()


def files(r):
    yield "breaks.csv", long_quotes(r, 400)
    yield "one.csv", 'a,b\n"' + "line\n" * 800 + '",x\n"' + ",\n" * 500 + '"\n'  # records over many ranges
    yield "odd.csv", '﻿ name , b\n5" pipe,"x"y"z\n"open",2,3\n , \n\n"a""b",\n"' + "q\n" * 60 + '"tail,z\nlast,"never closed\nat all'
    yield "mac.csv", "a,b\r1,2\r3,4\r" * 30
    yield "plain + more.csv", "h1,h2\n" + "".join(f"{i},v{i}\n" for i in range(900))
    yield "wide.csv", ",".join(f"c{i}" for i in range(60)) + "\n" + ",".join(map(str, range(60))) + "\n"
    yield "empty.csv", "\n , \n"


@pytest.mark.parametrize("size", [397, 1 << 20])
def test_scan_gives_the_rows_of_the_plain_parser(spark, tmp_path, size):
    want, some = {}, dict(files(random.Random(5)))
    for name, text in some.items():
        (tmp_path / name).write_bytes(text.encode())
        try:
            header, rows = parse_csv(text.encode(), Limits())
        except ValueError:
            continue
        for number, cells, warning in rows:
            want[name, number] = (header, cells, warning and f"{name} {warning}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        ranges = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        got = {(r["file_name"], r["row"]): (r["header"], r["cells"], r["warning"]) for r in scan_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ranges > 20 or size > 397
    assert got == want


def test_scan_by_shuffles(spark, tmp_path, monkeypatch):
    """Beyond the size that a task may hold, ranges and headers are joined by shuffles; lines stay in order."""
    from concord.sources import csv_ranges

    text = long_quotes(random.Random(8), 200)
    (tmp_path / "a.csv").write_text(text, newline="")
    monkeypatch.setattr(csv_ranges, "MOST_RANGES", 1)
    monkeypatch.setattr(csv_ranges, "MOST_FILES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 301)
    try:
        got = {r["row"]: r["cells"] for r in scan_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: cells for n, cells, _ in parse_csv(text.encode(), Limits())[1]}


def test_limits_of_a_run(spark):
    rows = [("a.csv", i, ["h", "k"], ["x" * (i == 3) * 9, "y"]) for i in range(2, 7)] + [("b.csv", 2, ["h"], ["x"])]
    df = spark.createDataFrame(rows, "file_name string, row long, header array<string>, cells array<string>")
    got = {(r["file_name"], r["error"]) for r in over_limits(df, Limits(columns=1, rows=4, cell=8), files=1, total_rows=5).collect()}
    assert got == {
        ("a.csv", "a.csv: 2 columns exceeds the limit of 1."), ("a.csv", "a.csv: 5 rows exceeds the limit of 4."), ("a.csv", 'a.csv: a cell in column "h" is too long (limit 8 characters).'),
        (None, "At most 1 files per migration."), (None, "6 rows exceeds the limit of 5."),
    }
    assert over_limits(df).collect() == [] and over_limits(df.filter("false"), files=0, total_rows=0).collect() == []
