"""Contracts, dates, files and masks: cases of the behaviour specification."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("header", "fields"),
    [
        ("emp_id", ["employeeId"]), ("Employee Number", ["employeeId"]), ("emp_nm", ["fullName"]), ("email", ["workEmail"]), ("Work Email", ["workEmail"]), ("doj", ["startDate"]),
        ("Joining Date", ["startDate"]), ("dept", ["department"]), ("Division", ["department"]), ("Engagement Type", ["employmentType"]), ("Date", ["startDate", "endDate"]),
        ("Effective Date", ["startDate", "endDate"]), ("Workforce Identifier", []), ("Cost Centre Ref", []), ("id", ["employeeId"]),
    ],
)
def test_headers_of_exports(header, fields):
    from concord.contract import EMPLOYEE, normal

    assert EMPLOYEE.spelling_index().get(normal(header), []) == fields


def test_derived_spellings():
    from concord.contract import derive_spellings

    got = derive_spellings("employeeId", "Employee ID")
    assert {"employeeid", "empid", "empno", "staffnumber", "workercode"} <= got and "id" not in got
    assert derive_spellings("id", "Employee ID") >= {"empid", "employeeid", "empref"}
    assert derive_spellings("workEmail", "Work email") >= {"email", "officemail", "companyemail", "businessmailid"}
    assert derive_spellings("tier", "Tier") == {"tier"}


def test_row_numbers_are_no_fields():
    from concord.contract import infer_contract

    found = infer_contract([{"header": h, "kinds": ["text"]} for h in ("S.No", "Row", "Name", "no", "Index", "??")])
    assert [f.name for f in found.fields] == ["name", "field"]


def test_enum_spellings(spark):
    from concord.contract import EMPLOYEE
    from concord.functions.text import canonical_enum

    rows = [(t,) for t in ("Full-Time", "FTE", "temp", "Fixed Term", "apprentice", "Seasonal Temp")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(canonical_enum(F.col("t"), EMPLOYEE["employmentType"])).collect()]
    assert got == ["full_time", "full_time", "contract", "contract", "intern", None]


def test_dates(spark):
    from concord.functions.dates import parse_date

    cases = {
        "14. March 2026": ("parsed", "2026-03-14", "D MMMM YYYY"), "14TH MARCH 2026": ("parsed", "2026-03-14", "D MMMM YYYY"), "March 14TH, 2026": ("parsed", "2026-03-14", "MMMM D YYYY"),
        "Sept. 3, 2020": ("parsed", "2020-09-03", "MMMM D YYYY"), "2026-3-4": ("parsed", "2026-03-04", "ISO-8601"), "2024/01/02": ("parsed", "2024-01-02", "YYYY/MM/DD"), "05/05/2026": ("parsed", "2026-05-05", "identical either way"),
        "31.12.2020": ("parsed", "2020-12-31", "DD/MM/YYYY"), "12-31-2020": ("parsed", "2020-12-31", "MM/DD/YYYY"), "03/04/2026": ("ambiguous", None, None), "29/02/2023": ("invalid", None, None), "1.2.03": ("invalid", None, None),
        "Foo 3 2020": ("invalid", None, None), "": ("empty", None, None), "31 April 2021": ("invalid", None, None), "2101-01-01": ("invalid", None, None), "1900-01-01": ("parsed", "1900-01-01", "ISO-8601"), "12-Mar-2020": ("parsed", "2020-03-12", "D MMMM YYYY"),
    }
    got = {r["t"]: tuple(r["p"]) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", parse_date(F.col("t")).alias("p")).collect()}
    assert {t: g[:3] for t, g in got.items()} == cases
    assert got["03/04/2026"][3:5] == ("2026-04-03", "2026-03-04")
    assert got["1.2.03"][5] == "1.2.03 has no four-digit year, so the century would be a guess" and got["Foo 3 2020"][5] == 'unrecognised month "Foo"'


def _book(sheet: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.replace("NS", ns))
    return out.getvalue()


def test_files_are_whole_or_an_error(spark, tmp_path):
    from concord.sources.files import Limits, read_exports

    rows = "".join(f"<row r='{i}'><c r='A{i}' t='inlineStr'><is><t>v{i}</t></is></c><c r='B{i}'><v>{v}</v></c></row>" for i, v in ((1, 7), (2, "0012"), (4, "1.50")))
    files = {
        "good.csv": b"\xef\xbb\xbfid, name \n1,a\n\n2\n3,b,extra\n", "long.csv": b"id,name\n" + b"1,a\n" * 6001, "wide.csv": b"a,b\n1," + b"x" * 140_000 + b"\n", "head.csv": b"a,b\n", "empty.csv": b"\n \n",
        "good.xlsx": _book(f"<worksheet NS><sheetData>{rows}</sheetData></worksheet>"), "broken.xlsx": _book("<worksheet NS><sheetData>"), "odd.xlsx": b"not a workbook", "latin.csv": b"a\n\xff\n",
    }
    for n, content in files.items():
        (tmp_path / n).write_bytes(content)
    got = read_exports(spark, str(tmp_path), Limits(rows=6000, cell=130_000)).collect()
    by = {n: [r for r in got if r["file_name"] == n] for n in files}
    assert [(r["row"], r["cells"]) for r in by["good.csv"]] == [(2, ["1", "a"]), (3, ["2", ""]), (4, ["3", "b"])]
    assert [r["warning"] for r in by["good.csv"]] == [None, None, "good.csv row 4 has more cells than headers; the extras were ignored."]
    assert [(r["row"], r["cells"]) for r in by["good.xlsx"]] == [(2, ["v2", "12"]), (4, ["v4", "1.5"])]
    for n, word in (("long.csv", "6001 rows exceeds"), ("wide.csv", 'column "b" is too long'), ("head.csv", "no data rows"), ("empty.csv", "is empty"), ("broken.xlsx", ""), ("odd.xlsx", ""), ("latin.csv", "")):
        assert len(by[n]) == 1 and by[n][0]["cells"] is None and word in by[n][0]["error"] and by[n][0]["error"].startswith(n)
    assert len(read_exports(spark, str(tmp_path / "long.csv")).collect()) == 6001


def test_large_csv_is_split(spark, tmp_path):
    from concord.sources.csv_ranges import scan_csv

    lines = [f'{i},"a ""q"" {i}, b"' + (",more" if i % 5 == 0 else "") for i in range(20_000)]
    (tmp_path / "big.csv").write_text("id, text \n\n" + "\n".join(lines[:9000]) + "\n , \n" + "\n".join(lines[9000:]) + "\n7\n")
    (tmp_path / "small.csv").write_text("x,y,z\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = scan_csv(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = sorted(map(tuple, df.filter("file_name = 'big.csv'").collect()), key=lambda r: r[1])
        assert [r[1] for r in got] == list(range(2, 20_003)) and got[0][2] == ["id", "text"]
        assert [r[3] for r in got] == [[str(i), f'a "q" {i}, b'] for i in range(20_000)] + [["7", ""]]
        assert [tuple(r) for r in df.filter("file_name = 'small.csv'").collect()] == [("small.csv", 2, ["x", "y", "z"], ["1", "2", "3"], None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gates_with_rules(spark):
    from concord.contract import EMPLOYEE
    from concord.operators.mapping import decide

    columns = spark.createDataFrame([("c0", "f0", "Date", ["date"]), ("c1", "f0", "Joining Date", ["date"]), ("c2", "f0", "S. Col", ["text"])], "column_id string, file_id string, header string, kinds array<string>")

    def gates(*rules, ignored=None):
        learned = spark.createDataFrame(list(rules), "header string, field_name string")
        out = spark.createDataFrame([(x,) for x in ignored], "header string") if ignored else None
        return {r["column_id"]: (r["gate"], r["target"]) for r in decide(columns, EMPLOYEE, learned, out).collect()}

    assert gates(("date", "department"))["c0"] == ("shared_header", None)  # a rule for another field settles nothing
    assert gates(("date", "endDate"))["c0"][0] != "shared_header"
    assert gates(("scol", "department"))["c2"] == ("mapped", "department")
    assert gates(("scol", "department"), ignored=["scol"])["c2"] == ("ignored", None)


def test_unknown_fields_and_masks(spark):
    from concord.contract import ORDER
    from concord.functions.text import mask_secrets_json
    from concord.operators.validate import unknown_fields

    df = spark.createDataFrame([({"tier": "x", "zeta": "1", "alpha": "2"}, json.dumps({"a": [{"api_key": "k", "b": 1}], "Token": {"x": 1}}))], "m map<string,string>, j string")
    row = df.select(unknown_fields(F.col("m"), ORDER).alias("e"), mask_secrets_json(F.col("j")).alias("j")).first()
    assert [(e["field"], e["code"]) for e in row["e"]] == [(None, "additionalProperties")] and row["e"][0]["message"] == "Additional properties are not allowed ('alpha', 'zeta' were unexpected) is not part of the target schema."
    assert json.loads(row["j"]) == {"a": [{"api_key": "***", "b": 1}], "Token": "***"}
