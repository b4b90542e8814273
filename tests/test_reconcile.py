"""The reconciler against plain Python, and its edge cases."""

import datetime
import io
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from concord.contract import EMPLOYEE, ORDER, Contract, Field, derive_spellings, field_name, infer_contract, parse_spec, to_yaml
from concord.functions import dates, shapes, text
from concord.operators import deliver, mapping, reconcile, validate


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, ["﻿ Work E-mail ", "Émp_ID"], text.normalize_header) == ["workemail", "mpid"]
    assert one(spark, ["  a b　", "﻿x﻿y"], text.trim_surrounding) == ["a b", "xy"]
    assert one(spark, [None, " \t", "﻿", "a"], text.is_blank) == [True, True, False, False]
    assert one(spark, ["A.b@EXAMPLE.Com", "@X.Y", "none", "a@b@C.D"], text.normalize_email) == ["A.b@example.com", "@X.Y", "none", "a@b@c.d"]
    kind = EMPLOYEE["employmentType"]
    assert one(spark, [" Full-Time", "Permanent", "FULL.TIME", "never"], lambda c: text.canonical_enum(c, kind)) == ["full_time", "full_time", None, None]
    assert one(spark, ["Full.Time"], lambda c: text.canonical_enum(c, kind, {"fulltime": "full_time"})) == ["full_time"]
    assert one(spark, ["é <|x|> a​\tb", "user: hi"], lambda c: text.prompt_text(c, 20)) == ["é a b", "user: hi"]
    assert one(spark, ["abcdef"], lambda c: text.prompt_text(c, 4)) == ["abc…"]


def test_prompt_text(spark):
    def plain(x, limit):
        """The documented rule, character by character."""
        x = unicodedata.normalize("NFC", x)
        x = "".join(c for c in x if not (c in "\u00ad\ufeff" or any(a <= c <= b for a, b in ("\u200b\u200f", "\u202a\u202e", "\u2060\u2064", "\u206a\u206f"))))
        x = "".join(" " if unicodedata.category(c) in ("Cc", "Cf") else c for c in x)
        x = re.sub(r"(?i)<\|[^|>]*\|>|</?(?:system|user|assistant|instructions?)>|```|^\s*#{1,6}\s", " ", x)
        x = " ".join(x.split())
        return x if len(x) <= limit else x[: limit - 1].rstrip() + "…"

    given = [
        "emp\u202eid", "a\u206ab\u200bc\u2066d\u2069", "<INSTRUCTION>x</instructions>y</user>", "a```b```", "# head", " \n###### six", "####### seven", "#none", "a # b", "user: hi", "System : x",
        "<|im_start|>a<||>b", "e\u0301 \u3000\u2028\x1c\x85x", "a" * 58 + " bcd", "b" * 78 + "  cdef", "é" * 60, "", " \u200b\t", '"q" ``', "<\u017fystem>z", "\U000e0041\U00013430x",
    ]
    assert one(spark, [*given, None], text.safe_header) == [*(plain(x, 80) or "(blank)" for x in given), "(blank)"]
    assert one(spark, [*given, None], text.safe_value) == [*('"' + plain(x, 60).replace('"', "'") + '"' for x in given), None]
    assert one(spark, given[:5], text.safe_header) == ["empid", "abc d", "x y", "a b", "head"]


def test_dates(spark):
    cases = {
        "2026-3-4": ("parsed", "2026-03-04"), "2026-02-30": ("invalid", None), "March 14th, 2026": ("parsed", "2026-03-14"), "14 Sept 2026": ("parsed", "2026-09-14"), "1-Mar-2026": ("parsed", "2026-03-01"), "03/04/2026": ("ambiguous", None),
        "04/04/2026": ("parsed", "2026-04-04"), "13/04/2026": ("parsed", "2026-04-13"), "04.13.2026": ("parsed", "2026-04-13"), "2026/04/13": ("parsed", "2026-04-13"), "13/14/2026": ("invalid", None), "01/02/26": ("invalid", None),
        "1899-01-01": ("invalid", None), " ": ("empty", None), "soon": ("invalid", None), "12 Foo 2026": ("invalid", None), None: ("empty", None),
    }
    got = one(spark, list(cases), dates.parse_date)
    assert [(g["status"], g["value"]) for g in got] == list(cases.values())
    assert one(spark, ["03/04/2026", "13/04/2026"], lambda c: dates.learned_date(c, F.lit("month_first"))) == ["2026-03-04", "2026-04-13"]
    assert one(spark, ["2026-03-04", "x"], dates.write_long) == ["4 March 2026", "x"]


def test_strict_email(spark):
    good = ["priya.sharma@example.com", "o'brien@example.co.uk", "first+tag@sub.example.org", "x_y-z@example-corp.com"]
    bad = ["rahul@@example..com", "a.b@example..com", "someone@localhost", "someone.@example.com", ".a@b.co", "a@-b.co"]
    assert one(spark, good + bad, shapes.strict_email) == [True] * len(good) + [False] * len(bad)


def rows(spark, values):
    names = [f.name for f in ORDER.fields]
    data = [((0, i), "f0", *v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "ord struct<file:int,row:long>, file_id string, " + ", ".join(f"{n} string" for n in names))


def test_merge(spark):
    given = [
        ("A-1", " ", "03/04/2026", None, "Urgent"), (" a-1 ", "X@EXAMPLE.com", "03/04/2026", None, "1_urgent"), ("A-1", "X@example.com", "2026-04-03", None, "low"),
        ("", "lone@example.com", "2026-01-01", None, None), ("", "lone@example.com", "2026-01-01", None, None), ("B", None, None, None, None),
    ]
    found = {r["id"]: r for r in reconcile.merge(rows(spark, given), ORDER).collect()}
    a = found["rec:a-1"]
    assert (a["n_rows"], a["orderRef"], a["customerEmail"], a["placedDate"], a["tier"]) == (3, "A-1", "X@example.com", "03/04/2026", "urgent")
    assert {c["field"]: c["options"] for c in a["conflicts"]} == {"orderRef": ["A-1", "a-1"], "placedDate": ["03/04/2026", "2026-04-03"], "tier": ["low", "urgent"]}
    assert sum(r["n_rows"] for r in found.values()) == len(given) and {"rec:row-3", "rec:row-4", "rec:b"} < set(found)
    duplicate = reconcile.duplicates(reconcile.merge(rows(spark, given), ORDER), ORDER).collect()
    assert [(d["value"], d["n_records"]) for d in duplicate] == [("lone@example.com", 2)]


def test_two_passes(spark):
    given = [("A", "a@B.com", "2026-01-02", None, "low"), (" C ", "c@D.com", "3 May 2026", "2026-01-01", "1-URGENT"), ("E", "e@@f..com", "03/04/2026", None, None), ("", "", "", " ", "never")]
    out = validate.two_pass(rows(spark, given).withColumn("id", F.col("ord.row").cast("string")), ORDER).orderBy("ord").collect()
    assert [(r["passes"], r["disposition"]) for r in out] == [(1, "ready"), (2, "needs_review"), (2, "needs_review"), (2, "needs_review")]
    assert out[0]["customerEmail"] == "a@B.com" and out[0]["repairs"] == []
    assert (out[1]["orderRef"], out[1]["customerEmail"], out[1]["placedDate"], out[1]["tier"]) == ("C", "c@d.com", "2026-05-03", "urgent")
    assert [e["code"] for e in out[1]["errors"]] == ["end_before_start"]
    assert [(e["field"], e["code"]) for e in out[2]["errors"]] == [("placedDate", "format"), ("customerEmail", "email_syntax")]
    assert [(e["field"], e["code"]) for e in out[3]["errors"]] == [("customerEmail", "format"), ("orderRef", "minLength"), ("orderRef", "pattern"), ("placedDate", "format"), ("tier", "enum")]


def test_contract_and_specs():
    assert {"orderref", "ref"} == derive_spellings("orderRef", "Order ref")
    again, _ = parse_spec(to_yaml(EMPLOYEE))
    assert again.fields == EMPLOYEE.fields
    bare, notes = parse_spec("id: identifier\nmail: email\n9bad: text\nsince: date\n")
    assert [f.kind for f in bare.fields] == ["identifier", "email", "date"] and notes[0] == "skipped: 9bad"
    for fields in ((), (Field("a"), Field("a")), (Field("a", "enum"),), (Field("a", not_before="b"),), (Field("a", identity=True), Field("b", identity=True))):
        with pytest.raises(ValueError):
            Contract("x", fields)
    assert field_name("1st Straße", {"x"}) == "field1stStrasse"
    assert [f.name for f in infer_contract([{"header": "Emp ID", "kinds": ["identifier"]}, {"header": "emp_id", "kinds": []}, {"header": "Emp Id?", "kinds": []}]).fields] == ["empId"]
    assert EMPLOYEE.naming.name == "fullName" and EMPLOYEE.json_schema()["required"] == ["employeeId", "fullName", "startDate", "workEmail"]


def test_mapping_of_employee_headers(spark):
    heads = ["emp_id", "emp_nm", "email", "doj", "dept", "emp_type", "Date"]
    cols = spark.createDataFrame([(f"c{i}", "f0", h, ["date", "text"] if h in ("doj", "Date") else ["email", "text"] if h == "email" else ["text"]) for i, h in enumerate(heads)], "column_id string, file_id string, header string, kinds array<string>")
    got = {r["column_id"]: (r["target"], r["gate"]) for r in mapping.decide(cols, EMPLOYEE).collect()}
    assert [got[f"c{i}"][0] for i in range(6)] == ["employeeId", "fullName", "workEmail", "startDate", "department", "employmentType"]
    assert got["c6"] == (None, "shared_header")


def test_delivery(spark):
    df = spark.createDataFrame([(1, 503), (2, None), (3, 422), (4, 201)], "id int, status int")
    got = {r["id"]: (r["state"], r["attempts"]) for r in deliver.deliver(df, lambda i: F.col("status")).collect()}
    assert got == {1: ("failed", 3), 2: ("failed", 3), 3: ("failed", 1), 4: ("succeeded", 1)}


def test_files(spark, tmp_path):
    from concord.sources.files import Limits, columns_of, parse_csv, read_exports

    (tmp_path / "a.csv").write_bytes('﻿id, name ,id\r\n1,"a, ""b""\nc"\r\n , ,\r\n2,x,y,z\r\n'.encode())
    (tmp_path / "bad.csv").write_bytes(b"\n\n")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        day = (datetime.date(2026, 3, 14) - datetime.date(1899, 12, 30)).days
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Staff ID</t></is></c><c r="B1" t="inlineStr"><is><t>Joined</t></is></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>007</t></is></c><c r="B4" s="1"><v>{day}</v></c></row></sheetData></worksheet>')
    (tmp_path / "s.xlsx").write_bytes(book.getvalue())
    got = read_exports(spark, str(tmp_path)).cache()
    cells = {(r["file_name"], r["row"]): list(r["cells"]) for r in got.filter("error is null").collect()}
    assert cells == {("a.csv", 2): ["1", 'a, "b"\nc', ""], ("a.csv", 3): ["2", "x", "y"], ("s.xlsx", 4): ["007", "2026-03-14"]}
    assert [r["error"] for r in got.filter("error is not null").collect()] == ["bad.csv: the file is empty."]
    assert [r["column_id"] for r in columns_of(got).orderBy("column_id").collect()] == ["f0:c0", "f0:c1", "f0:c2", "f1:c0", "f1:c1"]
    with pytest.raises(ValueError):
        list(parse_csv(b"a\n1\n2\n", Limits(rows=1))[1])


def test_stream(spark, tmp_path):
    from concord.streaming.feed import event_stream, for_each_batch

    events = spark.createDataFrame([(i, datetime.datetime(2026, 1, 1 + i % 3), "view") for i in range(30)], "event_id long, ts timestamp, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    for_each_batch(event_stream(spark, str(tmp_path / "in"), events.schema, since=9), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 20
