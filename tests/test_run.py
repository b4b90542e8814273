"""The composed pass, the global row index, rule tables and incremental merges, against plain loops and full runs."""

import random

from pyspark.sql import functions as F

from concord.contract import ORDER
from concord.operators import issues, reconcile, run, validate

FIELDS = [f.name for f in ORDER.fields]
ROWS = "ord struct<file:int,row:long>, file_id string, " + ", ".join(f"{n} string" for n in FIELDS)


def rows(seed=3, n=300):
    r = random.Random(seed)
    out = []
    for file in (0, 1, 2):
        for row in sorted(r.sample(range(2, 70_000), n)):  # gaps, and more than one bitmap
            key = r.choice([None, "", " ", f"O-{r.randrange(60)}", f" o-{r.randrange(60)} "])
            mail = r.choice([None, "", f"u{r.randrange(40)}@EXAMPLE.com", "x@@y", f"u{r.randrange(40)}@example.com"])
            day = r.choice(["2024-02-03", "3 February 2024", "02/03/2024", "31/12/2024", "never", None])
            out.append(((file, row), f"f{file}", key, mail, day, r.choice([None, "2020-01-01", "2024-05-06"]), r.choice(["low", " HIGH", "2-high", "odd", "A B", None])))
    return out


def frame(spark, some):
    return spark.createDataFrame(some, ROWS).repartition(3)


def test_global_index(spark):
    some = rows()
    df = frame(spark, some)
    got = {tuple(r["ord"]): r["index"] for r in reconcile.global_index(df, df).collect()}
    assert got == {ord_: i for i, ord_ in enumerate(sorted(x[0] for x in some))}
    alone = {r["id"]: tuple(r["first_ord"]) for r in reconcile.merge(df, ORDER).filter("key IS NULL").collect()}
    assert alone and all(got[ord_] == int(i.removeprefix("rec:row-")) for i, ord_ in alone.items())
    source = {(r["id"], r["file_id"], r["row"]) for r in reconcile.provenance(df, ORDER).collect()}
    assert {(i, f"f{o[0]}", o[1]) for i, o in alone.items()} <= source and len(source) == len(some)
    assert reconcile.global_index(df, df.filter("false")).collect() == []


def test_rules_as_a_table_are_those_as_dictionaries(spark):
    df = frame(spark, rows())
    rules = {"tier": {"odd": "urgent", "ab": "low", "high": "low"}}
    table = spark.createDataFrame([("tier", t, c, 2) for t, c in rules["tier"].items()] + [("tier", "odd", "medium", 1), ("tier", "ab", "none such", 9), ("orderRef", "odd", "low", 3)] + [("tier", f"t{i}", "low", 1) for i in range(500)], "field string, term string, canonical string, pos int")
    a, b = (sorted(map(str, validate.two_pass(reconcile.merge(df, ORDER, r), ORDER, r).select("id", *FIELDS, "conflicts", "repairs", "errors").collect())) for r in (rules, table))
    assert a == b and a != sorted(map(str, validate.two_pass(reconcile.merge(df, ORDER), ORDER).select("id", *FIELDS, "conflicts", "repairs", "errors").collect()))


def test_composed_pass(spark):
    records = reconcile.merge(frame(spark, rows()), ORDER)
    ids = [r["id"] for r in records.orderBy("first_ord").collect()]
    fixes = [(ids[3], "tier", "odd", 1), (ids[3], "customerEmail", "a@b.example", 2), (ids[3], "tier", "low", 3), (ids[5], "placedDate", "2024-01-01", 1), (ids[8], "placedDate", "never", 1), (ids[8], "unknown", "x", 1), ("rec:none", "tier", "low", 1)]
    gone = [ids[5], ids[6], "rec:none"]
    held = {r["id"]: r for r in records.collect()}
    out, found, events = run.clean_and_validate(records, ORDER, spark.createDataFrame(fixes, "record_id string, field string, value string, pos long"), spark.createDataFrame([(g,) for g in gone], "record_id string"), next_seq=11, ranges=5)
    got = {r["id"]: r for r in out.collect()}
    by_id = {}
    for i, field, value, _ in sorted(fixes, key=lambda x: x[3]):
        if field in FIELDS and i not in gone and i in held:
            by_id.setdefault(i, {}).setdefault(field, None)
            by_id[i][field] = value
    plain = validate.two_pass(records.select("id", "first_ord", *[F.coalesce(*[F.when(F.col("id") == i, F.lit(v[n])) for i, v in by_id.items() if n in v], F.col(n)).alias(n) for n in FIELDS]), ORDER)
    want, n, seq, said = {r["id"]: r for r in plain.collect()}, 0, 11, []
    for i in ids:
        g, w = got[i], want[i]
        if i in gone:
            assert g["disposition"] == "excluded" and g["exclusion_reason"] == run.EXCLUDED and g["revision"] == 1 and [g[f] for f in FIELDS] == [held[i][f] for f in FIELDS] and g["errors"] == []
            continue
        assert ([g[f] for f in FIELDS], g["disposition"], g["errors"], g["revision"]) == ([w[f] for f in FIELDS], w["disposition"], w["errors"], 2 if i in by_id else 1)
        about = held[i]["orderRef"] or i
        said += [("value_repaired", about, p["before"], p["after"]) for p in w["repairs"]]
        said += [("value_corrected", about, held[i][f], v) for f, v in by_id.get(i, {}).items()]
        said += [("validation_failed_twice", about, None, None)] if w["errors"] else []
        n += w["disposition"] == "ready"
    said.append(("validation_summary", None, None, None))
    rows_ = sorted(events.collect(), key=lambda e: e["seq"])
    assert [(e["seq"], e["action"], e["subject"], e["before"], e["after"]) for e in rows_] == [(seq + k, *s) for k, s in enumerate(said)]
    assert rows_[-1]["reason"] == f"{n} of {len(ids)} records are valid and ready to deliver."
    failed = {r["issue_id"]: r for r in found.collect()}
    assert set(failed) == {f"issue:invalid:{i}" for i in ids if i not in gone and want[i]["errors"]}
    one = failed[f"issue:invalid:{ids[8]}"]
    assert one["field"] == want[ids[8]]["errors"][0]["field"] and one["current_value"] == held[ids[8]][one["field"]] and [o["id"] for o in one["options"]] == ["correct_value", f"exclude:{ids[8]}"] and one["detected_errors"] == want[ids[8]]["errors"]


def test_issues_of_records(spark):
    records = reconcile.merge(frame(spark, rows()), ORDER)
    held = {r["id"]: r for r in records.collect()}
    conflicts = issues.conflict_issues(records, ORDER).collect()
    assert conflicts and {(r["record_ids"][0], r["field"]) for r in conflicts} == {(i, c["field"]) for i, r in held.items() for c in r["conflicts"]}
    for r in conflicts:
        record = held[r["record_ids"][0]]
        values = next(c["options"] for c in record["conflicts"] if c["field"] == r["field"])
        title, quoted = ORDER[r["field"]].title, [f'"{v}"' for v in values]
        assert r["reason"] == f"{record['orderRef']} appears in {record['n_rows']} places with different values for {title}: {' and '.join(quoted)}. Merging would silently discard one of them."
        assert r["current_value"] == record[r["field"]] and [o["value"] for o in r["options"]] == values and r["detected_errors"][0]["message"] == f"Sources disagree: {' vs '.join(quoted)}."
        assert record["disposition"] == "needs_review"
    shared = issues.duplicate_issues(reconcile.duplicate_values(records, ORDER), ORDER).collect()
    assert shared
    for r in shared:
        assert r["record_ids"] == sorted(r["record_ids"], key=lambda i: held[i]["first_ord"]) and [o["id"] for o in r["options"]] == ["keep_all", *(f"exclude:{i}" for i in r["record_ids"])] and not r["blocking"]
        assert r["reason"].startswith(f'{len(r["record_ids"])} records with different Order ref values share the Customer email "{r["current_value"]}".')


def test_changes_merge_what_they_touch(spark):
    some = rows(5)
    held = run.MergedRecords(frame(spark, some), ORDER, buckets=16)
    show = lambda df: sorted(map(str, df.select("id", "n_rows", "first_ord", *FIELDS, "conflicts", "disposition").collect()))
    assert show(held.records()) == show(reconcile.merge(frame(spark, some), ORDER))
    for step in range(2):
        at = [10 + step, 200 + step]
        old = [some[i] for i in at]
        new = [(old[0][0], old[0][1], "O-7", *old[0][3:]), (*old[1][:3], "new@example.com", *old[1][4:])]
        for i, row in zip(at, new):
            some[i] = row
        keys = spark.createDataFrame([((r[2] or "").strip().lower() or None,) for r in old], "key string")
        read = held.change(frame(spark, new), keys)
        assert 0 < len(read) <= 3
        assert show(held.records()) == show(reconcile.merge(frame(spark, some), ORDER))
    assert held.change(frame(spark, []), spark.createDataFrame([], "key string")) == set()


def test_routes(spark):
    made = spark.createDataFrame([("a", True, "resolved"), ("b", False, "open"), ("c", None, None)], "issue_id string, blocking boolean, status string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "issue_id string")
    states = lambda *x: spark.createDataFrame([(i,) for i in x], "state string")
    assert tuple(run.route(made).first()) == (1, "await_review", "deliver", "end")
    assert tuple(run.route(made.filter("issue_id <> 'c'"), ids("a", "b"), states("succeeded"), ids("a")).first()) == (0, "deliver", "apply_resolutions", "induce_rules")
    assert tuple(run.route(made, ids("a"), states("retry_wait"), ids("a")).first())[2:] == ("apply_resolutions", "deliver")
    assert tuple(run.route(made, ids("a"), states("failed"), ids("a")).first())[2:] == ("apply_resolutions", "end")
