"""Rules as stored rows, on small hand-written tables."""

from concord.contract import ORDER
from concord.operators import rulebook


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stale_and_unknown_changes_leave_rows_and_the_first_valid_one_wins(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, None)], "id string, version long, body string")
    changes = spark.createDataFrame([("a", 1, "late", 5), ("a", 1, "first", 2), ("b", 1, "stale", 1), ("z", 1, "unknown", 1), ("c", 1, None, 1), (None, 1, "null", 1)], "id string, expected long, body string, pos int")
    found = {r["id"]: (r["version"], r["body"]) for r in rulebook.update_versions(stored, changes, "id", "body").collect()}
    assert found == {"a": (2, "first"), "b": (2, "y"), "c": (2, None)}


def test_overrides_keep_the_last_state(spark):
    schema = "owner string, targets_rule_id string, schema_id string, enabled boolean, pos int"
    old = spark.createDataFrame([("o", "r1", "s", True, 9), ("o", "r2", "s", True, 1)], schema)
    new = spark.createDataFrame([("o", "r1", "s", True, 1), ("o", "r1", "s", False, 2), ("p", "r1", "s", True, 1)], schema)
    assert rows(rulebook.toggle_overrides(old, new)) == [("o", "r1", "s", False), ("o", "r2", "s", True), ("p", "r1", "s", True)]


def test_previews_rewrite_only_samples_of_mapped_columns(spark):
    samples = spark.createDataFrame([("c1", "A.S.A.P"), ("c1", "soon"), ("c2", "asap"), ("c3", "03/04/2024"), ("c3", "13/04/2024"), ("c3", None)], "column_id string, sample string")
    mapped = spark.createDataFrame([("c1", "tier"), ("c1", "tier"), ("c3", "placedDate")], "column_id string, target string")
    assert rows(rulebook.preview_value(samples, mapped, "tier", "asap", "urgent")) == [("c1", "A.S.A.P", "urgent")]
    assert rows(rulebook.preview_dates(samples, mapped, "placedDate", "day_first")) == [("c3", "03/04/2024", "2024-04-03")]
    assert rows(rulebook.preview_dates(samples, mapped, "placedDate", "month_first")) == [("c3", "03/04/2024", "2024-03-04")]
    assert rows(rulebook.preview_dates(samples.limit(0), mapped, "placedDate", "day_first")) == []


def test_teachable_decisions(spark):
    d = spark.createDataFrame([(1, "T", "map", "Buyer"), (2, "T", "reject", "Buyer"), (3, "U", "map", "Buyer"), (4, "T", "map", "date"), (5, "T", None, None)], "n int, type string, action string, header string")
    assert [r["n"] for r in rulebook.generalisable(d, ORDER, ("T",)).orderBy("n").collect()] == [1, 5]
