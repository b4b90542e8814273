"""Steps that read all they should and do their work once."""

from pyspark.sql import functions as F

from concord.contract import EMPLOYEE, ORDER
from concord.operators import rulebook, validate
from concord.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_spelling_index_holds_every_spelling(spark):
    found = QUERIES["spelling_index_employee"](spark, DATA).collect()
    assert {r["spelling"]: r["targets"].split(",") for r in found} == {s: sorted(names) for s, names in EMPLOYEE.spelling_index().items()}
    assert any(r["column_id"] for r in found) and any(r["column_id"] is None for r in found)


def _records(spark, n=40):
    made = {"orderRef": F.concat(F.lit("O-"), F.col("id")), "customerEmail": F.lit(" A@X.COM "), "placedDate": F.lit("5 March 2024"), "shippedDate": F.lit(None).cast("string"), "tier": F.lit("low")}
    return spark.range(n).select(F.col("id").cast("string").alias("id"), *[c.alias(k) for k, c in made.items()])


def test_filters_do_not_repeat_validation(spark):
    v = validate.two_pass(_records(spark), ORDER)
    for out in (v.filter("disposition = 'ready'").select("id"), v.select("id", F.explode("repairs").alias("r")).select("id", "r.*"), v.filter("size(errors) > 0").select("id", "errors")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("[a-z]{3,9}") <= 4  # two dates, one expression with two such parts each
    assert v.filter("disposition = 'ready'").count() == 40


def test_crowds_of_one_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(rulebook, "CROWD", 50)
    monkeypatch.setattr(rulebook, "MOST_TEXTS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("R-"), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, F.lit("odd")).when(F.col("id") % 4 == 2, F.lit("ruled")).otherwise(F.lit(""))
        rows = spark.range(4000).select("id", text.alias("t_tier"))
        rules = spark.range(4000).select(F.lit("tier").alias("field"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("term"), F.lit("low").alias("canonical"))
        rules = rules.union(spark.createDataFrame([("tier", "ruled", "high"), ("tier", "r4", "nothing")], "field string, term string, canonical string"))
        out = rulebook.learned_texts(rows, ORDER, rules).withColumn("_p", F.spark_partition_id())
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = out.collect()
        assert len(got) == 4000
        assert all(r["l_tier"] == {0: "low", 2: "high"}.get(r["id"] % 4) for r in got)
        sizes = [sum(r["_p"] == p for r in got) for p in {r["_p"] for r in got}]
        assert len(sizes) == 4 and max(sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
