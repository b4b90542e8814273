"""Payloads in canonical JSON, and receipts of a stream that is killed and started again."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from concord.contract import ORDER
from concord.operators import deliver


def test_json_strings(spark):
    r = random.Random(4)
    alphabet = [*map(chr, range(0, 130)), "é", "日", "\u2028", "\ufeff", "😀", "𝄞", "\uffff", '"', "\\\\", "/", "$1", "\\u0041"]
    texts = ["", "plain", *("".join(r.choice(alphabet) for _ in range(r.randrange(20))) for _ in range(400)), "".join(alphabet)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", deliver.json_string(F.col("t")).alias("j"))
    assert {x["i"]: x["j"] for x in df.collect()} == {i: json.dumps(t) for i, t in enumerate(texts)}
    assert spark.sql("select cast(null as string) t").select(deliver.json_string(F.col("t"))).first()[0] is None


def test_payload_hash_is_that_of_a_plain_dump(spark):
    names = [f.name for f in ORDER.fields]
    rows = [("A-é", "x@日.de", None, "", "low"), ("B\n", "😀", "2024-01-01", None, 'q"'), (None,) * 5]
    got = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(deliver.payload_hash(ORDER), deliver.payload(ORDER)).collect()
    for row, (digest, sent) in zip(rows, got):
        filled = {n: v for n, v in zip(names, row) if v}
        assert digest == hashlib.sha256(json.dumps(filled, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
        assert json.loads(sent) == filled and list(json.loads(sent)) == list(filled)


@pytest.mark.parametrize("dies", ["before", "after"])
def test_no_receipt_is_written_twice(spark, tmp_path, dies):
    """The stream dies in its second batch, before or after that batch's receipts were written, and is started again."""
    from concord.streaming.receipts import receipts_of, run_receipts

    schema = "key string, payload_hash string, pos long"
    r = random.Random(1)
    rows = [(f"k{r.randrange(12)}", f"h{r.randrange(2)}", i) for i in range(90)] + [("hot", f"h{i % 2}", 90 + i) for i in range(60)]
    r.shuffle(rows)
    batches = [rows[:50], rows[50:100], rows[100:]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def die(when, batch):
        if batch == 1 and when == dies:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run_receipts(stream(), str(tmp_path / "out"), str(tmp_path / "state"), die).awaitTermination()
    run_receipts(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = receipts_of(spark, str(tmp_path / "out")).collect()
    assert len(got) == len(rows) == len({x["pos"] for x in got})
    held, by_batch = {}, {}
    for x in got:
        by_batch.setdefault(x["batch"], []).append(x)
    payload = {pos: h for _, h, pos in rows}
    for batch in sorted(by_batch):
        for x in sorted(by_batch[batch], key=lambda x: x["pos"]):
            want = "stored" if x["key"] not in held else "replay" if held[x["key"]] == payload[x["pos"]] else "conflict"
            held.setdefault(x["key"], payload[x["pos"]])
            assert x["result"] == want
    assert sum(x["result"] == "stored" for x in got) == len(held) == len({k for k, *_ in rows})
