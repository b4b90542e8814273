"""Receipts of a stream of deliveries: the first write of an idempotency key wins, for good.

What a key was first written with is state of the stream, kept by key in Spark's state store below the checkpoint; history is
never read again. Answers are written by batch, each batch to a folder of its own that it replaces, so a batch that dies and is
run again leaves one copy. Between them a stream may be killed at any moment and started anew from the same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "key string, pos long, payload_hash string, result string"


def answers(stream: DataFrame) -> DataFrame:
    """key, pos, payload_hash -> the same with result: stored, replay or conflict. Within a batch the least ``pos`` of a new key is
    its first write; a batch's rows of a new key are held until that is known, rows of known keys are streamed."""

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.exists:
            rows = pd.concat(parts).sort_values("pos", kind="stable")
            state.update((rows["payload_hash"].iloc[0],))
            result = rows["payload_hash"].map(lambda h: "replay" if h == rows["payload_hash"].iloc[0] else "conflict")
            result.iloc[0] = "stored"
            yield rows.assign(result=result)[["key", "pos", "payload_hash", "result"]]
            return
        (held,) = state.get
        for part in parts:
            yield part.assign(result=part["payload_hash"].map(lambda h: "replay" if h == held else "conflict"))[["key", "pos", "payload_hash", "result"]]

    return stream.select("key", "pos", "payload_hash").groupBy("key").applyInPandasWithState(decide, RESULT, "payload_hash string", "append", GroupStateTimeout.NoTimeout)


def run_receipts(stream: DataFrame, folder: str, checkpoint: str, around: Callable[[str, int], None] = lambda when, batch: None):
    """Starts a query that answers what has arrived and then ends. ``around`` is called before and after a batch is written."""

    def write(batch: DataFrame, number: int) -> None:
        around("before", number)
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        around("after", number)

    return answers(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipts_of(spark: SparkSession, folder: str) -> DataFrame:
    """All answers, with the batch that gave them."""
    return spark.read.option("basePath", folder).schema(f"{RESULT}, batch long").parquet(folder)


def find_receipt(receipts: DataFrame, key: str) -> DataFrame:
    """The stored receipt of a key."""
    return receipts.filter((F.col("key") == key) & (F.col("result") == "stored"))
