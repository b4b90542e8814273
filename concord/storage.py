"""Tables that cut a lineage: written where driver and executors can read them, so a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset on a local master (tests), one below /tmp for the rest
    of the application; on a cluster that is an error, as executors would not see a folder of the driver's machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="spark-concord-", dir="/tmp")
        _own_folder[context.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """A written copy of ``df``, marked for broadcasting if it has at most ``most`` rows, and how many it has."""
    from pyspark.sql import functions as F

    held = materialise(df, "few")
    n = held.count()
    return (F.broadcast(held) if n <= most else held), n
