"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing on a local master (tests on one machine), a temporary folder takes its place for the rest
    of the application; on a cluster that is an error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder.setdefault(context.applicationId, "")
        if not base:
            base = _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-concord-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it has been written: what follows reads the written table.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an average group of blocks, at most: a task of ``met`` holds the blocks of one group.
GROUP_ROWS = 1 << 18


def group_count(spark: SparkSession, rows: int, asked: int, block_rows: int) -> int:
    """Groups that blocks of ``rows`` rows are dealt over when ``asked`` of the rows meet all: each group gets a copy of what is asked.

    As many copies as hold no more than the rows themselves (or four a core, if more), however many partitions the session has, and
    two a block at most; beyond that only where a group would exceed GROUP_ROWS.
    """
    fair = min(max(4 * spark.sparkContext.defaultParallelism, rows // max(1, asked)), -(-2 * rows // block_rows))
    return max(1, min(partitions(spark), fair), -(-rows // GROUP_ROWS))


def met(blocks: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """Each row of ``asked`` beside each of ``blocks`` (by ``block``). Blocks are dealt out once; what is asked goes to every group.

    Spark sees the size of ``asked`` without its copies, so left alone it may broadcast all of them through the driver; hence the
    merge join. It holds the blocks of one group and streams what is asked past them, one row after the other.
    """
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).repartition(groups, "group")
    copies = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "group")
    return copies.join(dealt.hint("merge"), "group").drop("group")


def file_system(uri: str):
    """pyarrow's file system and path for a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def finite(vector):
    """Whether an array column is there and holds neither null nor non-finite entries; never null."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of an integer column, modulo n (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def tokenizer_path(name: str) -> str:
    """The default place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows that go to a Python worker at once; whole texts can be long, so fewer than Spark's default of 10,000.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS, so a worker's memory is bounded."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df
