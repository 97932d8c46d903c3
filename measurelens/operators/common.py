"""Small helpers shared by the operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate (always exactly one row)."""
    return df.join(F.broadcast(one_row))


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir.

    Where neither is set, a session in one process (local mode, as in tests) gets
    a temporary folder; on a cluster that is an error, since executors would
    write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def settle(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write a frame that several branches read, and read it back; with ``rows`` no file holds more of them.

    A written table survives lost executors, cuts the lineage, and lets every
    branch read its own columns instead of computing the frame again.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/measurelens-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(spark, value) -> Callable:
    """Broadcast a value of checked size with its classes; the result is called in a task to get it there."""
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(box.value)


def shared_elements(a: Column, b: Column) -> Column:
    """Whether two sets share an element; empty or null sets share nothing."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def stack_rows(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn each input row into several rows given as column dictionaries."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def row_fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, spread: Sequence[str]) -> DataFrame:
    """The first k rows per key in ``order``, ranked within chunks before the key as a whole.

    No task ranks more than a chunk of a crowded key, or k rows per chunk.
    """
    keys = list(keys)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.lit(256)))
    head = chunked.withColumn("_place", rank(*keys, "_chunk")).where(F.col("_place") <= k)
    group = keys or [F.lit(0)]
    return head.withColumn("_place", rank(*group)).where(F.col("_place") <= k).drop("_chunk")
