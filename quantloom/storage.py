"""Tables between two steps of a job, kept in the folder that all executors share.

Such a table cuts lineage and outlives executors.  Those of one application lie in one folder, which
Hadoop's file system deletes when the driver ends; a caller who has written its result deletes
them earlier by ``with scratch():``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 1 << 16
_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session or the context's checkpoint directory names it.

    Where neither is set, a driver whose tasks run beside it (a local master) takes a temporary folder;
    on a cluster that would be out of the executors' reach, so it is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get(FOLDER, None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {FOLDER} to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def expected_bytes(df: DataFrame) -> int:
    """The size of a table as the optimizer expects it, of files as they are stored; 0 where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def materialise(df: DataFrame, by: str | None = None, result: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back; given a column, in buckets, so that grouping by it shuffles nothing.

    A result outlives the scratch() it is written in.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/quantloom-{spark.sparkContext.applicationId}"
    name = uuid.uuid4().hex
    path = f"{root}/{name}"
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(expected_bytes(df) // BUCKET_BYTES, MOST_BUCKETS))
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(f"quantloom_{name}")
        out = spark.table(f"quantloom_{name}")
        out._table = f"quantloom_{name}"
    where, files = file_system(spark, root)
    files.deleteOnExit(where)
    out._written_to = path
    held = _held.get()
    if held is not None and not result:
        held.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote; only for tables that no later plan reads."""
    path = getattr(df, "_written_to", None)
    if path:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        where, files = file_system(df.sparkSession, path)
        files.delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end all that is materialised within but results; what reads it must be written by then."""
    held: list[DataFrame] = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        for df in held:
            discard(df)
