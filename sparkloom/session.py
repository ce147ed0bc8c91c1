"""Session helpers: lineage cuts that survive lost executors, and table paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query are deleted when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows that Python gets at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's setting of the files that a task writes at once; up to so many folders, its rows need no sorting by folder.
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="sparkloom-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def _having(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_deleted(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, the shuffle files of a query go when the query ends; a plan that runs again makes them again."""
    return _having(spark, _CLEAN, "true")


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, Python gets 500 rows at once at most, so that whole texts take little memory on both sides."""
    return _having(spark, _BATCH, "500")


def stored(df: DataFrame, into: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Compute ``df`` now into a compressed table in the shared checkpoint folder and read it back.

    The planner sees the table's real size, so estimates do not grow from round to round of a loop. The path is added to
    ``into``; it can be deleted with :func:`dropped`, by the path or by the frame, once nothing reads the table any more.
    Rows of each value of ``by``, the last column, lie in a folder ``by=value`` of their own, which can be deleted by its path.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
    with shuffles_deleted(spark), _having(spark, _OPEN, "8" if by else spark.conf.get(_OPEN)):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    if into is not None:
        into.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage: a stored table."""
    return stored(df)


def dropped(spark: SparkSession, tables: list[str | DataFrame]) -> None:
    """Delete tables that :func:`stored` wrote, given as paths or frames, by the file system they lie in; other frames are left alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for x in tables:
        path = vars(x).get("_stored_at") if isinstance(x, DataFrame) else x
        if path:
            p = hadoop.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    tables.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables that lie as Parquet in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
