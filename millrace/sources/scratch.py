"""Working tables in a folder that all executors share; a table's lineage ends where it is written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where neither is set and the master is local, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            root = context.getCheckpointDir().get()
        elif context.master().startswith("local-cluster") or not context.master().startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile. At the end they are removed, but for those taken out of the list.

    Operators return lazily, so their results have to be written or collected before the end.
    """
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        for path in _MADE.pop():
            drop(spark, path)


def write(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: its lineage ends there, lost executors don't matter.

    Where rows are few or short beside what makes them, `by` names a column by which they are sent to files of Spark's advisory size, rather than one for each task.
    """
    df = df.hint("rebalance", by) if by else df
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    return write(df, name, by)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
