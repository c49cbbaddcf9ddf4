"""A sink that writes each batch of a stream once, whatever restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_once(rows: DataFrame, folder: str, checkpoint: str, also=None) -> DataStreamWriter:
    """A writer of rows as Parquet, a folder for each batch; start it as any other.

    The ledger is the folders themselves: Spark's committer puts _SUCCESS into a batch's folder when all its tasks have ended. A batch that comes
    again is skipped if its folder has it, else written anew over what was left. So a stop at any point, also between the write and
    the checkpoint, loses no row and doubles none. `also`, a function of (batch, number), is called after a batch is in the ledger; if it fails, it is
    called again with the batch's stored rows. One folder belongs to one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{folder}/batch={number}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(path)
        if also:
            also(spark.read.schema(batch.schema).parquet(path), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_once(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all batches in the ledger, with their `batch`; a batch that is being written is left out."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    paths = [f.getPath().getParent().toString() for f in found]
    if not paths:
        return spark.createDataFrame([], schema).selectExpr("*", "cast(null as int) as batch")
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths)
