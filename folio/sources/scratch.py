"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where none is set, one process gets a folder of its own; a cluster,
    whose executors would not see it, gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends there, so a lost
    executor costs a re-read and not a recomputation. Spark deletes the table when the driver ends, if dropped()
    has not done so before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    again = spark.read.schema(df.schema).parquet(path)
    again._folio_path = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        target, files = _file_system(t.sparkSession, t._folio_path)
        files.delete(target, True)
