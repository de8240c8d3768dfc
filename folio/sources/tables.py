"""The index tables as views of parquet tables, and readers for raw inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What spread() moves at most.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy on each row: a table of SPREAD_BYTES at most that is read in fewer parts than there are cores
    (one small file with one row group can't be split) is dealt out to all of them. Any larger table is left as it is
    read, so that no more than this bound is ever moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df


def split_pages(files: DataFrame, text: str = "text") -> DataFrame:
    """One row a page of form-feed separated texts: page from 1, text trimmed; a trailing form feed leaves an empty page."""
    parts = F.posexplode(F.split(F.col(text), "\f")).alias("_pos", "_page")
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, parts).select(*rest, (F.col("_pos") + 1).alias("page"), tx.stripped(F.col("_page")).alias("text"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of each file's content; size and time where the content can't be had."""
    files = spark.read.format("binaryFile").load(path)
    fallback = F.concat_ws(":", F.lit("stat"), F.col("length"), F.unix_millis("modificationTime"))
    return files.select("path", F.coalesce(F.md5("content"), fallback).alias("content_hash"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its book, status and content hash."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("queued")
    library = F.when(F.col("lang") == "en", "user").otherwise(F.concat(F.lit("group:"), F.when(F.col("lang") == "de", 1).when(F.col("lang") == "es", 2).otherwise(3).cast("string")))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("doc_pk"), library.alias("library_key"), F.concat_ws("-", "lang", "source").alias("item_key"), F.concat(F.lit("A"), F.col("doc_id")).alias("attachment_key"),
        F.md5("text").alias("content_hash"), status.alias("status"), F.col("lang").alias("language"), "text",
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a language and source."""
    return documents(spark, sf_dir).select("library_key", "item_key", "language").distinct()


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_pk"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc_pk"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_pk", (F.col("pos") + 1).cast("int").alias("page"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window a document, for the keyword queries."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_pk"), F.col("doc_id").alias("doc_pk"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten windows a document in the order of vec_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pk"), F.floor(F.col("vec_id") / 10).cast("long").alias("doc_pk"), (F.col("vec_id") % 10).cast("int").alias("idx"), "embedding")


def numbered(df: DataFrame, *order: str, start: int = 0, name: str = "chunk_pk") -> DataFrame:
    """Consecutive keys in the given order, without one task holding all rows: a range partitioning, the partitions'
    sizes, then a running number in each partition."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(before, "_part").withColumn(name, F.col("_before") + nth + start).drop("_part", "_before")
