"""Building, replacing and reading an index: windows, terms, vectors and the status of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.config import EngineConfig
from folio.functions import text as tx
from folio.operators import clean, prepare, ranking, scan
from folio.operators.providers import EmbeddingError, retried
from folio.sources.scratch import written
from folio.sources.tables import numbered

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dims: int = 64, model: str = "hashed-words") -> Embedder:
    """A stand-in for an embedding model that needs no network: each word of four letters or digits and more adds 1 to
    the dimension its hash names, the model's name one half."""
    import re
    import zlib

    word = re.compile(r"[^\W_]{4,}")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            row[zlib.crc32(model.encode()) % dims] += 0.5
            for w in word.findall(text.lower()):
                row[zlib.crc32(w.encode()) % dims] += 1
        return out

    return embed


def checked(vectors: np.ndarray, expected: int) -> np.ndarray:
    """What an embedder returned, or an error: count, one length above 0, finite."""
    v = np.asarray(vectors, dtype=np.float64)
    if v.ndim != 2 or len(v) != expected or (expected and v.shape[1] == 0):
        raise ValueError(f"expected {expected} vectors of one length")
    if not np.isfinite(v).all():
        raise ValueError("a vector has a component that is not finite")
    return v


def embed(windows: DataFrame, make: Callable[[], Embedder], batch: int = 32, errors: bool = False) -> DataFrame:
    """Adds embedding. The embedder is made once a task and gets `batch` texts at a time. Trouble with the service stops
    the run. With errors, also adds error: a batch that fails otherwise is tried text by text, and a text that still fails
    has a null vector and the reason, so that a broken document fails alone."""
    columns = windows.columns
    at = columns.index("embed_text")
    schema = T.StructType([*windows.schema, T.StructField("embedding", T.ArrayType(T.FloatType())), *([T.StructField("error", T.StringType())] if errors else [])])

    def unit(model: Embedder, texts: list[str]) -> list:
        got = checked(retried(lambda: model(texts)), len(texts))
        norm = np.linalg.norm(got, axis=1, keepdims=True)
        return list((got / np.where(norm > 0, norm, 1)).astype(np.float32))

    def alone(model: Embedder, text: str) -> tuple:
        try:
            return unit(model, [text])[0], None
        except (ConnectionError, TimeoutError, EmbeddingError):
            raise
        except Exception as e:  # whatever the embedder makes of this text
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(at).to_pylist()
                try:
                    vectors, failed = unit(model, texts), [None] * len(texts)
                except (ConnectionError, TimeoutError, EmbeddingError):
                    raise
                except Exception:
                    if not errors:
                        raise
                    vectors, failed = zip(*(alone(model, t) for t in texts), strict=True)
                more = [pa.array(failed, pa.string())] if errors else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), *more], schema.names)

    return windows.mapInArrow(run, schema)


def build(pages: DataFrame, titles: DataFrame, config: EngineConfig | None = None, make: Callable[[], Embedder] = hashed_words) -> dict[str, DataFrame]:
    """pages: doc_pk, page, text; titles: doc_pk, title. The tables of an index, written where tables feed others."""
    config = config or EngineConfig()
    routed = written(clean.clean_pages(pages), "routed")
    cut = numbered(prepare.windows(routed, config), "doc_pk", "idx")
    named = cut.join(titles, "doc_pk", "left")
    ready = named.withColumn("embed_text", tx.embedding_text(F.col("title"), F.col("chapter"), F.col("text"), config.doc_prefix)).drop("title")
    indexed_text = F.concat_ws(" ", "chapter", "text")
    with_terms = ready.withColumn("nterms", F.size(tx.term_keys(indexed_text)))
    chunks = written(scan.quantized(embed(with_terms, make, config.batch_size)).drop("embed_text"), "chunks")
    terms = ranking.postings(chunks.withColumn("indexed", indexed_text), "indexed")
    pages_out = routed.select("doc_pk", "page", F.col("stripped").alias("text"))
    return {"chunks": chunks, "terms": terms, "pages": pages_out, "outline": prepare.outlines(routed), "doc_vectors": scan.pack(chunks), "failed": prepare.without_text(pages)}


#: Parts of a saved table; a document's rows are in one of them.
BUCKETS = 64


def _bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_pk"), F.lit(buckets)).cast("int"))


def save(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Tables with doc_pk are partitioned by a bucket of it, so that a document can be replaced in its bucket; terms, which
    have chunk_pk only, get it from the chunks."""
    for name, df in tables.items():
        if "doc_pk" not in df.columns and "chunk_pk" in df.columns:
            df = df.join(tables["chunks"].select("chunk_pk", "doc_pk"), "chunk_pk")
        out = _bucket(df, buckets).repartition("bucket").write.partitionBy("bucket") if "doc_pk" in df.columns else df.write
        out.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = ("chunks", "terms", "pages", "outline", "doc_vectors")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("bucket") for n in names}


def replace_saved(spark: SparkSession, path: str, fresh: dict[str, DataFrame], keys: DataFrame, buckets: int = BUCKETS) -> None:
    """Puts the fresh rows of the documents in keys (which may have none: they are deleted) in place of the saved ones. Only
    the buckets of these documents are read and written, by a dynamic overwrite of partitions."""
    gone = written(_bucket(keys.select("doc_pk").distinct(), buckets), "keys")
    touched = [r.bucket for r in gone.select("bucket").distinct().collect()]  # BUCKETS at most
    for name, df in fresh.items():
        if "doc_pk" not in df.columns:
            df = df.join(fresh["chunks"].select("chunk_pk", "doc_pk"), "chunk_pk")
        stored = spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(touched))
        left = stored.join(gone.select("doc_pk"), "doc_pk", "left_anti").unionByName(_bucket(df, buckets).select(*stored.columns))
        whole = written(left, name)
        # a bucket that loses its last row has no partition to overwrite it with
        empty = set(touched) - {r.bucket for r in whole.select("bucket").distinct().collect()}
        whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
        for b in empty:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/bucket={b}")
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def replace(stored: DataFrame, fresh: DataFrame, key: str = "doc_pk") -> DataFrame:
    """The stored rows of all other documents, and the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete(stored: DataFrame, gone: DataFrame, key: str = "doc_pk") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def delete_documents(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the documents that are gone; what stood for one of them no longer does."""
    keys = gone.select("doc_pk").distinct()
    left = delete(documents, keys)
    lost = keys.select(F.col("doc_pk").alias("duplicate_of"), F.lit(True).alias("_lost"))
    return left.join(lost, "duplicate_of", "left").withColumn("duplicate_of", F.when(F.col("_lost").isNull(), F.col("duplicate_of"))).drop("_lost").select(*documents.columns)


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "doc_pk") -> DataFrame:
    """Fresh rows over stored ones; a document known before keeps its status, a new one is queued."""
    before = stored.select(key, F.col("status").alias("_status"))
    merged = fresh.join(before, key, "left").withColumn("status", F.coalesce("_status", F.lit("queued"))).drop("_status")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(merged.select(*stored.columns))


def settle(documents: DataFrame, results: DataFrame) -> DataFrame:
    """results: doc_pk, content_hash, status, error. A document takes its result only if its hash is still the one that
    was worked on; else it stays in the queue."""
    r = results.select("doc_pk", F.col("content_hash").alias("_hash"), F.col("status").alias("_status"), F.col("error").alias("_error"))
    fits = F.col("_hash").isNotNull() & (F.col("_hash") == F.col("content_hash"))
    return documents.join(r, "doc_pk", "left").withColumn("error", F.when(fits, F.col("_error")).otherwise(F.col("error"))).withColumn("status", F.when(fits, F.col("_status")).when(F.col("_hash").isNotNull(), "queued").otherwise(F.col("status"))).select(*documents.columns)


def outcomes(documents: DataFrame, results: DataFrame) -> DataFrame:
    """results: doc_pk, content_hash, error, stopped. What becomes of documents that were worked on: ready, or failed with
    their own error; those that a pause or trouble with the service stopped go back to the queue, without error."""
    status = F.when(F.col("stopped"), "queued").when(F.col("error").isNotNull(), "failed").otherwise("ready")
    own = F.when(~F.col("stopped"), F.col("error"))
    return settle(documents, results.select("doc_pk", "content_hash", status.alias("status"), own.alias("error")))


def decide_again(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """changed: books (library_key, item_key) of which a document is new, changed or gone. Their duplicates go back to the
    queue: what they stand for may no longer hold."""
    touched = changed.select("library_key", "item_key").distinct().withColumn("_changed", F.lit(True))
    again = F.col("_changed").isNotNull() & (F.col("status") == "duplicate")
    return documents.join(touched, ["library_key", "item_key"], "left").withColumn("status", F.when(again, "queued").otherwise(F.col("status"))).select(*documents.columns)


def requeue(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Forgets the hashes of these documents, so that they are indexed again."""
    marked = keys.select("doc_pk").distinct().withColumn("_again", F.lit(True))
    again = F.col("_again").isNotNull()
    return documents.join(marked, "doc_pk", "left").withColumn("content_hash", F.when(~again, F.col("content_hash"))).withColumn("status", F.when(again, "queued").otherwise(F.col("status"))).select(*documents.columns)


def compatible(meta: dict[str, str], config: EngineConfig) -> bool:
    """Whether a stored index was built with these settings."""
    return meta.get("index_config") == config.fingerprint()
