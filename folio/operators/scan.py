"""Vector search: a scan over small integers for candidates, exact scores for these, and packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import vectors as vx


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds q and scale, of the normalised vector."""
    rest = [c for c in vectors.columns if c not in (vector, "scale", "q")]
    return vectors.withColumn("_coded", vx.coded(F.col(vector))).select(*rest, F.col("_coded.embedding").alias(vector), "_coded.scale", "_coded.q")


def literal(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def scan(quantized: DataFrame, query: list[float], k: int = 200) -> DataFrame:
    """The k best by the scaled integer product. The plan keeps k rows in each task and merges these."""
    dims = F.assert_true(F.size("q") == len(query), "vectors and query differ in length")
    score = vx.dot_int8(literal(query), F.col("q"), F.col("scale"))
    return quantized.where(dims.isNull()).select("chunk_pk", score.alias("score")).orderBy(F.desc("score"), "chunk_pk").limit(k)


def exact(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return vectors.select("chunk_pk", vx.dot(literal(query), vx.normalize(F.col(vector))).alias("score"))


def rescored(vectors: DataFrame, candidates: DataFrame, query: list[float]) -> DataFrame:
    """Exact scores of the candidates: a bounded list, so the vectors are never shuffled."""
    return exact(vectors.join(F.broadcast(candidates.select("chunk_pk")), "chunk_pk", "left_semi"), query)


def semantic(vectors: DataFrame, query: list[float], candidates: int = 200, min_similarity: float | None = None) -> DataFrame:
    """Windows without a vector are not found."""
    vectors = vectors.where(F.col("embedding").isNotNull())
    found = rescored(vectors, scan(quantized(vectors), query, candidates), query)
    return found if min_similarity is None else found.where(F.col("score") >= min_similarity)


def _stored(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Unit vectors as the index stores them: rounded to float."""
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32).astype(np.float64)


def batch_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_pk, chunk_pk, score): the k best of every query. The queries, a stated set, go out in blocks of `block`;
    each task keeps k a query of what it reads, and a grouped merge ranks these few."""
    spark = vectors.sparkSession
    schema = "query_pk long, chunk_pk long, score double"
    out = None
    pending: list = []

    def send(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, _stored(matrix, norms)))

        def run(batches):
            ids, q = sent.value
            best_id = np.zeros((len(ids), 0), np.int64)
            best = np.zeros((len(ids), 0))
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                score = q @ _stored(x, norm).T
                best = np.hstack([best, score])
                best_id = np.hstack([best_id, np.broadcast_to(b.column(0).to_numpy(), score.shape)])
                order = np.lexsort((best_id, -best), axis=1)[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
            if best.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best_id.ravel()), pa.array(best.ravel())], ["query_pk", "chunk_pk", "score"])

        return vectors.select(F.col("chunk_pk").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, schema)

    for r in queries.select("chunk_pk", "embedding").toLocalIterator():
        pending.append((r[0], r[1]))
        if len(pending) == block:
            part, pending = send(pending), []
            out = part if out is None else out.unionByName(part)
    if pending:
        part = send(pending)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    few = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_pk"))), 1, k)
    return out.groupBy("query_pk").agg(few.alias("top")).select("query_pk", F.explode("top").alias("t")).select("query_pk", "t.chunk_pk", (-F.col("t.s")).alias("score"))


def pack(quantized: DataFrame) -> DataFrame:
    """One row a document: dims, n, keys and scales in order, and the matrix row by row."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_pk", "scale", "q")))
    return quantized.groupBy("doc_pk").agg(rows.alias("rows")).select(
        "doc_pk", F.size(F.col("rows")[0]["q"]).alias("dims"), F.size("rows").alias("n"), F.col("rows.chunk_pk").alias("chunk_pks"), F.transform("rows", lambda r: r["scale"].cast("float")).alias("scales"), F.flatten("rows.q").alias("matrix")
    )


def unpack(packed: DataFrame) -> DataFrame:
    one = F.posexplode("chunk_pks").alias("_i", "chunk_pk")
    return packed.select("*", one).select("doc_pk", "chunk_pk", F.col("scales")[F.col("_i")].alias("scale"), F.slice("matrix", F.col("_i") * F.col("dims") + 1, F.col("dims")).alias("q"))


def backfilled(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The packed blocks, and those of documents that have windows and no block yet (older indexes)."""
    missing = chunks.join(packed.select("doc_pk"), "doc_pk", "left_anti")
    return packed.unionByName(pack(missing).select(*packed.columns))
