"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, mixing, quality, secrets, simhash
from folio.llm.common import row_hash, table, written
from folio.llm.queries import vocabulary
from folio.sources.tables import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; a document without text is rejected."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: that with the smallest id, rows without one last; among rows that repeat this id,
    that with the smallest hash of the whole row. Rows that are equal throughout count as one."""
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), row_hash(docs, 1).alias("row_a"), row_hash(docs, 2).alias("row_b"))
    row = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), "doc.doc_id", "row_a", "row_b").alias("row")
    prints = written(simhash.fingerprints(keyed.select(row, F.col("doc.text").alias("text")), "row"), "prints")
    stays = simhash.groups(prints, id_col="row").select("component_id.row_a", "component_id.row_b").distinct()
    return keyed.join(stays, ["row_a", "row_b"], "left_semi").dropDuplicates(["row_a", "row_b"]).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; a mark replaces each secret in the text, and n_chars counts the new text."""
    return secrets.redact(docs, vocabulary("byte_bpe_50k.tiktoken")[0])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: none to three times."""
    return mixing.resample(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return bpe.encode(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
    ("byte-level BPE", bpe_tokens),
]

#: SimHash groups need transitive closure and the mix draws a sample: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
