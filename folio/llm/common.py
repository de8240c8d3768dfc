"""What the corpus operators share: table access, written intermediates, words, keys and joins with hot keys."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.scratch import dropped, shared_dir, written
from folio.sources.tables import table

__all__ = ["HEAVY", "WHITE", "built", "dropped", "fold", "fold_of", "met", "row_hash", "shared_dir", "shipped", "table", "words_of", "written"]

WHITE = " \t\n\v\f\r"
#: A key is heavy if it has at least this part of all rows; so there are at most as many heavy keys.
HEAVY = 10_000


def words_of(text: str | None) -> list[bytes]:
    """The matches of [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() parts at just these six characters."""
    return text.encode().split() if text else []


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; a null id belongs to fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def fold_of(doc_id: int | None, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds if doc_id is not None else 0


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of all columns together; a null differs from every value, in whichever column it stands."""
    parts = []
    for f in df.schema.fields:
        value = df[f"`{f.name}`"]
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in f.dataType.simpleString() else value]
    return F.xxhash64(F.lit(seed), *parts)


def met(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """Inner join of rows with a written table that has each key once and, in `count`, the key's number of rows; total:
    the number of all rows. Keys with a `heavy`-th of them or more are `heavy` at most: these are broadcast, so that
    their rows stay where they are; all others are met by a shuffle in which no key is large."""
    hot = F.broadcast(table.where(F.col(count) * heavy >= total))
    rest = table.where(F.col(count) * heavy < total)
    light = rows.join(F.broadcast(table.where(F.col(count) * heavy >= total).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(light.join(rest, on))


def shipped(spark: SparkSession, path: str):
    """A small file of the driver's (a vocabulary) as a broadcast of its bytes: workers need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_built: dict[int, tuple] = {}


def built(sent, make):
    """What make() builds from a broadcast value, once in each Python worker; the last one is kept."""
    value = sent.value
    got = _built.get(id(value))
    if got is None or got[0] is not value:
        _built.clear()
        got = _built[id(value)] = (value, make(value))
    return got[1]
