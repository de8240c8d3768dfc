"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a handful of grouped minima and equality joins, so no task holds the neighbours of a node:
minima combine before the shuffle, and the joins are of the kind whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import dropped, written


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, total or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: two long columns. Returns (node, root) for each node with an edge to another; root is the smallest
    node reachable. Loops, repeated edges and nulls in the input are dropped; an empty input gives no rows."""
    # u < v throughout
    e = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        # large-star: the larger neighbours of x move to the least of x and its neighbours
        low = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        large = e.join(low, e.u == low.x, "left").select(F.coalesce("m", "u").alias("u"), "v").distinct()
        # small-star: x and its smaller neighbours move to the least of these
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        both = large.join(low, large.v == low.x)
        small = both.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("x").alias("v")))).alias("p")).select("p.u", "p.v")
        spent, e = e, written(small.where("u != v").distinct(), "edges")
        dropped(spent)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
