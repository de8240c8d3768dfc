"""Vector functions as Column expressions: sums in double, stored values as float or tinyint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length: zip_with fills up with nulls, which count 0."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def normalize(v: Column) -> Column:
    """Length 1 as float; a zero vector stays as it is."""
    bound = F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))
    return let(bound, lambda b: F.transform(b["v"], lambda x: (x.cast("double") / F.when(b["n"] > 0, b["n"]).otherwise(1.0)).cast("float")))


def scale(v: Column) -> Column:
    """Largest magnitude over 127; 1 for a zero vector."""
    most = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    return let(most, lambda m: F.when(m > 0, m / 127).otherwise(1.0))


def quantize(v: Column, by: Column) -> Column:
    """Halves round up, as floor(x + 0.5) does and round() does not."""
    bound = F.struct(v.alias("v"), by.alias("s"))
    return let(bound, lambda b: F.transform(b["v"], lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / b["s"] + 0.5))).cast("tinyint")))


def coded(v: Column) -> Column:
    """A struct of the unit vector, its scale and its small integers, each worked out once."""
    with_scale = let(normalize(v), lambda u: F.struct(u.alias("u"), scale(u).alias("s")))
    return let(with_scale, lambda b: F.struct(b["u"].alias("embedding"), b["s"].alias("scale"), quantize(b["u"], b["s"]).alias("q")))


def dot_int8(query: Column, q: Column, by: Column) -> Column:
    return dot(query, q) * by


def rounded(value: Column, digits: int) -> Column:
    """Halves up."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def int8_hex(q: Column) -> Column:
    """Two upper-case hex digits a component."""
    return F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256)).cast("long")), 2, "0")), "")


def int8_from_hex(text: Column) -> Column:
    part = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    n = (F.length(text) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(part(i) > 127, part(i) - 256).otherwise(part(i)).cast("tinyint"))).otherwise(F.array().cast("array<tinyint>"))


def valid_response(vectors: Column, expected: Column) -> Column:
    """As many vectors as asked for, of one length above 0, all components finite."""
    first = F.size(vectors[0])
    return F.coalesce((F.size(vectors) == expected) & (first > 0) & F.forall(vectors, lambda v: (F.size(v) == first) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))), F.lit(False))
