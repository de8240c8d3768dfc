"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is its rate. Every document is taken floor(rate) times, and once more with the
rate's fraction as inclusion probability. The flight phase moves these probabilities along the null space of
two balancing constraints, the token total and the document total of the source, until a unit is in or out: first the
LARGE largest of a block, each against all others, then three at a time; LEFT units at most are left over. The landing phase draws one of the few choices that are left, from the distribution
that keeps every unit's inclusion probability and, by linear programming, is nearest to both totals on average.

Documents alike in id, source and size (and text, where rows are resampled) are one unit with a number of copies. Units
fly in blocks of bounded size: copies are cut into pieces of PIECE, pieces are dealt by a hash, half a block each on
average, so that equal rows are spread as well. The leftovers of all blocks of a source fly again, level after level,
until one block is left, which lands. Sources are numbered and weighed as a table; the driver holds totals only.

Defined cases: sources go by code point and null, a source of its own, comes last; a null text has size 0 and
is never taken; a source without words has target 0; repeated rows are units of their own; a null id is a unit
too; other input columns are dropped by mix() and kept by resample(); an empty table gives no rows. The same
rows give the same result, whatever their order or partitioning: the moves of a block come from a hash and a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import HEAVY, met, row_hash, written
from folio.sources.tables import numbered

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK, PIECE = 4096, 64
LARGE, LEFT, PIVOTS = 128, 14, 400
EPS = 1e-9


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Shares of all sizes by weight (repeating), none above cap times its size; the excess goes to the others by
    weight, again and again. sizes: of the sources, in their order."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]

    def sums(unit: float) -> tuple[float, float]:
        over = [unit * w > cap * n for n, w in zip(sizes, weight, strict=True)]
        return sum(cap * n for n, x in zip(sizes, over, strict=True) if x), sum(w for w, x in zip(weight, over, strict=True) if not x)

    unit = _unit(float(sum(sizes)), sums)
    return [min(unit * w, float(cap * n)) for n, w in zip(sizes, weight, strict=True)]


def _unit(total: float, sums) -> float:
    """What a weight of 1 gets. sums(unit): the total of the sources that this brings to their limit, and the weights of
    the others. Each round brings more of them there, so that the unit only grows."""
    unit, before = 0.0, -1.0
    while unit != before:
        fixed, free = sums(unit)
        if not free:
            break
        before, unit = unit, (total - fixed) / free
    return unit


def _draw(seed: int, step: int) -> float:
    """A number in [0, 1) that depends on seed and step only."""
    x = (seed * 0x9E3779B97F4A7C15 + step * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) / 2**64


def _large(p: np.ndarray, size: np.ndarray, seed: int) -> None:
    """The largest units first, each in or out at once: what it gains or loses against its expectation is spread over all
    the others, the small ones above all, so that none of them moves far."""
    step = 0
    for i in [i for i in np.lexsort((np.arange(len(p)), -size)) if EPS < p[i] < 1 - EPS][:LARGE]:
        while EPS < p[i] < 1 - EPS:
            others = np.flatnonzero((p > EPS) & (p < 1 - EPS))
            others = others[others != i]
            s, w = size[others], p[others] * (1 - p[others])
            if len(others) < LEFT:
                return
            w /= s + s.mean() + 1
            a, b, c = w.sum(), (w * s).sum(), (w * s * s).sum()
            if a * c - b * b <= 1e-9 * a * c:
                return  # all of one size
            # orthogonal to (1, 1, ...) and to the sizes
            u = np.append(w * ((b * size[i] - c) + (b - a * size[i]) * s) / (a * c - b * b), 1.0)
            at = np.append(others, i)
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p[at]) / u, np.where(u < 0, p[at] / -u, np.inf)).min()
                down = np.where(u > 0, p[at] / u, np.where(u < 0, (1 - p[at]) / -u, np.inf)).min()
            by = up if _draw(seed, (1 << 41) + step) * (up + down) < down else -down
            step += 1
            moved = np.clip(p[at] + by * u, 0, 1)
            p[at] = np.where((moved > EPS) & (moved < 1 - EPS), moved, moved.round())


def flight(p: list[float], sizes: list[float], seed: int, leave: int = LEFT) -> list[float]:
    """Moves the probabilities until at most `leave` (two or more) are fractional: two that cannot move, and some that
    keep theirs for the landing, which needs a choice of sizes. Sums of p and of p * size stay as they are, and so does
    every unit's expectation."""
    moved = np.array(p, float)
    _large(moved, np.array(sizes, float), seed)
    p = moved.tolist()
    open_ = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    by_size = sorted(open_, key=lambda i: (-sizes[i], i))
    spared = {by_size[min(len(open_) - 1, len(open_) * j // (leave - 1))] for j in range(1, min(leave - 1, len(open_) + 1))}
    moving = [i for i in open_ if i not in spared]
    scale = max(max(sizes, default=0), 1)
    s = [x / scale for x in sizes]
    held: list[int] = []
    for i in moving:
        held.append(i)
        step = 0
        while len(held) == 3:
            a, b, c = held
            # orthogonal to (1, 1, 1) and to the sizes
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if max(map(abs, u)) < 1e-12:
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u, strict=True) if v)
            by = up if _draw(seed, 3 * i + step) * (up + down) < down else -down
            step += 1
            kept = []
            for k, v in zip(held, u, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + by * v))
                if EPS < p[k] < 1 - EPS:
                    kept.append(k)
                else:
                    p[k] = float(round(p[k]))
            held = kept
    return p


def landing(p: list[float], sizes: list[float], seed: int) -> list[float]:
    """The few last fractional units, in or out. Of the distributions over their choices that keep each unit's
    probability, a linear programme finds the one with the least expected distance from the token total, choices off the
    document total by more than one being dear; one choice is drawn from it. Every step of the simplex method is such a
    distribution, the first one being that of nested choices, so that a bound on the steps costs nearness only."""
    p, open_ = list(p), [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    share, size = np.array([p[i] for i in open_]), np.array([sizes[i] for i in open_])
    k = len(open_)
    choice = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(float)
    cost = np.abs(choice @ size - share @ size) / max(1.0, size.sum()) if k else np.zeros(1)
    cost[np.abs(choice.sum(1) - share.sum()) >= 1] += 4.0
    columns = np.hstack([choice, np.ones((1 << k, 1))])
    order = np.argsort(-share, kind="stable")
    basis = np.concatenate([[0], np.cumsum(1 << order)]).astype(np.int64)
    need = np.append(share, 1.0)
    weight = -np.diff(np.concatenate([[1.0], share[order], [0.0]]))
    for _ in range(PIVOTS):
        square = columns[basis].T
        gain = cost - columns @ np.linalg.solve(square.T, cost[basis])
        new = int(np.argmin(gain))
        if gain[new] > -1e-12:
            break
        step = np.linalg.solve(square, columns[new])
        falls = np.flatnonzero(step > 1e-9)
        out = int(falls[np.argmin(np.maximum(weight[falls], 0) / step[falls])])
        basis[out] = new
        weight = np.linalg.solve(columns[basis].T, need)
    kept = np.argsort(basis)
    reached = np.cumsum(np.maximum(weight[kept], 0))
    drawn = basis[kept[min(int(np.searchsorted(reached, _draw(seed, 1 << 40) * reached[-1], side="right")), k)]]
    p = [float(round(x)) for x in p]
    for j, i in enumerate(open_):
        p[i] = float(drawn >> j & 1)
    return p


_SCHEMA = "src long, block long, id {kind}, tag long, piece long, size long, source_size long, target double, whole int, p double, copies int"


def _fly(last: bool, seed: int):
    """One block of one source. Copies that end alike stay together."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("order", "id", "tag", "size", "piece", "p")]).drop_columns(["order"])
        at = np.repeat(np.arange(rows.num_rows), rows["copies"].to_numpy())
        p, sizes = rows["p"].to_numpy()[at].tolist(), rows["size"].to_numpy()[at].astype(float).tolist()
        key = ((seed << 20) + rows["src"][0].as_py() + 1) * 1_000_003 + rows["block"][0].as_py()
        p = flight(p, sizes, key)
        if last:
            p = landing(p, sizes, key)
        alike, copies = np.unique(np.column_stack([at, np.array(p)]), axis=0, return_counts=True)
        out = rows.take(pa.array(alike[:, 0].astype(np.int64)))
        for name, value in (("p", pa.array(alike[:, 1])), ("copies", pa.array(copies.astype(np.int32)))):
            out = out.set_column(out.schema.get_field_index(name), name, value)
        return out

    return run


def _key(source: Column) -> Column:
    """Null apart from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sources(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """units: rows (key, size, copies). One row a source: key, src (its number), source_size, docs, target, rate, blocks.
    A table like any other; the driver sees one row of totals a round."""
    per = units.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    # every key but that of null begins with s
    placed = numbered(per.withColumn("last", F.col("key") == "n"), "last", "key", start=-1, name="src").drop("last")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    table = written(placed.withColumn("weight", weight), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)

    def sums(unit: float) -> tuple[float, float]:
        over = F.lit(unit) * F.col("weight") > F.lit(cap) * F.col("source_size")
        fixed, free = table.agg(F.sum(F.when(over, F.lit(cap) * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        return float(fixed or 0), float(free or 0)

    goal = F.least(F.lit(_unit(total, sums)) * F.col("weight"), F.lit(float(cap)) * F.col("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.withColumn("target", goal).withColumn("rate", rate).withColumn("blocks", F.ceil(F.col("docs") / F.lit(max(1, block // 2)))).drop("weight")


def _dealt(units: DataFrame, piece: int) -> DataFrame:
    """Copies in pieces, in two steps, so that no row holds a long list."""
    big = piece << 10
    parts = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size)))
    far = units.withColumn("_big", parts(F.col("copies"), big)).withColumn("copies", F.least(F.lit(big), F.col("copies") - F.col("_big") * big))
    near = far.withColumn("_small", parts(F.col("copies"), piece)).withColumn("copies", F.least(F.lit(piece), F.col("copies") - F.col("_small") * piece).cast("int"))
    return near.withColumn("piece", F.col("_big") * 1024 + F.col("_small")).drop("_big", "_small")


def _blocks(units: DataFrame, plan: DataFrame, total: int, block: int) -> DataFrame:
    """Pieces of copies with their source's number and a block of it."""
    whole = F.floor(F.col("rate") + EPS).cast("int")
    pieces = _dealt(met(units, plan, ["key"], "docs", total), max(1, min(PIECE, block // 8)))
    to = F.pmod(F.xxhash64(F.lit(7), "id", "tag", "size", "piece"), F.col("blocks")).alias("block")
    return pieces.select("src", to, "id", "tag", "piece", "size", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), "copies")


def _mixed(units: DataFrame, weights: tuple[float, ...], cap: float, block: int, seed: int) -> tuple[DataFrame, int]:
    """units: written rows (id, tag, key, size, copies), each kind once. Returns these in parts, with source_size, target
    and times, and the number of all copies."""
    schema = _SCHEMA.format(kind=units.schema["id"].dataType.simpleString())
    plan = sources(units, weights, cap, block)  # a projection of a written table
    total, most = plan.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    order = F.xxhash64("id", "tag", "size")
    rows = _blocks(units, plan, total, block)
    level, done = 0, []
    while True:
        last = level > 0 and most == 1
        flown = written(rows.withColumn("order", order).groupBy("src", "block").applyInArrow(_fly(last, seed), schema), f"flight{level}")
        if last:
            done.append(flown)
            break
        done.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)))
        joined = max(1, block // (2 * LEFT))
        rows = flown.where((F.col("p") != 0) & (F.col("p") != 1)).withColumn("block", F.floor(F.col("block") / joined))
        most, level = math.ceil(most / joined), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "tag", "size", "source_size", "target", "copies", (F.col("whole") + F.col("p").cast("int")).cast("long").alias("times")), total


def _units(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("id", "tag", "key", "size").agg(F.count("*").alias("copies")), "units")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row: the id, size, source_size, target (its source's), times and taken (size * times)."""
    units = _units(docs.select(docs[id_col].alias("id"), F.lit(0).cast("long").alias("tag"), _key(docs[source_col]).alias("key"), _sizes(docs[text_col]).alias("size")))
    each = _mixed(units, weights, cap, block, seed)[0].withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def resample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0, heavy: int = HEAVY) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns as they are; a document without words goes. Rows that
    are equal throughout are one unit, whose copies come out in equal numbers but for one."""
    a, b = row_hash(docs, 1), row_hash(docs, 2)
    units = _units(docs.select(a.alias("id"), b.alias("tag"), _key(docs[source_col]).alias("key"), _sizes(docs[text_col]).alias("size")))
    taken, total = _mixed(units, weights, cap, block, seed)
    per = written(taken.where("size > 0").groupBy("id", "tag").agg(F.sum(F.col("times") * F.col("copies")).alias("n"), F.sum("copies").alias("of")).where("n > 0"), "taken")
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), a.alias("id"), b.alias("tag"))
    # rows with many copies: there are `heavy` kinds at most, and one row of each kind, sent out in pieces, stands for all
    hot = per.where(F.col("of") * heavy >= total)
    one = keyed.join(F.broadcast(hot), ["id", "tag"]).groupBy("id", "tag").agg(F.first("row").alias("row"), F.first("n").alias("copies"))
    many = _dealt(one, PIECE).repartition("id", "tag", "piece").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # all others: copies are numbered in place, where the join has brought them together
    light = keyed.join(F.broadcast(hot.select("id", "tag")), ["id", "tag"], "left_anti").join(per.where(F.col("of") * heavy < total), ["id", "tag"])
    nth = F.row_number().over(Window.partitionBy("id", "tag").orderBy("tag"))
    often = F.floor(F.col("n") / F.col("of")) + F.when(F.col("nth") <= F.col("n") % F.col("of"), 1).otherwise(0)
    few = light.withColumn("nth", nth).withColumn("often", often.cast("int")).where("often > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("often"))))
    return few.select("row.*").unionByName(many.select("row.*"))
