"""Embedding near-dedup by product quantisation.

Vectors are scaled to length 1. A coarse quantiser of two levels deals them into inverted lists: the nearest of the
top centres, then the nearest of the lower centres to what is left. As lists are pairs of centres, their number grows
with the vectors (LIST_ROWS a list) while the centres, which are sent to the executors, grow with its root. There are
several such quantisers, fitted from different starts, and a vector probes its list in each of them: as many as are
needed for PROBE_RECALL of sample pairs right at the threshold to meet in one (closer pairs meet more often). A single
quantiser with many probes would have to look at far more of the vectors for the same recall.

In a list, what a vector differs from the centre is cut into SUBSPACES parts, each coded by the nearest of 256 code
words. Distances to the members come from a table of squares per subspace and code; a member stays if its table
distance could still be within reach given its own coding error (no loss by the triangle inequality), and its exact
cosine, in double precision on the vectors as given, decides. A pair that meets in several quantisers counts in the
first.

Equal vectors are one node with a count. The members of a list meet in blocks of bounded size; a block
returns link counts and a spanning forest of its links, never its pairs. The quantisers are gone through one after the
other, so that one copy of the vectors is shuffled at a time.

Centres and code words are fitted on a bounded sample (SAMPLE_ROWS expected, drawn by a hash, shared evenly by the
LENGTHS most frequent lengths); every vector is indexed. Vectors of any other length are one list, compared in blocks,
exactly. MAX_CENTRES a level make four million lists: up to four thousand million vectors, lists keep their size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links
0, a component of their own, kept); vectors of different lengths never link; rows that repeat a vector link with
each other; rows that repeat an id are one node of the component; a row with a null id takes part and counts, but
component ids come from rows with ids (null if there are none), and it is not kept unless alone; other input
columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import HEAVY, built, met, written
from folio.llm.components import components

SAMPLE_ROWS, MAX_CENTRES, LIST_ROWS, LENGTHS = 32_768, 2_048, 1_024, 128
SUBSPACES, WORDS = 8, 256
PROBE_RECALL, MAX_QUANTISERS = 0.99, 32
BLOCK = 2_048


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from a random start; an emptied cluster restarts at a random vector."""
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _assign(x, centres)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        centres[full] = np.add.reduceat(x[order], starts, axis=0) / n[full, None]
        if len(empty := np.flatnonzero(n == 0)):
            centres[empty] = x[r.integers(0, len(x), len(empty))]
    return centres


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, SUBSPACES, width), padded with zeros."""
    width = math.ceil(x.shape[1] / SUBSPACES)
    return np.pad(x, ((0, 0), (0, SUBSPACES * width - x.shape[1]))).reshape(len(x), SUBSPACES, width)


class Index:
    """A coarse quantiser and the code words for vectors of one length. A list's number is that of its top centre times
    the number of lower centres plus that of its lower centre."""

    def __init__(self, tops: np.ndarray, lows: np.ndarray, code_words: list[np.ndarray], reach: float):
        self.tops, self.lows, self.code_words, self.reach = tops, lows, code_words, reach

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, threshold: float, seed: int = 3, code_words: list[np.ndarray] | None = None) -> Index:
        """x: a sample of unit vectors; rows: how many there are in all. Code words of another quantiser serve as well:
        what they miss is in the coding error."""
        k = min(MAX_CENTRES, math.ceil(math.sqrt(max(1, rows // LIST_ROWS))), max(1, len(x) // 8))
        tops = k_means(x, k, seed=seed)
        lows = k_means(x - tops[_assign(x, tops)], k, seed=seed + 1)
        index = cls(tops, lows, code_words or [], math.sqrt(max(0.0, 2 - 2 * threshold)))
        if not code_words:
            drawn = x[np.random.default_rng(seed).permutation(len(x))[:8192]]
            rest = _parts(drawn - index.centre(index.lists(drawn)))
            index.code_words = [k_means(np.unique(rest[:, s], axis=0), WORDS, 6) for s in range(SUBSPACES)]
        return index

    @classmethod
    def fit_all(cls, x: np.ndarray, rows: int, threshold: float) -> list[Index]:
        """Quantisers until enough of the pairs right at the threshold (sample vectors and a random step away from each)
        meet in one of them."""
        r, x = np.random.default_rng(5), np.unique(x, axis=0)
        base = x[r.integers(0, len(x), 10_000)]
        step = r.standard_normal(base.shape)
        step -= (step * base).sum(1, keepdims=True) * base
        step /= np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
        other = threshold * base + math.sqrt(max(0.0, 1 - threshold**2)) * step
        out, apart = [], np.ones(len(base), bool)
        while apart.mean() > 1 - PROBE_RECALL and len(out) < MAX_QUANTISERS:
            out.append(cls.fit(x, rows, threshold, 3 + 100 * len(out), out[0].code_words if out else None))
            apart &= out[-1].lists(base) != out[-1].lists(other)
        return out

    def lists(self, x: np.ndarray) -> np.ndarray:
        top = _assign(x, self.tops)
        return top * len(self.lows) + _assign(x - self.tops[top], self.lows)

    def centre(self, lists) -> np.ndarray:
        return self.tops[lists // len(self.lows)] + self.lows[lists % len(self.lows)]

    def encode(self, y: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding error of a list's members."""
        rest = _parts(y - self.centre(at))
        codes = np.stack([_assign(rest[:, s], w) for s, w in enumerate(self.code_words)], 1)
        return codes, np.sqrt(sum(((rest[:, s] - w[codes[:, s]]) ** 2).sum(1) for s, w in enumerate(self.code_words)))

    def candidates(self, x: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, member of the list) that may be within reach."""
        rest = _parts(x - self.centre(at))
        total = np.zeros((len(x), len(codes)), np.float32)
        for s, w in enumerate(self.code_words):
            part = rest[:, s]
            table = (part**2).sum(1)[:, None] - 2 * part @ w.T + (w**2).sum(1)
            total += np.take(table.astype(np.float32), codes[:, s], axis=1)
        return np.nonzero(total <= ((self.reach + error + 1e-4) ** 2 + 1e-4).astype(np.float32))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vec: str) -> str:
    return f"size({vec}) > 0 AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vec}, x -> x <> 0)"


def _listed(nodes: DataFrame, indexes) -> DataFrame:
    """Adds lists: a vector's list in each quantiser of its length; none where the length has no quantiser."""

    def run(batches):
        models = built(indexes, lambda value: value)
        for b in batches:
            dims = np.array(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                for i in range(0, part.num_rows, 2048):
                    rows = part.slice(i, 2048)
                    x = _unit(_matrix(rows.column("vec")))
                    lists = np.stack([m.lists(x) for m in models[int(dim)]], 1) if int(dim) in models else np.zeros((len(x), 0), np.int64)
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("node", "copies", "dim", "vec")), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["node", "copies", "dim", "vec", "lists"])

    return nodes.mapInArrow(run, f"node long, copies long, dim int, vec {nodes.schema['vec'].dataType.simpleString()}, lists array<int>")


def _meet(indexes, threshold: float, nth: int):
    """One block of a list in the nth quantiser: the pairs of its parts `low` and `high`, or within the part if they are
    one. Rows (a, b, n): with b null, n links of a; else an edge of the block's forest."""

    def run(block: pa.Table) -> pa.Table:
        models = built(indexes, lambda value: value)
        block = block.sort_by("node").combine_chunks()
        low, high, dim = (block[c][0].as_py() for c in ("low", "high", "dim"))
        part = np.array(block["part"])
        first, second = np.flatnonzero(part == low), np.flatnonzero(part == high)
        ids, copies = np.array(block["node"]), np.array(block["copies"])
        links, label, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        if len(first) and len(second):
            vec = _matrix(block["vec"].combine_chunks())
            scaled = vec / np.abs(vec).max(1, keepdims=True)  # so that no square overflows
            norm = np.linalg.norm(scaled, axis=1)
            unit = scaled / norm[:, None]
            model, before = None, np.zeros((len(ids), 0), np.int32)
            if dim in models:
                model, at = models[dim][nth], block["list"][0].as_py()
                codes, error = model.encode(unit[second], at)
                before = np.array(block["lists"].combine_chunks().flatten()).reshape(len(ids), -1)[:, :nth]
            step = max(1, 500_000 // len(second))
            for k in range(0, len(first), step):
                rows = first[k : k + step]
                if model is None:
                    i, j = (x.ravel() for x in np.indices((len(rows), len(second))))
                else:
                    i, j = model.candidates(unit[rows], at, codes, error)
                i, j = rows[i], second[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 100_000):
                    p, q = i[c : c + 100_000], j[c : c + 100_000]
                    near = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norm[p] * norm[q]) >= threshold
                    near[near] = ~(before[p[near]] == before[q[near]]).any(1)  # met in an earlier quantiser
                    p, q = p[near], q[near]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    if not len(p):
                        continue
                    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # candidates come row by row
                    for u, others in zip(p[starts], np.split(q, starts[1:]), strict=True):
                        found, one = np.unique(label[others], return_index=True)
                        new = found != label[u]
                        if new.any():
                            forest += [(int(ids[u]), int(ids[others[k]])) for k in one[new]]
                            label[np.isin(label, found)] = label[u]
        linked = np.flatnonzero(links)
        a = np.concatenate([ids[linked], np.array([e[0] for e in forest], np.int64)])
        b = pa.array([None] * len(linked) + [e[1] for e in forest], pa.int64())
        n = np.concatenate([links[linked], np.zeros(len(forest), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(n, pa.int64())})

    return run


def quantisers(nodes: DataFrame, threshold: float) -> dict[int, list[Index]]:
    """For each of the most frequent lengths, fitted on its share of the sample."""
    per = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    if not per:
        return {}
    share = F.create_map(*(F.lit(v) for dim, n in per.items() for v in (dim, math.ceil(min(1.0, SAMPLE_ROWS / len(per) / n) * 1_000_000))))
    drawn = F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < share[F.col("dim")]
    sample = nodes.where(F.col("dim").isin(*per) & drawn).select("dim", "vec").toArrow()
    dims, out = np.array(sample["dim"]), {}
    for dim, n in per.items():
        if (mine := dims == dim).any():
            x = _unit(_matrix(sample.filter(pa.array(mine))["vec"].combine_chunks()))
            out[dim] = Index.fit_all(x, n, threshold)
    return out


def links(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes: written rows (node, copies, dim, vec), each vector once. Returns written rows (a, b, n) as _meet() does."""
    spark = nodes.sparkSession
    models = quantisers(nodes, threshold)
    indexes = spark.sparkContext.broadcast(models)
    index = written(_listed(nodes, indexes), "index")
    out = None
    for nth in range(max(map(len, models.values()), default=1)):
        at = F.when(F.size("lists") > nth, F.get("lists", F.lit(nth)))
        rows = index.withColumn("list", at if nth else F.coalesce(at, F.lit(-1))).where("list IS NOT NULL")
        sizes = rows.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        # a part meets itself and every other one
        each = rows.join(sizes, ["dim", "list"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = each.select("dim", "list", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "copies", "vec", "lists")
        found = dealt.groupBy("dim", "list", "low", "high").applyInArrow(_meet(indexes, threshold, nth), "a long, b long, n long")
        part_of = written(found, f"links{nth}")
        out = part_of if out is None else out.unionByName(part_of)
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of this quantiser before the next
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", heavy: int = HEAVY) -> DataFrame:
    """Per row: the id, n_links, component_id and kept."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(vectors[vec_col], lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # + 0.0: no negative zero
    rows = vectors.select(vectors[id_col].alias("id"), vec.alias("vec")).withColumn("ok", F.coalesce(F.expr(_valid("vec")), F.lit(False)))
    good = rows.where("ok").groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    # each distinct vector has a number of its own, fixed once written: ids may be null or shared by different vectors
    nodes = written(good.select(F.monotonically_increasing_id().alias("node"), "low", "copies", F.size("vec").alias("dim"), "vec"), "vectors")
    found = links(nodes.select("node", "copies", "dim", "vec"), threshold)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL"))
    labelled = nodes.join(counts, "node", "left").join(roots, "node", "left").select("vec", "low", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    per = written(labelled.join(least, "root").select("vec", "copies", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "labels")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    total = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    each = met(rows.where("ok").select("id", "vec"), per, ["vec"], "copies", total, heavy)
    linked = each.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", kept)
    alone = rows.where("NOT ok").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


#: The same rows in DuckDB SQL, by comparing all pairs: for small tables, where no link is lost.
LINKS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT rid, vec_id, e FROM v
  WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: coalesce(x <> 0, false)))),
l AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT rid, rid AS reached FROM v UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.reached),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY 1),
c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.reached GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
