"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit for each position that is set in over half the XXH64 hashes (seed 42) of a text's
three-word shingles. Two fingerprints at 3 or fewer differing bits, cut into two segments of 32 bits, have one
segment that differs by one bit at most. So each segment is indexed whole and 32 times with one bit wiped out;
fingerprints that share such a signature meet, and their distance is verified on all 64 bits.

Equal fingerprints are one node from the start. The members of a signature stream through sorted partitions as
8-byte numbers; within one signature a search from member to member reaches only members not yet reached, so
that a dense group costs its size and emits a spanning forest, never its pairs. A signature of more than HOT members
is never held: its members stream on to a second deal by the same argument. They differ in 3 bits of the other segment
at most, so of its two quarters of 16 bits one differs by a bit at most, and they meet again in that quarter, whole or
with one bit wiped out, where they have 46 bits in common.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other;
fewer than three words make one shingle of all of them; rows that repeat stay and share a component; a row
with a null id is kept with its component's smallest id (null if the component has none); other input columns
are dropped, so their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import HEAVY, met, words_of, written
from folio.llm.components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
SLICE = 1 << 16
HOT = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    flat = b" ".join(words).lower()  # on bytes, lower() changes A-Z only
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(flat[i:j], SEED) for i, j in spans), np.uint64, n)
    for at in range(0, n, SLICE):
        part = hashes[at : at + SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _signatures(batches):
    """For each fingerprint 66 rows: segment, wiped-out bit (32: none) and what is left of the segment in one long."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    keep = np.append(~bits & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF))
    heads = np.arange(33, dtype=np.uint64)
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            halves = [fp.view(np.uint64) & np.uint64(0xFFFFFFFF), fp.view(np.uint64) >> np.uint64(32)]
            sig = np.stack([half[:, None] & keep | (heads + np.uint64(33 * s)) << np.uint64(32) for s, half in enumerate(halves)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(sig.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 66))], ["sig", "fp"])


def _forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected among the members of one signature."""
    u = fp.view(np.uint64)
    left = np.arange(len(u))
    out = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(u[left] ^ u[x]) <= limit
            if near.any():
                got = left[near]
                left = left[~near]
                frontier.extend(got.tolist())
                out.extend((int(fp[x]), int(fp[y])) for y in got)
    return out


def _again(sig: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second deal of members of one signature: for each 34 keys, from the signature and a quarter of the other
    segment, whole or with one bit wiped out. Keys are mixed into 64 bits; two that happen to be equal only bring
    fingerprints together that the distance then parts."""
    u = fp.view(np.uint64)
    other = u >> np.uint64(32) if int(np.uint64(np.int64(sig)) >> np.uint64(32)) < 33 else u & np.uint64(0xFFFFFFFF)
    bits = np.uint64(1) << np.arange(16, dtype=np.uint64)
    keep = np.append(~bits & np.uint64(0xFFFF), np.uint64(0xFFFF))
    heads = np.arange(17, dtype=np.uint64)
    parts = [other & np.uint64(0xFFFF), other >> np.uint64(16)]
    keys = np.stack([part[:, None] & keep | (heads + np.uint64(17 * q)) << np.uint64(16) for q, part in enumerate(parts)], 1).reshape(-1)
    with np.errstate(over="ignore"):
        keys = (keys + np.uint64(np.int64(sig)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ keys >> np.uint64(29)).view(np.int64), np.repeat(fp, 34)


def _links(limit: int, hot: int | None):
    """For partitions sorted by sig: edges (a, b) among the members of each signature. Members of one that has more than
    `hot` come out as (key, a) to be dealt again; hot None: a second deal, all signatures are searched where they are."""
    names = ["a", "b", "key"]

    def batch(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names)

    def dealt(sig: int, fp: np.ndarray):
        for at in range(0, len(fp), 4096):
            keys, again = _again(sig, fp[at : at + 4096])
            yield batch(again, [None] * len(again), keys)

    def runs(sig: np.ndarray, fp: np.ndarray):
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        length = np.diff(np.append(first, len(sig)))
        use = length > 1
        if hot is not None:
            wiped = (sig.view(np.uint64) >> np.uint64(32)).astype(np.int64)
            segment, kind = wiped // 33, wiped % 33
            bit = (fp.view(np.uint64) >> (np.minimum(kind, 31) + 32 * segment).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = np.add.reduceat(bit, first)
            # equal segments meet in the whole signature; a wiped-out bit matters where it differs
            use &= (kind[first] == 32) | (ones > 0) & (ones < length)
        two = first[use & (length == 2)]
        near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= limit]
        edges = list(zip(fp[near].tolist(), fp[near + 1].tolist(), strict=True))
        for i in np.flatnonzero(use & (length > 2)):
            members = fp[first[i] : first[i] + length[i]]
            if hot is not None and length[i] > hot:
                yield from dealt(int(sig[first[i]]), members)
            else:
                edges += _forest(members, limit)
        if edges:
            a, b = np.array(sorted({(min(e), max(e)) for e in edges}), np.int64).T
            yield batch(a, b, [None] * len(a))

    def run(batches):
        sigs, fps, held, streaming = [], [], 0, None  # streaming: the signature that has shown itself hot
        for b in batches:
            if not b.num_rows:
                continue
            s, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if streaming is not None:
                same = int(np.searchsorted(s, streaming, side="right"))
                yield from dealt(streaming, f[:same])
                s, f = s[same:], f[same:]
                if not len(s):
                    continue
                streaming = None
            cut = int(np.searchsorted(s, s[-1]))  # the last signature may go on in the next batch
            if held and s[0] != sigs[0][0] or cut:
                yield from runs(np.concatenate([*sigs, s[:cut]]), np.concatenate([*fps, f[:cut]]))
                sigs, fps, held = [], [], 0
            sigs.append(s[cut:])
            fps.append(f[cut:])
            held += len(s) - cut
            if hot is not None and held > hot:
                streaming = int(s[-1])
                yield from dealt(streaming, np.concatenate(fps))
                sigs, fps, held = [], [], 0
        if held:
            yield from runs(np.concatenate(sigs), np.concatenate(fps))

    return run


def links(fps: DataFrame, limit: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """fps: rows (fp), each once. Edges (a, b) that connect all fingerprints that links connect."""
    schema = "a long, b long, key long"
    signed = fps.select("fp").mapInArrow(_signatures, "sig long, fp long")
    found = written(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_links(limit, hot), schema), "links")
    again = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key")
    return found.where("key IS NULL").select("a", "b").unionByName(again.mapInArrow(_links(limit, None), schema).select("a", "b"))


def groups(prints: DataFrame, limit: int = MAX_BITS, id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """prints: (id, fp). Returns (fp, n, component_id): for each fingerprint its rows and the smallest id reachable."""
    if not 0 <= limit <= MAX_BITS:
        raise ValueError(f"two segments serve 0 to {MAX_BITS} bits")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, limit, hot))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return labelled.join(least, "root").select("fp", "n", "component_id")


def near_duplicates(docs: DataFrame, limit: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Per row: the id, fingerprint (16 lower-case hex digits) and component_id."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    found = written(groups(prints, limit, id_col), "groups")
    each = met(prints, found, ["fp"], "n", prints.count(), heavy)
    return each.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
