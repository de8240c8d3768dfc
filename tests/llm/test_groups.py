import random

import numpy as np
import pytest

from folio.llm import mixing, neighbours, simhash
from folio.llm.common import written
from folio.llm.components import components


def closure(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(220)], "none": [(1, 1)]}[shape]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    want = closure(n, edges)
    assert all(got.get(i, i) == want[i] for i in range(n)) and set(got) <= set(range(n))


TEXTS = [None, "", "  ", "one", "One", "two words", "a b c", "A B C", "x " * 3000]


def near_copies(seed, groups=30):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(2000)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(60, 400))]
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words))
    return out


def test_simhash_groups_equal_brute_force(spark):
    texts = TEXTS + near_copies(2) + ["a b c"]
    docs = spark.createDataFrame([(3 * i + 1, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    want = closure(len(texts), edges)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, heavy=50).collect()}
    assert got == {3 * i + 1: (f"{int(prints[i]):016x}", 3 * want[i] + 1) for i in range(len(texts))}
    assert prints[0] == prints[1] == prints[2] == 0 and prints[3] == prints[4] and prints[6] == prints[7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_lose_no_pair_at_any_distance(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list(base)
    for b in base:
        for d in range(1, 6):
            x = b
            for bit in r.sample(range(64), d):
                x ^= 1 << bit
            fps.append(x)
    hub = r.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5) if a != b]  # a dense group
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    for limit in (0, 1, 3):
        want = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= limit])
        for hot in (simhash.HOT, 4):  # 4: nearly every signature is dealt again
            got = {r.fp: r.component_id for r in simhash.groups(written(df, "t"), limit, hot=hot).collect()}
            assert [got[x] for x in signed] == want


def test_hot_signatures_are_dealt_again(spark, monkeypatch):
    """Members of one signature over several batches, in a group of one task, mostly without links."""
    r = random.Random(5)
    fps = sorted({(0xABCDEF01 << 32) | r.getrandbits(32) for _ in range(3000)} | {(0xABCDEF01 << 32) | 7 ^ (1 << k) for k in range(32)})
    u = np.array(fps, np.uint64)
    edges = [(int(i), j) for j in range(len(u)) for i in np.flatnonzero(np.bitwise_count(u[:j] ^ u[j]) <= 3)]
    signed = u.view(np.int64).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = {r.fp: r.component_id for r in simhash.groups(written(df, "t"), hot=200).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[x] for x in signed] == closure(len(fps), edges)


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "else here now"), (5, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def cosine_links(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    edges = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    edges.append((i, j))
    return edges


@pytest.mark.parametrize(("block", "list_rows", "heavy"), [(2048, 1024, 10_000), (16, 1024, 2), (64, 16, 2)])
def test_neighbours_equal_brute_force(spark, block, list_rows, heavy, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LIST_ROWS", list_rows)
    r = np.random.default_rng(3)
    vectors = []
    for k in range(60):
        c = r.standard_normal(16)
        vectors += [c + 0.12 * r.standard_normal(16) for _ in range(r.integers(1, 8))]
    vectors += [vectors[0]] * 40 + [3 * vectors[1], [1e300] * 16, [0.0] * 16]
    vectors = [[float(x) for x in v] for v in vectors]
    vectors += [None, [], [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(2 * i + 1, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<double>, n_links string, label int")
    edges = cosine_links(rows)
    want = closure(len(rows), edges)
    degree = np.bincount(np.array(edges).ravel(), minlength=len(rows))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in neighbours.near_duplicates(df, heavy=heavy).collect()}
    exact = sum(got[2 * i + 1] == (int(degree[i]), 2 * want[i] + 1, want[i] == i) for i in range(len(rows)))
    links = sum(v[0] for v in got.values())
    assert links <= degree.sum() and links >= 0.99 * degree.sum() and exact >= 0.97 * len(rows)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_float_vectors_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (None, 1, 2, False)]


def test_different_vectors_that_share_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([30.0, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.choice((0, 1, 50, 1000, 10**6)) for _ in range(r.randint(1, 12))]
        goal = mixing.targets(sizes)
        assert all(g <= 3 * s + 1e-6 for g, s in zip(goal, sizes, strict=True)) and sum(goal) == pytest.approx(sum(sizes))


def test_planted_pairs_of_twenty_thousand_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 256)  # some 80 lists in each quantiser
    r = np.random.default_rng(8)
    x = r.standard_normal((16_000, 32))
    x = np.concatenate([x, x[:4000] + r.uniform(0.05, 0.5, (4000, 1)) * r.standard_normal((4000, 32))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int((unit[i : i + 1000] @ unit.T >= 0.9).sum()) for i in range(0, len(unit), 1000)) - len(unit)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = sum(q.n_links for q in neighbours.near_duplicates(df).collect())
    assert 6000 < want and 0.99 * want <= got <= want


def test_lengths_without_quantiser_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LENGTHS", 1)
    df = spark.createDataFrame([(i, [1.0, i / 1000.0]) for i in range(50)] + [(100 + i, [1.0, 0.0, i / 1000.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == {i: (49, 0) for i in range(50)} | {100 + i: (39, 100) for i in range(40)}


def test_landing_keeps_probabilities_and_nears_the_totals():
    r = random.Random(3)
    off, alone = [], []
    for _ in range(8):
        sizes = [float(r.randint(1, 900)) for _ in range(10)]
        p = [r.choice((0.25, r.uniform(0.05, 0.95))) for _ in sizes]
        total = sum(a * b for a, b in zip(p, sizes, strict=True))
        drawn = [mixing.landing(p, sizes, seed) for seed in range(400)]
        assert all(set(x) <= {0.0, 1.0} and abs(sum(x) - sum(p)) < 1 for x in drawn)
        share = np.mean(drawn, axis=0)
        assert all(abs(a - b) < 4.5 * (b * (1 - b) / 400) ** 0.5 for a, b in zip(share, p, strict=True))
        off += [abs(sum(a * b for a, b in zip(x, sizes, strict=True)) - total) for x in drawn]
        alone += [abs(sum(s for s, q in zip(sizes, p, strict=True) if r.random() < q) - total) for _ in range(400)]
    assert np.mean(off) < 0.1 * np.mean(alone)
    assert mixing.landing([], [], 1) == [] and mixing.landing([1.0, 0.0], [3.0, 4.0], 1) == [1.0, 0.0]


def test_landing_finds_the_best_distribution():
    """Against all choices by hand: of 2 units with p 1/2 each and sizes 5 and 7, one of the two is always taken."""
    drawn = {tuple(mixing.landing([0.5, 0.5], [5.0, 7.0], s)) for s in range(100)}
    assert drawn == {(0.0, 1.0), (1.0, 0.0)}


def test_inclusion_probabilities_over_seeds():
    r = random.Random(4)
    sizes = [float(r.choice((1, 5, 40, 300, 4000))) for _ in range(60)]
    p = [0.37] * 60
    drawn = [mixing.landing(mixing.flight(p, sizes, s), sizes, s) for s in range(300)]
    share = np.mean(drawn, axis=0)
    assert np.abs(share - 0.37).max() < 4.5 * (0.37 * 0.63 / 300) ** 0.5


def test_equal_rows_are_spread_over_blocks(spark):
    """A hundred thousand rows alike, without id: none of their blocks is larger than BLOCK."""
    units = mixing.written(spark.createDataFrame([(None, 0, "sa", 7, 100_000), (1, 0, "sa", 9, 1), (2, 0, "n", 9, 1)], "id long, tag long, key string, size long, copies long"), "units")
    plan = mixing.written(mixing.sources(units), "plan")
    rows = mixing._blocks(units, plan, 100_002, mixing.BLOCK)
    per = [x.n for x in rows.groupBy("src", "block").agg(mixing.F.sum("copies").alias("n")).collect()]
    assert sum(per) == 100_002 and max(per) <= mixing.BLOCK
    same = spark.createDataFrame([(None, "w w w", "a")] * 5000 + [(k, "w " * (k % 9), "b") for k in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(same).groupBy("source_size").agg(mixing.F.sum("taken"), mixing.F.max("target"), mixing.F.count("*")).collect()
    assert sorted(x[3] for x in got) == [50, 5000] and all(abs(x[1] - x[2]) <= 10 for x in got)
    out = mixing.resample(same)
    assert abs(out.count() * 3 - sum(x[2] for x in got)) < 300


def test_sources_as_a_table(spark):
    r = random.Random(7)
    size = {f"s{k:03d}": r.choice((0, 3, 50, 1000, 20_000)) for k in range(80)} | {"n": 77, "sé": 10, "sZ": 5}
    units = mixing.written(spark.createDataFrame([(k, 0, key, n, 1) for k, (key, n) in enumerate(size.items())], "id long, tag long, key string, size long, copies long"), "units")
    got = {x.key: (x.src, x.target) for x in mixing.sources(units).collect()}
    order = sorted(size, key=lambda k: (k == "n", k.encode()))
    goal = mixing.targets([size[k] for k in order])
    assert {k: (i, pytest.approx(g)) for i, (k, g) in enumerate(zip(order, goal, strict=True))} == got


def test_flight_keeps_both_totals():
    r = random.Random(6)
    sizes = [float(r.randint(0, 5000)) for _ in range(2000)]
    p = [0.37] * 2000
    out = mixing.flight(p, sizes, 11)
    left = [x for x in out if mixing.EPS < x < 1 - mixing.EPS]
    assert len(left) <= mixing.LEFT and sum(out) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(out, sizes, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, sizes, strict=True)))
    assert sum(mixing.flight([0.5] * 50, [7.0] * 50, 1)) == 25 and mixing.flight([], [], 1) == []
    # each unit is in as often as its probability says
    share = np.mean([[x >= 0.5 for x in mixing.flight([0.3] * 60, sizes[:60], s, leave=2)] for s in range(400)], axis=0)
    assert abs(share.mean() - 0.3) < 0.02 and share.max() < 0.45


@pytest.mark.parametrize("block", [64, 4096])
def test_mix(spark, block):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(1, 300)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(900, None, "a"), (901, "", None), (None, "x y", "z"), (5, "again here", "b")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=block).collect()))
    assert len(got) == len(rows) and all(0 <= g.taken <= 3 * g.size and g.taken == g.size * g.times for g in got)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = ["a", "b", "c", "z", None]
    goal = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True))
    taken = {}
    for g in got:
        s = next(k for k in order if size[k] == g.source_size)
        taken[s] = taken.get(s, 0) + g.taken
        assert g.target == pytest.approx(goal[s])
    assert all(abs(taken[s] - goal[s]) <= 60 for s in order)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [10_000, 1])
def test_resample_repeats_whole_rows(spark, heavy):
    rows = [(i, f"text number {i} " * (1 + i % 5), "abc"[i % 3], i) for i in range(120)] + [(7, "same text", "a", 1), (7, "same text", "a", 2), (None, "no id", "b", 3), (500, None, "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.resample(docs, heavy=heavy)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert set(got) <= set(rows) and max(got.values()) <= 3
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mine = {}
    for row, n in got.items():
        mine[row[0]] = mine.get(row[0], 0) + n * len(row[1].split())
    # the same mix up to the keys that tell rows apart
    assert abs(sum(mine.values()) - sum(taken.values())) <= 60
    assert mixing.resample(docs.limit(0)).count() == 0
