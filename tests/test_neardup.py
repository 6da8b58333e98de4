import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import cosine, graph, neardup


def hashes(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "stem long, h long")


def test_bits_and_distance(spark):
    row = spark.range(1).select(
        vectors.pack_bits(F.array(*[F.lit(b) for b in [True] + [False] * 62 + [True]])).alias("a"),
        vectors.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("d"),
    ).first()
    assert row.a == -(1 << 63) + 1 and row.d == 64


def test_block_hash_uses_the_median_without_the_first(spark):
    block = [100.0] + [float(k) for k in range(63)]
    h = spark.createDataFrame([(block,)], "b array<double>").select(vectors.block_hash(F.col("b"))).first()[0]
    bits = f"{h & (1 << 64) - 1:064b}"
    assert bits == "1" + "0" * 32 + "1" * 31


@pytest.mark.parametrize("threshold", [0, 1, 3, 6, 9, 12, 17, 20, 25])
def test_hamming_pairs_equal_brute_force(spark, rows, threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(-(2**63), 2**63, 12)
    values = [int(b) for b in base for _ in range(1)]
    for b in base:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(0, threshold + 4), replace=False)
            x = int(b) & (1 << 64) - 1
            for f in flips:
                x ^= 1 << int(f)
            values.append(x - (1 << 64) if x >> 63 else x)
    want = sorted((i, j, (values[i] ^ values[j]).bit_count() if (values[i] ^ values[j]) >= 0 else ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)))
    want = [w for w in want if w[2] <= threshold]
    got = sorted(tuple(r) for r in neardup.hamming_pairs(hashes(spark, *values), threshold).collect())
    assert got == want


def test_hamming_pairs_edge_cases(spark):
    assert neardup.hamming_pairs(hashes(spark), 6).count() == 0
    with_null = spark.createDataFrame([(1, 5), (None, 5), (2, None), (3, 5)], "stem long, h long")
    assert [tuple(r) for r in neardup.hamming_pairs(with_null, 6).collect()] == [(1, 3, 0)]
    with pytest.raises(ValueError):
        neardup.hamming_pairs(with_null, 65)


def test_groups_are_transitive(spark, rows):
    pairs = neardup.hamming_pairs(hashes(spark, 0b000, 0b001, 0b011, 0b1111000), 1)
    members = graph.group_members(pairs, hashes(spark, 0, 1, 2, 3).select("stem"))
    assert rows(members.select("stem", "group_id")) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_embedding_edge_joins_what_hashes_do_not(spark, rows):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.999, 0.02])], "stem long, embedding array<double>")
    found = neardup.cosine_pairs(v, 0.99)
    edges = neardup.union_edges(neardup.hamming_pairs(hashes(spark, 0, ~0), 0), found)
    assert rows(edges.groupBy("kind").count()) == [("embedding", 1)]
    assert rows(graph.group_members(edges, v.select("stem")).select("group_id").distinct()) == [(0,)]


def test_cross_split_audit(spark):
    h = hashes(spark, 0, 1, 0xFF)
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0])], "stem long, embedding array<double>")
    members = spark.createDataFrame([(0, "train"), (1, "train"), (2, "test")], "stem long, split string")
    row = neardup.cross_split_extremes(h, v, members, 1, 0.95).first()
    assert (row[0], row[1], row[2]) == (0, 7, 0) and row[3] < 0.1
    none = neardup.cross_split_extremes(h, v, members.filter("split = 'train'"), 1, 0.95).first()
    assert tuple(none) == (0, 64, 0, -1.0)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 150)]
    edges = spark.createDataFrame(path + hub + [(5, 5), (None, 3)], "src long, dst long")
    got = dict(graph.connected_components(edges, spark.createDataFrame([(0,), (200,), (1149,), (7777,)], "id long")).collect())
    assert got == {0: 0, 200: 0, 1149: 1000, 7777: 7777}


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.connected_components(none).count() == 0


def test_top_pairs_break_ties_downwards(spark):
    p = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (0, 9, 0.7)], "src long, dst long, cosine double")
    assert [tuple(r)[:2] for r in neardup.top_pairs(p, 2).collect()] == [(0, 9), (1, 3)]


@pytest.mark.parametrize("threshold", [0, 3, 8, 10, 14])
def test_hash_pairs_and_edges_connect_what_pairs_do(spark, threshold):
    rng = np.random.default_rng(threshold)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    hashes = [base[int(rng.integers(12))] ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, threshold + 3), replace=False)) for _ in range(60)]
    hashes += [hashes[0]] * 5
    frame = spark.createDataFrame(list(enumerate(hashes)) + [(None, 1), (99, None)], "stem long, h long")
    distinct = sorted(set(hashes) | {1})
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(a, b, far(a, b)) for a in distinct for b in distinct if a < b and far(a, b) <= threshold}
    assert {tuple(r) for r in neardup.hash_pairs(frame, threshold).collect()} == want
    groups = lambda edges: {(r.stem, r.group_id) for r in graph.group_members(edges, frame.filter("stem is not null")).collect()}
    assert groups(neardup.hamming_edges(frame, threshold)) == groups(neardup.hamming_pairs(frame, threshold))


def clustered(spark, groups=24, each=60, d=16, noise=0.02, seed=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    v = np.repeat(middle, each, axis=0) + noise * rng.normal(size=(groups * each, d))
    order = rng.permutation(len(v))
    frame = spark.createDataFrame([(int(k), [float(x) for x in v[k]], "abc"[k % 3]) for k in order], "stem long, embedding array<double>, split string")
    return v, frame.repartition(5).persist()


def written_bytes(spark):
    """Shuffle bytes that tasks have written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_pruned_tiles_ship_less_than_a_tenth(spark):
    v, frame = clustered(spark)
    frame.count()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(c, 1) >= 0.99), strict=True)}
    table = cosine.tiles(frame, "stem", "embedding", block=60, most=24)
    before = written_bytes(spark)
    pruned = cosine.tile_pairs(table, 0.99)
    kernel = lambda left, right, same: {"n": [len(left.ids) * len(right.ids)]}
    some = cosine.tile_products(table, pruned, kernel, "n long").agg(F.sum("n")).first()[0]
    middle = written_bytes(spark)
    every = cosine.tile_products(table, cosine.tile_pairs(table), kernel, "n long").agg(F.sum("n")).first()[0]
    after = written_bytes(spark)
    assert some < every / 8 and middle - before < (after - middle) / 4  # of which one part is the tiles themselves, read once
    shipped = lambda pairs: cosine.tile_products(table, pairs, lambda a, b, same: {"n": [b.vectors.nbytes]}, "n long").agg(F.sum("n")).first()[0]
    assert shipped(pruned) < shipped(cosine.tile_pairs(table)) / 10
    got = {(r.src, r.dst) for r in neardup.cosine_pairs(frame, 0.99, block=60).collect()}
    assert {p for p in got ^ want if abs(c[p] - 0.99) > 1e-8} == set()


def test_best_first_leaves_most_tile_pairs_unread(spark):
    v, frame = clustered(spark, groups=60, each=20)
    table = cosine.tiles(frame, "stem", "embedding", "split", block=20, most=60)
    best, read, total = cosine.best_across(table, 10)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    want = sorted(((c[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if i % 3 != j % 3), reverse=True)[:10]
    assert [(r.src, r.dst) for r in best] == [(i, j) for _, i, j in want]
    assert read < total / 4


def test_tiles_of_odd_vectors(spark, rows):
    """Zero, null, huge and not finite vectors, copies, and a label that is null; a threshold below zero takes zero vectors in."""
    big = [1e200, 2e200]
    data = [(1, [1.0, 2.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, big, "y"), (5, [float("nan"), 1.0], "y"), (6, [-1.0, -2.0], None), (None, [1.0, 2.0], "x"), (7, [1e-300, 2e-300], "y"), (8, [1.0, 2.0], "x")]
    frame = spark.createDataFrame(data, "stem long, embedding array<double>, split string")
    found = lambda t: sorted((r.src, r.dst) for r in neardup.cosine_pairs(frame, t, block=3).collect())
    assert found(0.999) == [(1, 4), (1, 7), (1, 8), (4, 7), (4, 8), (7, 8)]
    assert len(found(-1.1)) == 7 * 6 // 2
    top = neardup.top_across_splits(frame.select("stem", "embedding"), frame.select("stem", "split").filter("stem is not null"), 3).collect()
    assert {(r.src, r.dst, r.left_split, r.right_split) for r in top} <= {(1, 4, "x", "y"), (1, 7, "x", "y"), (4, 8, "y", "x"), (7, 8, "y", "x")} and len(top) == 3
    none = spark.createDataFrame([], "stem long, embedding array<double>, split string")
    assert neardup.cosine_pairs(none, 0.5).count() == 0 and cosine.top_across(none, "split", 5).count() == 0
    text = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "stem string, embedding array<float>")
    assert rows(neardup.cosine_pairs(text, 0.9)) == [("a", "b", 1.0)]


def test_smallest_distance_beyond_the_threshold_is_searched(spark):
    h = hashes(spark, 0, (1 << 30) - 1, 0)
    v = spark.createDataFrame([(n, [1.0, float(n)]) for n in range(3)], "stem long, embedding array<double>")
    for splits, want in ((("a", "b", "a"), (0, 30)), (("a", "a", "b"), (1, 0)), (("a", None, "a"), (0, 64))):
        members = spark.createDataFrame(list(enumerate(splits)), "stem long, split string")
        assert tuple(neardup.cross_split_extremes(h, v, members, 3, 0.99).first())[:2] == want


def test_probe_plans_miss_no_pair():
    for threshold in range(21):
        for rows in (10, 10_000, 10**7, 10**9):
            _, plan = neardup.probe_plan(threshold, rows)
            assert sum(r + 1 for _, _, r in plan) == threshold + 1 and sum(w for _, w, _ in plan) == 64
            assert [s for s, _, _ in plan] == np.cumsum([0] + [w for _, w, _ in plan])[:-1].tolist()
    wide = {rows: max(w for _, w, _ in neardup.probe_plan(14, rows)[1]) for rows in (100, 10**7)}
    assert wide[100] < wide[10**7]  # keys get wider as rows grow, so that candidates a probe stay few


def test_a_hot_hash_is_expanded_in_blocks(spark, monkeypatch):
    """A hash of a third of all rows: all its pairs are there, and those with a near hash, whose copies fill several blocks too."""
    monkeypatch.setattr(neardup, "COPIES", 16)
    values = [5] * 60 + [4] * 40 + [1 << n for n in range(20, 50)]
    got = [tuple(r) for r in neardup.hamming_pairs(hashes(spark, *values), 1).collect()]
    want = [(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 1]
    assert sorted(got) == want
    frame = hashes(spark, *values)
    classes = neardup.hash_classes(frame)
    assert {r.class_id for r in classes.collect()} == {0, 60, *range(100, 130)} and classes.count() == len(values)
    assert [tuple(r) for r in neardup.class_pairs(frame, 1).collect()] == [(0, 60, 1)]
