"""Plans that stay right when tables grow: what is small on disk is neither broadcast nor left to one task."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.plans import catalog, corpora  # noqa: F401
from tidemark.plans import fixtures as fx


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """A folder with 1000 suppliers."""
    d = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1000).coalesce(1).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    return d


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_made_by_many_tasks(spark, suppliers):
    assert fx.pixels(spark, suppliers).rdd.getNumPartitions() == 4


def test_a_softmax_computes_its_sum_once(spark):
    row = spark.range(1).select(vectors.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("p"), vectors.kl(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(1.0)), 2.0).alias("k"))
    p, k = row.first()
    assert sum(p) == pytest.approx(1) and p[2] == pytest.approx(0.8437947344813395) and k == pytest.approx(0.02634458597688631)


@pytest.mark.parametrize("name", ["nearest_resize", "paired_logits", "region_weighted_kd"])
def test_pixels_are_never_broadcast(spark, suppliers, name):
    plan = joins(catalog.QUERIES[name](spark, suppliers))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [stem" not in plan


def test_hash_joins_deal_before_they_grow_and_broadcast_nothing(spark, monkeypatch):
    from tidemark.operators import neardup

    monkeypatch.setattr(neardup, "JOINED", 0)
    monkeypatch.setattr(neardup, "KEYS", 1000)
    hashes = spark.range(300).select(F.col("id").alias("stem"), F.xxhash64("id").alias("h"))
    for threshold in (6, 12):
        near = neardup.hash_pairs(hashes, threshold)
        assert "Broadcast" not in joins(near) and "REPARTITION_BY_NUM" in joins(near)


@pytest.mark.parametrize("threshold", [0, 6, 12, 17])
def test_joined_and_tiled_hash_pairs_are_the_same(spark, rows, monkeypatch, threshold):
    from tidemark.operators import neardup

    hashes = spark.range(400).select(F.xxhash64(F.col("id") % 100).bitwiseXOR(F.expr("shiftleft(1L, cast(id % 7 as int)) - 1")).alias("h"))
    monkeypatch.setattr(neardup, "HASH_BLOCKS", (64, 64))
    monkeypatch.setattr(neardup, "SLICE", 500)
    tiled = rows(neardup.hash_pairs(hashes, threshold))
    monkeypatch.setattr(neardup, "JOINED", 0)
    assert tiled == rows(neardup.hash_pairs(hashes, threshold)) and (tiled or not threshold)


def test_tiles_are_shipped_once_to_a_pair_of_heads(spark, rows, monkeypatch):
    import numpy as np

    from tidemark.operators import cosine, graph

    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "stem long, embedding array<double>")
    monkeypatch.setattr(cosine, "MANY_HEADS", 4)
    found = rows(cosine.cosine_pairs(table, 0.7, block=16))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert [r[:2] for r in sorted(found)] == [(i, j) for i in range(400) for j in range(i + 1, 400) if u[i] @ u[j] >= 0.7]
    tiles = cosine.tiles(table, "stem", "embedding", block=16)
    assert tiles.select(F.shiftright("tile", 32)).distinct().count() == 4
    shipped = cosine.tile_products(tiles, cosine.tile_pairs(tiles), lambda a, b, same: {"n": [1]}, "n long")
    assert shipped.count() == tiles.count() * (tiles.count() + 1) // 2
    thin = graph.thinned(cosine.cosine_pairs(table, 0.7, block=16), most=10**9)
    assert thin.count() < len(found)
    members = lambda e: rows(graph.group_members(e, table.select("stem")))
    assert members(thin) == members(cosine.cosine_pairs(table, 0.7, block=16))


def test_boundaries_share_two_sorts_a_pass(spark, suppliers):
    assert joins(catalog.QUERIES["boundary_matches"](spark, suppliers)).count("Window [") <= 4


def test_pixels_leave_a_task_some_images_at_a_time(spark, monkeypatch):
    from tidemark.operators import imagejobs, scoring

    monkeypatch.setattr(imagejobs, "PIXELS", 10)
    masks = spark.createDataFrame([("a", 2, bytes([1, 2, 3, 4, 5, 6])), ("b", 3, None), ("c", 4, bytes(range(16))), ("d", 1, b"")], "stem string, width int, labels binary").coalesce(1)
    got = [tuple(r) for r in scoring.pixel_rows(masks, "v").collect()]
    assert got == [("a", k // 2, k % 2, k + 1) for k in range(6)] + [("c", k // 4, k % 4, k) for k in range(16)]


def test_pictures_are_written_where_they_are_read(spark, suppliers):
    few = spark.read.parquet(f"{suppliers}/supplier.parquet").limit(3)
    few.write.mode("overwrite").parquet(f"{suppliers}/few/supplier.parquet")
    root = corpora.pictures(spark, f"{suppliers}/few", "images")
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).count() == 3


@pytest.mark.parametrize("n", [64, 4000])
def test_what_a_cosine_join_moves_is_the_table_times_the_same_heads(spark, n):
    """Floats stay floats, and a larger table has no more heads."""
    from tidemark.operators import cosine

    vectors = spark.range(n).select(F.col("id").alias("stem"), F.array(*[(F.hash("id", F.lit(k)) / 2**31).cast("float") for k in range(4)]).alias("embedding"))
    table = cosine.tiles(vectors, "stem", "embedding")
    heads, rows, size = table.agg(F.count_distinct(F.shiftright("tile", 32)), F.sum("n"), F.sum(F.length("body"))).first()
    assert (heads, rows, size) == (8, n, 16 * n)


def test_cosines_at_a_threshold_are_decided_in_double_precision(spark, rows):
    """Copies among them, and neighbours that go to the kernel together."""
    import numpy as np

    from tidemark.operators import cosine

    angles = np.arccos(0.4) + np.array([-2e-9, 2e-9, -1e-5, 1e-5])
    v = [[1.0, 0.0]] * 3 + [[float(np.cos(a)), float(np.sin(a))] for a in angles]
    frame = spark.createDataFrame(list(enumerate(v)), "stem long, embedding array<double>")
    found = {r[:2] for r in rows(cosine.cosine_pairs(frame, 0.4, block=2))}
    assert found == {(i, j) for i in range(7) for j in range(i + 1, 7) if i > 2 or j not in (4, 6)}


def test_an_approximate_join_finds_what_spark_finds_and_writes_no_candidates_out(spark, rows):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from tidemark.operators import neardup

    v = spark.range(120).select(F.col("id").alias("stem"), F.array(*[F.hash("id", F.lit(k)) / 2**31 for k in range(4)]).alias("embedding"))
    unit = v.select("stem", array_to_vector(vectors.l2_normalise(F.col("embedding"))).alias("f")).persist()
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="buckets", bucketLength=0.4, numHashTables=2, seed=42).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, (2 - 2 * 0.8) ** 0.5, "d").filter("datasetA.stem < datasetB.stem")
    want = rows(near.select("datasetA.stem", "datasetB.stem"))
    found = neardup.cosine_pairs_lsh(v, 0.8, tables=2, bucket=0.4)
    assert rows(found.select("src", "dst")) == want and 0 < len(want) < neardup.cosine_pairs(v, 0.8).count()
    assert "Join" not in joins(neardup.cosine_pairs_lsh(v, 0.8)).replace("SortMergeJoin [tile", "")


@pytest.mark.parametrize("threshold", [4, 10, 17, 24])
def test_hashes_of_a_tile_meet_in_near_buckets(monkeypatch, threshold):
    """The pairs of all comparisons, each once, from less than half of them; few buckets that hold most are compared whole."""
    import numpy as np

    from tidemark.operators import neardup

    rng = np.random.default_rng(threshold)
    left = rng.integers(-(2**63), 2**63 - 1, 3000)
    right = np.append(left[:2000], rng.integers(-(2**63), 2**63 - 1, 1500)) ^ np.array([sum(1 << int(k) for k in rng.choice(63, rng.integers(0, threshold + 3), replace=False)) for _ in range(3500)])
    alike = left % 50
    compared, whole = [], neardup._all_near
    monkeypatch.setattr(neardup, "_all_near", lambda a, b, t: compared.append(len(a) * len(b)) or whole(a, b, t))
    monkeypatch.setattr(neardup, "SLICE", 1000)
    for name in ("CALL", "PROBE", "GATHERED"):
        monkeypatch.setattr(neardup, name, 0)
    for a, b in ((left, right), (right, right), (alike, right), (alike, alike), (left[:0], right)):
        parts = lambda found: sorted(p for x, y, n in found for p in zip(x.tolist(), y.tolist(), n.tolist(), strict=True))
        compared.clear()
        got = parts(neardup._near(a, b, threshold))
        assert got == parts(whole(a, b, threshold))
        assert sum(compared) <= len(a) * len(b) and (a is not left or threshold > 17 or sum(compared) < len(a) * len(b) / 2)


def test_tiled_hash_pairs_move_packed_blocks(spark, rows, monkeypatch):
    from tidemark.operators import neardup

    hashes = spark.range(900).select(F.xxhash64(F.col("id") % 300).bitwiseXOR(F.expr("shiftleft(1L, cast(id % 7 as int)) - 1")).alias("h"))
    whole = rows(neardup.hash_pairs(hashes, 6))
    for name, value in (("HASH_BLOCKS", (64, 64)), ("CALL", 0), ("PROBE", 0), ("GATHERED", 0)):
        monkeypatch.setattr(neardup, name, value)
    near = neardup.hash_pairs(hashes, 6)
    assert rows(near) == whole and "piece" in joins(near)
