import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, experiments, provenance, splits
from tidemark.session import cut


def ids(spark, n):
    return spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stem"))


def test_random_split_has_exact_quotas_and_ignores_partitioning(spark, rows):
    a = splits.random_split(ids(spark, 1325))
    assert dict(a.groupBy("split").count().collect()) == {"train": round(1325 * 0.7), "val": round(1325 * 0.15), "test": 1325 - round(1325 * 0.7) - round(1325 * 0.15)}
    assert rows(a) == rows(splits.random_split(ids(spark, 1325).repartition(7)))
    order = sorted((f"{k:06d}" for k in range(1325)), key=lambda s: hashlib.sha256(f"42:{s}".encode()).hexdigest())
    assert {r.stem for r in a.filter("split = 'train'").collect()} == set(order[: round(1325 * 0.7)])


def test_bad_ratios(spark):
    for bad in ((0.5, 0.5, 0.0), (0.5, 0.3, 0.3)):
        with pytest.raises(ValueError):
            splits.random_split(ids(spark, 3), bad)


def test_grouped_split_keeps_groups_and_ratios(spark):
    stems = ids(spark, 400)
    members = stems.withColumn("group_id", F.floor(F.col("stem").cast("int") / F.when(F.col("stem") < "000100", 10).otherwise(1)))
    members = members.withColumn("group_id", F.when(F.col("stem") < "000100", F.col("group_id")).otherwise(F.col("group_id") + 1000))
    mix = stems.select("stem", F.lit(10).alias("obstacle"), F.lit(20).alias("water"), F.lit(30).alias("sky"))
    got = splits.grouped_split(members, mix)
    assert splits.impure_groups(members, got).count() == 0 and got.count() == 400
    sizes = dict(got.groupBy("split").count().collect())
    assert abs(sizes["train"] - 280) <= 1 and abs(sizes["val"] - 60) <= 1 and abs(sizes["test"] - 60) <= 1


def one_by_one(fill, n, size, mix):
    """The rule as it is told: each group in turn to the split of the least score, the first of equals."""
    out = [0, 0, 0]
    for _ in range(n):
        k = min(range(3), key=lambda j: (fill.score(j, out[j] + 1, size, mix), j))
        out[k] += 1
    return out


def test_a_cell_is_placed_as_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(150):
        total = int(rng.integers(50, 3000))
        classes = [float(x) for x in rng.integers(1, 10_000, 3)]
        fill = splits.SplitFill(total, classes, [(0.7, 0.15, 0.15), (0.5, 0.3, 0.2), (0.34, 0.33, 0.33)][int(rng.integers(3))])
        for _ in range(4):  # rare classes make scores that fall before they rise
            n, size = int(rng.integers(0, 120)), int(rng.integers(1, 40))
            mix = [float(x) for x in rng.integers(0, 3, 3) * np.array(classes) / rng.integers(1, 300)]
            want = one_by_one(fill, n, size, mix)
            assert fill.place(n, size, mix) == want and sum(want) == n


def test_grouped_split_balances_many_groups(spark):
    """Most groups are one image, one holds a third of all; shares of images and classes are close to the quotas whatever the number of groups."""
    n = 60_000
    stems = spark.range(n).select(F.col("id").alias("stem"), F.when(F.col("id") < n // 3, -1).otherwise(F.floor(F.col("id") / (1 + F.col("id") % 3))).alias("group_id"))
    mix = stems.select("stem", (F.col("stem") % 7 * 100).alias("obstacle"), (F.col("stem") % 11 * 50).alias("water"), F.lit(300).alias("sky"))
    got = cut(splits.grouped_split(stems, mix), "test-split")
    assert splits.impure_groups(stems, got).count() == 0 and got.count() == n
    shares = {r.split: r for r in got.join(mix, "stem").groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("obstacle", "water", "sky")]).collect()}
    for name, ratio in zip(splits.NAMES, (0.7, 0.15, 0.15), strict=True):
        assert abs(shares[name].n / n - ratio) < 0.0005
        for c in ("obstacle", "water", "sky"):
            assert abs(shares[name][c] / sum(r[c] for r in shares.values()) - ratio) < 0.01


def test_grouped_split_of_nothing(spark):
    members = spark.createDataFrame([], "stem string, group_id long")
    mix = spark.createDataFrame([], "stem string, obstacle long, water long, sky long")
    assert splits.grouped_split(members, mix).count() == 0


def test_set_checks(spark, rows):
    listed = spark.createDataFrame([("a", "train"), ("b", "train"), ("b", "val"), ("c", "val"), ("c", "val"), ("x", "test")], "stem string, split string")
    corpus = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "stem string")
    assert rows(audit.split_overlaps(listed)) == [("b", ["train", "val"])]
    assert rows(audit.pairwise_overlap(listed, "train", "val")) == [("b",)]
    assert rows(splits.duplicate_stems(listed)) == [("val", "c", 2)]
    assert rows(audit.missing_and_extra(corpus, listed)) == [("d", "missing"), ("x", "extra")]
    assert audit.missing_and_extra(corpus.limit(0), listed.limit(0)).count() == 0


def test_checksums(spark, rows):
    a = spark.createDataFrame([("train", "1"), ("val", "2"), ("test", "3")], "name string, sha256 string")
    b = spark.createDataFrame([("train", "1"), ("val", "9"), ("old", "4")], "name string, sha256 string")
    assert {r[0] for r in audit.checksum_mismatches(a, b).collect()} == {"val", "test", "old"}
    assert dict(provenance.registration(a, b).select("name", "status").collect()) == {"train": "match", "val": "mismatch", "test": "unregistered", "old": "missing"}
    assert {r.status for r in provenance.registration(a, None).collect()} == {"unregistered"}


def test_split_digest_ignores_line_ends(spark):
    lf = spark.createDataFrame([("v", "0001"), ("v", "0002"), ("v", "")], "split string, line string")
    crlf = spark.createDataFrame([("v", "0001\r"), ("v", " 0002 \r")], "split string, line string")
    want = hashlib.sha256(b"0001\n0002\n").hexdigest()
    assert provenance.split_digests(lf).first().sha256 == provenance.split_digests(crlf).first().sha256 == want


def test_manifest_digest(spark):
    pairs = spark.createDataFrame([("b", "2", "3"), ("a", "0", "1")], "stem string, image_sha256 string, mask_sha256 string")
    want = hashlib.sha256(b"a\0image\x000\0mask\x001\nb\0image\x002\0mask\x003\n").hexdigest()
    assert provenance.manifest_digest(pairs).first()[0] == want
    assert provenance.merkle_digest(pairs, 4).first()[0] == provenance.merkle_digest(pairs.repartition(3), 4).first()[0]


def test_digests_stream_over_blocks(spark):
    """A key of nine tenths of all rows, many blocks to a key, nulls left out; each equals the digest of the whole."""
    lines = [(k, n, None if n % 50 == 3 else f"{k}-{n} é\n") for k, m in (("big", 4500), ("a", 480), (None, 20)) for n in range(m)]
    df = spark.createDataFrame(lines, "k string, n int, line string").repartition(7)
    got = dict(map(tuple, provenance.hash_blocks(provenance.ordered_blocks(df, "k", ["n"], "line", size=200), "k", ["part", "seq"], "block").collect()))
    assert got == {k: hashlib.sha256("".join(t for o, _, t in lines if o == k and t).encode()).hexdigest() for k in ("big", "a", None)}
    blocks = provenance.ordered_blocks(df, "k", ["n"], "line", size=200)
    assert blocks.count() > 100 and blocks.selectExpr("max(length(block))").first()[0] < 230
    parted = spark.createDataFrame([("x", n, str(n)) for n in range(30)], "k string, n int, t string")
    assert provenance.hash_blocks(parted, "k", ["n"], "t", b",").first().sha256 == hashlib.sha256(",".join(map(str, range(30))).encode()).hexdigest()


def test_digests_of_empty_tables(spark):
    none = spark.createDataFrame([], "stem string, image_sha256 string, mask_sha256 string")
    assert provenance.manifest_digest(none).first()[0] == hashlib.sha256(b"").hexdigest()
    assert provenance.split_digests(spark.createDataFrame([], "split string, line string")).count() == 0


def test_manifest_tasks_hold_blocks_only(spark):
    """Ten times the lines are ten times the blocks of equal size: what the hashing task holds does not grow."""
    most = []
    for n in (3000, 30_000):
        pairs = spark.range(n).selectExpr("lpad(id, 9, '0') as stem", "sha2(cast(id as string), 256) as image_sha256", "sha2(cast(-id as string), 256) as mask_sha256")
        lines = pairs.select(F.lit(0).alias("all"), "stem", provenance._manifest_line().alias("line"))
        blocks = provenance.ordered_blocks(lines, "all", ["stem", "line"], "line", size=20_000)
        most.append(blocks.selectExpr("max(length(block))").first()[0])
        want = hashlib.sha256("".join(r.line for r in lines.orderBy("stem").collect()).encode()).hexdigest()
        assert provenance.manifest_digest(pairs).first()[0] == want
    assert most[0] == most[1] < 20_200


def history(spark, scores, run="r"):
    return spark.createDataFrame([(run, n + 1, s) for n, s in enumerate(scores)], "run_id string, epoch int, safety_score double")


def test_stopping_rule(spark):
    got = experiments.stopping(history(spark, [0.5, 0.505, 0.52, 0.51, 0.525, 0.9]), patience=2, min_delta=0.01).first()
    assert (got.best_epoch, got.best_score, got.stop_epoch) == (3, 0.52, 5)
    never = experiments.stopping(history(spark, [0.5, 0.4, 0.4, 0.4])).first()
    assert (never.best_epoch, never.stop_epoch, never.stale) == (1, None, 3)
    empty = experiments.stopping(history(spark, [None, float("nan")])).first()
    assert empty.best_score is None or empty.best_epoch is not None
    with pytest.raises(ValueError):
        experiments.stopping(history(spark, [1.0]), patience=-1)


def test_screening_winner_is_first_on_ties(spark):
    registry = spark.createDataFrame([("R1", 0), ("R1-B", 1), ("R2", 2)], "experiment_id string, registry_order int")
    best = spark.createDataFrame([("R1-B", 7, 0.6), ("R2", 3, 0.6)], "run_id string, epoch int, safety_score double")
    got = {r.experiment_id: (r.epoch, r.winner) for r in experiments.screening(registry, best).collect()}
    assert got == {"R1": (None, False), "R1-B": (7, True), "R2": (3, False)}


def test_sheets_batches_variants(spark):
    stems = ids(spark, 25)
    sheets = experiments.pages(stems, 10)
    assert sorted((r.sheet, r.slot) for r in sheets.collect()) == sorted((k // 10 + 1, k % 10 + 1) for k in range(25))
    batches = experiments.batches(stems, 4, epoch=1)
    assert batches.count() == 24 and batches.select("batch").distinct().count() == 6
    seeds = {(r.stem, r.variant): r.variant_seed for r in experiments.variants(stems, 2).collect()}
    assert seeds["000003", 1] == 42 + 3000 + 1


def test_augmentation_plan_is_reproducible(spark, rows):
    v = experiments.variants(ids(spark, 20), 2)
    assert rows(experiments.augmentation_plan(v, "domain")) == rows(experiments.augmentation_plan(v.repartition(5), "domain"))
    for r in experiments.augmentation_plan(v, "domain").filter("op = 'gamma'").collect():
        assert 0.75 <= r.value <= 1.35
    with pytest.raises(ValueError):
        experiments.augmentation_plan(v, "other")


def test_latency(spark):
    samples = spark.createDataFrame([("a", float(k)) for k in range(1, 101)], "run_id string, ms double")
    row = experiments.latency(samples).first()
    assert (row.mean_ms, row.p50_ms, round(row.p95_ms, 2), round(row.fps, 3)) == (50.5, 50.5, 95.05, 19.802)


def test_bootstrap_interval_holds_the_estimate(spark):
    units = spark.createDataFrame([(k, k % 3, 3) for k in range(200)], "stem int, num int, den int")
    row = experiments.bootstrap(units, "num", "den")
    row = row.first()
    assert row.low < row.estimate < row.high and row.high - row.low < 0.2


def test_gates(spark):
    full = spark.createDataFrame([("a", 0.8, 10.0)], "run_id string, safety_score double, fp double")
    ok = spark.createDataFrame([("a", 0.79, 15.0)], "run_id string, safety_score double, fp double")
    worse = spark.createDataFrame([("a", 0.77, 10.0)], "run_id string, safety_score double, fp double")
    assert experiments.non_inferior(ok, full).first().accepted and not experiments.non_inferior(worse, full).first().accepted
    assert not experiments.teacher_gate(ok, full).first().accepted
