import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.sharding import Leaf, even_tree, grown, shard_rows, tree_shard, write_shards

SCHEMA = "doc_id long, text string, slot string, region int, tie int"


def brute(key, tree):
    """Descend by the smallest draw."""
    key = "" if key is None else str(key)

    def pick(level, k, inside):
        weights = defaultdict(float)
        for leaf in inside:
            weights[leaf[k]] += leaf.weight
        u = {n: (int(hashlib.sha256(f"{key}:{level}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for n in weights}
        return min(weights, key=lambda n: (-math.log(u[n]) / weights[n], n))

    region = pick("region", 0, tree)
    rack = pick("rack", 1, [x for x in tree if x.region == region])
    return pick("shard", 2, [x for x in tree if x.rack == rack])


def placed(spark, tree, n=4000):
    return dict(map(tuple, spark.range(n).select("id", tree_shard(F.col("id").cast("string"), tree).alias("s")).collect()))


UNEVEN = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(0, 1, 2, 2.0), Leaf(5, 9, 7, 4.0), Leaf(5, 9, 4, 0.5)]


@pytest.mark.parametrize("tree", [even_tree(16), even_tree(5), UNEVEN, [Leaf(2, 3, 4)]])
def test_shards_equal_brute_force(spark, tree):
    got = placed(spark, tree, 400)
    assert got == {k: brute(k, tree) for k in range(400)}


def test_rows_of_shards(spark):
    docs = [(n, None if n % 9 == 0 else "é" * (n % 50), "x", 1, 2) for n in range(500)] + [(None, "no id", "x", 1, 2)] * 3 + [(7, "again", "x", 1, 2)] * 40 + [(900, "long " * 60_000, "x", 1, 2)]
    got = shard_rows(spark.createDataFrame(docs, SCHEMA).repartition(6), even_tree(16)).collect()
    assert len(got) == len(docs)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute(d, even_tree(16)), brute(d, grown(even_tree(16)))) for d, t, *_ in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        ids = [-1 if d is None else d for _, d in own]
        assert ids == sorted(ids)
    assert shard_rows(spark.createDataFrame([], SCHEMA), even_tree(16)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for tree in (even_tree(16), even_tree(11), UNEVEN, grown(even_tree(16))):
        before, after = placed(spark, tree), placed(spark, grown(tree))
        new = grown(tree)[-1].shard
        moved = {k for k in before if before[k] != after[k]}
        assert {after[k] for k in moved} == {new}
        share = 1 / (1 + sum(x.weight for x in tree))
        assert abs(len(moved) / len(before) - share) < 4 * math.sqrt(share / len(before))


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    heavier = [x._replace(weight=9.0) if x.shard == 2 else x for x in even_tree(16)]
    before, after = placed(spark, even_tree(16)), placed(spark, heavier)
    moved = [k for k in before if before[k] != after[k]]
    place = {x.shard: x for x in even_tree(16)}
    assert moved
    for k in moved:
        a, b = place[before[k]], place[after[k]]
        assert b.region == 0  # the changed region takes rows
        if a.region == 0:  # and inside it only the changed rack, and inside that only the changed shard
            assert b.rack == 0 and (a.rack != 0 or b.shard == 2)
    swapped = [x._replace(weight=2.0 if x.shard == 8 else 1.0) for x in even_tree(16)]
    other = placed(spark, swapped)
    assert all(place[other[k]].region == 1 for k in before if before[k] != other[k])


def test_rows_go_by_weight(spark):
    got = Counter(placed(spark, UNEVEN, 20_000).values())
    total = sum(x.weight for x in UNEVEN)
    for leaf in UNEVEN:
        assert abs(got[leaf.shard] / 20_000 - leaf.weight / total) < 0.015


def test_written_shards_are_the_rows(spark, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('t', id) as text", "1.5 as other")
    write_shards(docs, f"file://{tmp_path}/out", even_tree(16), rows_in_file=10)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(back.columns) == ["doc_id", "other", "shard", "text"] and back.count() == 300
    assert dict(map(tuple, back.select("doc_id", "shard").collect())) == {k: brute(k, even_tree(16)) for k in range(300)}
    with pytest.raises(ValueError, match="of the name"):
        write_shards(back, f"file://{tmp_path}/again", even_tree(16))


@pytest.mark.parametrize("tree", [[], [Leaf(0, 0, 0, 0.0)], [Leaf(0, 0, 1), Leaf(0, 1, 1)], [Leaf(0, 0, 1), Leaf(1, 0, 2)]])
def test_trees_are_checked(tree):
    with pytest.raises(ValueError, match="shard"):
        tree_shard(F.lit("k"), tree)
