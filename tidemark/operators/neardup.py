"""Near-duplicate joins: Hamming distance of 64-bit hashes, cosine of embeddings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.vectors import hamming
from tidemark.operators.cosine import BLOCK, cosine_pairs, extremes_across, pairs_in_buckets, tiles, top_across
from tidemark.session import cut, ship

#: Copies of a hash that stand under one key of an expansion.
COPIES = 1024
#: Least and most hashes of a block of arrays, distances held at a time, comparisons of arrays that cost what a key of a join does, and keys that a task makes.
HASH_BLOCKS, SLICE, JOINED, KEYS = (4096, 1 << 18), 1 << 18, 500, 1_000_000
#: Comparisons of arrays that cost what the call for a bucket does, what a probe of it does, what a hash that it gathers does, and most bits of a bucket's number.
CALL, PROBE, GATHERED, BUCKET = 50_000, 2_000, 4, 16
#: Most bits that are probed for, and most probes of a block.
PROBED, MOST_PROBES = 20, 50_000


def _probes(radius: int, width: int) -> list[int]:
    """All patterns of at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(width), k)]


def _blocks(threshold: int, m: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of m blocks of bits: radii, each plus one, add up to the threshold plus one, so that not all blocks can differ by more than theirs."""
    edges = [64 * k // m for k in range(m + 1)]
    spare = threshold + 1 - m
    return [(edges[k], edges[k + 1] - edges[k], spare // m + (k < spare % m)) for k in range(m)]


def _counts(plan: list[tuple[int, int, int]]) -> list[int]:
    """Probes of each block."""
    return [sum(comb(w, r) for r in range(radius + 1)) for _, w, radius in plan]


def probe_plan(threshold: int, rows: int) -> tuple[float, list[tuple[int, int, int]]]:
    """Keys and candidates of a hash, and (shift, width, radius) of each block: the number of blocks that leaves the fewest for so many distinct hashes."""
    best = None
    for m in range(min(2, threshold + 1), threshold + 2):
        plan = _blocks(threshold, m)
        probes = _counts(plan)
        cost = m + sum(n * (1 + rows / 2**w) for n, (_, w, _) in zip(probes, plan, strict=True))
        if max(probes) <= MOST_PROBES and (best is None or cost < best[0]):
            best = cost, plan
    return best


def bucket_plan(threshold: int, left: int, right: int) -> tuple[float, list[tuple[int, int, int]] | None]:
    """Comparisons that two arrays of so many hashes cost, and the blocks of ``_blocks`` whose buckets are compared; none where comparing all pairs costs less."""
    best = left * right, None
    for m in range(-(-64 // BUCKET), min(threshold + 1, 32) + 1):
        plan = _blocks(threshold, m)
        cost = sum(2**w * (CALL + n * PROBE) + n * right * (left / 2**w + GATHERED) for n, (_, w, _) in zip(_counts(plan), plan, strict=True))
        if cost < best[0]:
            best = cost, plan
    return best


def _probed_pairs(distinct: DataFrame, threshold: int, plan: list[tuple[int, int, int]]) -> DataFrame:
    bits = lambda h, shift, width: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    left = distinct.select(F.col("h").alias("a"), F.inline(F.array(*[F.struct(F.lit(n).alias("band"), bits(F.col("h"), s, w).alias("bits")) for n, (s, w, _) in enumerate(plan)])))
    parts = []
    for n, (shift, width, radius) in enumerate(plan):
        patterns = F.from_json(F.lit(json.dumps(_probes(radius, width))), "array<bigint>")  # folded to one literal
        parts.append(distinct.select(F.col("h").alias("b"), F.lit(n).alias("band"), F.explode(patterns).alias("p")).withColumn("bits", bits(F.col("b"), shift, width).bitwiseXOR(F.col("p"))).drop("p"))
    right = parts[0]
    for part in parts[1:]:
        right = right.unionByName(part)
    # a pair meets once in each block within its radius: the first of them keeps it
    far = [F.bit_count(bits(F.col("a").bitwiseXOR(F.col("b")), s, w)) > r for s, w, r in plan]
    first = F.lit(True)
    for n in range(1, len(plan)):
        first &= (F.col("band") < n) | far[n - 1]
    near = left.join(right.hint("merge"), ["band", "bits"]).filter((F.col("a") < F.col("b")) & first & (hamming(F.col("a"), F.col("b")) <= threshold))
    return near.select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def _all_near(left: np.ndarray, right: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``x, y, distance`` of all pairs of two arrays within the threshold, SLICE distances at a time."""
    for lo in range(0, len(right), SLICE):
        part = right[lo : lo + SLICE]
        step = max(1, SLICE // len(part))
        for at in range(0, len(left), step):
            apart = np.bitwise_count((left[at : at + step, None] ^ part[None, :]).view(np.uint64)).ravel()
            found = np.flatnonzero(apart <= threshold)
            if len(found):
                yield left[at + found // len(part)], part[found % len(part)], apart[found]


def _near(left: np.ndarray, right: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same, each pair once: buckets of equal bits of a block are compared with those within the block's radius, where that is less work on these arrays."""
    whole, plan = bucket_plan(threshold, len(left), len(right))
    bits = lambda h, shift, width: (h.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
    tables, cost = [], 0
    for shift, width, radius in plan or []:
        of = [bits(h, shift, width) for h in (left, right)]
        sizes = [np.bincount(b, minlength=1 << width) for b in of]
        patterns, places = np.array(_probes(radius, width)), np.arange(1 << width)
        cost += sum(int(sizes[0] @ sizes[1][places ^ p]) for p in patterns)
        tables.append((of, sizes, patterns))
    if not plan or cost > len(left) * len(right):  # few buckets hold most
        yield from _all_near(left, right, threshold)
        return
    for n, (of, sizes, patterns) in enumerate(tables):
        (l, r), (l_end, r_end) = (h[np.argsort(b, kind="stable")] for h, b in zip((left, right), of, strict=True)), (np.cumsum(z) for z in sizes)
        for bucket in np.flatnonzero(sizes[0]).tolist():
            at = patterns ^ bucket
            at = at[sizes[1][at] > 0]
            if not len(at):
                continue
            ends = r_end[at]
            probed = np.concatenate([r[a:b] for a, b in zip((ends - sizes[1][at]).tolist(), ends.tolist(), strict=True)])
            for x, y, apart in _all_near(l[l_end[bucket] - sizes[0][bucket] : l_end[bucket]], probed, threshold):
                # a pair meets once in each block within its radius: the first of them keeps it
                keep = np.ones(len(x), bool)
                for shift, width, radius in plan[:n]:
                    keep &= np.bitwise_count(bits(x ^ y, shift, width)) > radius
                if keep.any():
                    yield x[keep], y[keep], apart[keep]


def _hash_blocks(rows: int) -> tuple[int, int]:
    """Hashes of a block, and number of blocks."""
    block = min(HASH_BLOCKS[1], max(HASH_BLOCKS[0], rows // 16))
    return block, max(1, -(-rows // block))


def _tiled_pairs(distinct: DataFrame, threshold: int, rows: int) -> DataFrame:
    """All pairs of blocks of hashes, compared as arrays: a task holds two blocks and a slice of their distances at a time. What moves are pieces of blocks, packed."""
    ship(distinct.sparkSession)
    n = _hash_blocks(rows)[1]
    packed = T.StructType.fromDDL("own int, piece binary")
    schema = T.StructType.fromDDL("a long, b long, distance int")
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, h = (batch.column(k).to_numpy() for k in range(2))
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            pieces = [p.tobytes() for p in np.split(h, starts[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own[starts], pa.int32()), pa.array(pieces, pa.binary())], schema=to_arrow_schema(packed))

    own = distinct.select(F.pmod(F.xxhash64("h"), F.lit(n)).cast("int").alias("own"), "h")
    pieces = own.repartition(n, "own").sortWithinPartitions("own").mapInArrow(pack, packed)
    dealt = pieces.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"ba": F.least("own", "o"), "bb": F.greatest("own", "o")})
    dealt = dealt.repartition(n * (n + 1) // 2, "ba", "bb").sortWithinPartitions("ba", "bb").select("ba", "bb", "own", "piece")

    def batch_of(found: list) -> pa.RecordBatch:
        x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(x, y), np.maximum(x, y), apart.astype(np.int32))], schema=arrow)

    def compare(ba: int, bb: int, held: list) -> Iterator[pa.RecordBatch]:
        sides = [np.concatenate([np.frombuffer(p, np.int64) for own, p in held if own == side] or [np.zeros(0, np.int64)]) for side in (ba, bb)]
        found, size = [], 0
        for x, y, apart in _near(*sides, threshold):
            if ba == bb:
                once = x < y
                x, y, apart = x[once], y[once], apart[once]
            found.append((x, y, apart))
            size += len(x)
            if size >= SLICE:
                yield batch_of(found)
                found, size = [], 0
        if size:
            yield batch_of(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for ba, bb, own, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now is not None and now != (ba, bb):
                    yield from compare(*now, held)
                    held = []
                now = (ba, bb)
                held.append((own, piece))
        if held:
            yield from compare(*now, held)

    return dealt.mapInArrow(run, schema)


def hash_classes(hashes: DataFrame, id_col: str = "stem", hash_col: str = "h") -> DataFrame:
    """``id, h, class_id``: membership in classes of equal hashes, named by their smallest id; ids and hashes that are null are left out."""
    rows = hashes.select(F.col(id_col), F.col(hash_col).alias("h")).filter(F.col(id_col).isNotNull() & F.col("h").isNotNull())
    return rows.join(rows.groupBy("h").agg(F.min(id_col).alias("class_id")).hint("merge"), "h").select(id_col, "h", "class_id")


def class_pairs(hashes: DataFrame, threshold: int, id_col: str = "stem", hash_col: str = "h") -> DataFrame:
    """``a_class, b_class, distance`` for classes a < b of different hashes within the threshold: with ``hash_classes`` all pairs there are, and none written out."""
    names = hashes.filter(F.col(id_col).isNotNull() & F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("class"))
    names = cut(names, "classes")
    a, b = (names.select(F.col("h").alias(x), F.col("class").alias(f"{x}_name")) for x in "ab")
    near = hash_pairs(names, threshold).join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return near.select(F.least("a_name", "b_name").alias("a_class"), F.greatest("a_name", "b_name").alias("b_class"), "distance")


def hash_pairs(hashes: DataFrame, threshold: int, hash_col: str = "h") -> DataFrame:
    """``a, b, distance`` for distinct hashes a < b with distance <= threshold: classes of equal hashes are one row each.

    Pairs of blocks as arrays, by buckets of near bits or all pairs, where that is less work than keys and candidates of a join (JOINED), and beyond 20 bits, where most hashes of a corpus are near each other. Else,
    up to 8 bits, where that leaves fewer keys and candidates: of threshold + 3 blocks of bits three agree at least, so that an equi-join on three blocks (17 to 63 bits wide)
    finds every pair. Otherwise up to 20 bits: blocks of bits with a radius each that add up, with one more for each but one, to the threshold: one block differs in no more bits than its radius,
    and one side probes that radius (``probe_plan``).
    """
    distinct = cut(hashes.select(F.col(hash_col).alias("h")).filter("h is not null").distinct(), "hashes")
    rows = distinct.count()
    if threshold > PROBED:
        return _tiled_pairs(distinct, threshold, rows)
    probed, plan = probe_plan(threshold, rows)
    agreeing = comb(threshold + 3, 3) * (2 + rows / 2 ** (3 * 64 // (threshold + 3)))
    least = probed if threshold > 8 else min(probed, agreeing)
    block, n = _hash_blocks(rows)
    block = max(1, min(block, rows))
    if JOINED * n + n / 2 * bucket_plan(threshold, block, block)[0] / block <= JOINED * least:  # its copies, and what they are compared with
        return _tiled_pairs(distinct, threshold, rows)
    distinct = distinct.repartition(int(rows * least) // KEYS + 1, "h")  # dealt before it grows
    if threshold > 8 or probed < agreeing:
        return _probed_pairs(distinct, threshold, plan)
    edges = [64 * k // (threshold + 3) for k in range(threshold + 4)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(threshold + 3), 3)]
    keys = F.array(*[F.struct(F.lit(n).alias("band"), F.col("h").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for n, m in enumerate(masks)])
    rows = distinct.select("h", F.inline(keys))
    left, right = rows.withColumnRenamed("h", "a"), rows.withColumnRenamed("h", "b")
    near = left.join(right.hint("merge"), ["band", "bits"]).filter((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold))
    return near.select("a", "b").distinct().withColumn("distance", hamming(F.col("a"), F.col("b")))


def hamming_edges(hashes: DataFrame, threshold: int, id_col: str = "stem", hash_col: str = "h") -> DataFrame:
    """``src, dst``: links enough to connect all ids within ``threshold`` bits: each id with the smallest of its hash, and those of near hashes.

    What grouping needs; copies of a hash add one link each, not all their pairs.
    """
    rows = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("id is not null and h is not null")
    low = rows.groupBy("h").agg(F.min("id").alias("low"))
    copies = rows.join(low.hint("merge"), "h").filter("id <> low").select(F.col("low").alias("src"), F.col("id").alias("dst"))
    near = hash_pairs(rows, threshold).join(low.select(F.col("h").alias("a"), F.col("low").alias("x")).hint("merge"), "a").join(low.select(F.col("h").alias("b"), F.col("low").alias("y")).hint("merge"), "b")
    return near.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).unionByName(copies)


def hamming_pairs(hashes: DataFrame, threshold: int, id_col: str = "stem", hash_col: str = "h") -> DataFrame:
    """``src, dst, distance`` for src < dst with distance <= threshold: ``hash_pairs`` expanded to all pairs of ids.

    A hash of many copies has as many pairs as their square, which are written out in blocks of COPIES by COPIES rows, so that no key is hot; where
    classes or links are enough, take ``class_pairs`` or ``hamming_edges``.
    """
    if not 0 <= threshold <= 64:
        raise ValueError("a threshold of 0 to 64 bits is needed")
    rows = cut(hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("id is not null and h is not null"), "hash-rows")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / COPIES), F.lit(1)).cast("int")
    classes = cut(rows.groupBy("h").agg(blocks.alias("blocks")), "hash-blocks")
    dealt = rows.join(classes.hint("merge"), "h").select("id", "h", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda x: classes.select(F.col("h").alias(x), F.col("blocks").alias(f"{x}_blocks"))
    near = hash_pairs(classes, threshold).unionByName(classes.select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("distance")))
    met = near.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("i", upto("a_blocks")).withColumn("j", upto("b_blocks")).filter("a <> b or i <= j")
    met = met.join(dealt.select(F.col("h").alias("a"), F.col("block").alias("i"), F.col("id").alias("x")).hint("merge"), ["a", "i"])
    met = met.join(dealt.select(F.col("h").alias("b"), F.col("block").alias("j"), F.col("id").alias("y")).hint("merge"), ["b", "j"])
    met = met.filter("x <> y and (a <> b or i <> j or x < y)")
    return met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "distance")


def cosine_pairs_lsh(vectors: DataFrame, threshold: float, id_col: str = "stem", vector_col: str = "embedding", tables: int = 12, bucket: float = 1.0) -> DataFrame:
    """The same pairs by random projections, then exactly verified; may miss some (see ``recall_of``).

    Those that Spark's ``approxSimilarityJoin`` with this model finds: pairs that share a bucket in one table at least. That join writes every candidate out once for each bucket shared, and where
    buckets are wide (unit vectors fall into two of width 1) those are nearly all pairs several times; here rows with their buckets meet as arrays over tiles (``cosine.pairs_in_buckets``).
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.functions.vectors import l2_normalise

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    unit = rows.withColumn("f", array_to_vector(l2_normalise(F.col("v"))))
    if rows.isEmpty():
        return cosine_pairs(rows, threshold, "id", "v")
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="buckets", bucketLength=bucket, numHashTables=tables, seed=42).fit(unit)
    buckets = F.concat_ws(",", *[vector_to_array(F.col("buckets")[k])[0].cast("int").cast("string") for k in range(tables)])
    return pairs_in_buckets(cut(model.transform(unit).select("id", "v", buckets.alias("in")), "buckets"), threshold, "id", "v", "in")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``pairs, found, recall`` of an approximate join against the exact one."""
    hit = exact.join(found.select("src", "dst").distinct().withColumn("hit", F.lit(1)).hint("merge"), ["src", "dst"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.col("found") / F.greatest("pairs", F.lit(1)))


def union_edges(phash: DataFrame, embedding: DataFrame) -> DataFrame:
    """``src, dst, kind, score``: both kinds of edges, kept apart (count before removing doubles)."""
    return phash.select("src", "dst", F.lit("phash").alias("kind"), F.col("distance").cast("double").alias("score")).unionByName(
        embedding.select("src", "dst", F.lit("embedding").alias("kind"), F.col("cosine").alias("score"))
    )


def across_splits(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose ends are in different splits, with ``left_split, right_split``."""
    left = members.select(F.col("stem").alias("src"), F.col("split").alias("left_split"))
    right = members.select(F.col("stem").alias("dst"), F.col("split").alias("right_split"))
    return pairs.join(left.hint("merge"), "src").join(right.hint("merge"), "dst").filter("left_split <> right_split")


def top_across_splits(vectors: DataFrame, members: DataFrame, limit: int = 20, block: int = BLOCK) -> DataFrame:
    """``src, dst, cosine, left_split, right_split``: the ``limit`` most similar pairs of different splits, whatever their cosine.

    Best first over tiles (``cosine.best_across``). Order as ``top_pairs``.
    """
    rows = members.join(vectors, "stem").select("stem", "split", "embedding")
    return top_pairs(top_across(rows, "split", limit, block=block), limit)


def top_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Most similar first; ties by both ids, descending."""
    return pairs.orderBy(F.desc("cosine"), F.desc("src"), F.desc("dst")).limit(limit)


def cross_split_extremes(hashes: DataFrame, vectors: DataFrame, members: DataFrame, phash_threshold: int, cosine_threshold: float, block: int = BLOCK) -> DataFrame:
    """One row: violations of both kinds, smallest distance and largest cosine between splits, over all pairs.

    ``hashes(stem, h)``, ``vectors(stem, embedding)``, ``members(stem, split)``. Cosines come from pruned tiles, distances from classes of equal hashes and their
    counts in each split; where no pair lies within the threshold, the radius grows until one is found. Without any pair the distance is 64 and the cosine -1.
    """
    own = members.select("stem", "split").filter("split is not null")
    table = tiles(own.join(vectors, "stem"), "stem", "embedding", "split", block)
    embedding, most = extremes_across(table, cosine_threshold)
    phash, least = _hash_extremes(own.join(hashes, "stem").filter("h is not null"), phash_threshold)
    schema = "cross_split_phash_violations long, minimum_cross_split_phash_distance int, cross_split_embedding_violations long, maximum_cross_split_cosine double"
    return members.sparkSession.createDataFrame([(phash, least, embedding, most)], schema)


def _hash_extremes(rows: DataFrame, threshold: int) -> tuple[int, int]:
    """Pairs of rows of different splits within ``threshold`` bits, and the smallest distance of all such pairs (64 without any)."""
    counts = cut(rows.groupBy("h", "split").agg(F.count(F.lit(1)).alias("n")), "hash-splits")
    whole = counts.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("splits"))
    equal = whole.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0)).cast("long")).first()[0]
    if counts.select("split").distinct().limit(2).count() < 2:
        return 0, 64
    radius = threshold
    while True:
        near = hash_pairs(counts.select("h"), radius)
        left, right = (counts.select(F.col("h").alias(x), F.col("split").alias(f"{x}_split"), F.col("n").alias(f"{x}_n")) for x in "ab")
        across = near.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("a_split <> b_split")
        row = across.agg(F.coalesce(F.sum(F.when(F.col("distance") <= threshold, F.col("a_n") * F.col("b_n"))), F.lit(0)).alias("n"), F.min("distance").alias("d")).first()
        if equal or row.d is not None or radius == 64:
            return equal + row.n, 0 if equal else 64 if row.d is None else row.d
        radius = radius + 4 if radius < PROBED else 64
