"""Exact cosine search over pruned tiles.

Unit vectors are put in an order of near directions and cut into tiles. A tile has a centroid and an angular radius; by the triangle inequality two tiles whose
centroids are further apart than both radii and the wanted angle hold no pair. That is decided on the small table of centroids, so that
vectors are shipped for the pairs of tiles that are left alone. A tile's vectors are one binary value, in the width that they came in. Pairs are looked for in single precision with a
bound on its error; what is within that bound is computed in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import cut, ship

#: Rows of a tile, most directions that order them, and rows of the sample that they are fitted to for each.
BLOCK, DIRECTIONS, FIT = 1024, 2048, 8
#: Directions wanted for the rows of a full tile.
TILE_DIRECTIONS = 4
#: Angles near 0 and pi are known to half of a double's digits.
SLACK = 1e-7
#: Tile pairs of the first round of a search for the best; each round takes four times as many.
FIRST_ROUND = 64
#: Pairs of tiles of a round that ships no other tiles.
FEW_PAIRS = 1024
#: Heads of a table, whose tiles stand together while others pass, most bytes of a head's vectors, and tasks of a join. What moves is the table times its heads.
MANY_HEADS, HEAD_BYTES, MOST_TASKS = 8, 1 << 26, 2000
#: Rows of neighbouring tiles that are compared at a time, cosines of which exact values are gathered at a time, and rows after which a task hands on what it found.
MERGED, GATHERED, HANDED = 4096, 1 << 16, 1 << 18


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of very large and small components; zero rows stay, rows with other than finite components become zero."""
    v = np.where(np.isfinite(vectors).all(1, keepdims=True), vectors, 0.0)
    most = np.abs(v).max(1, keepdims=True, initial=0.0)
    v = v / np.where(most > 0, most, 1.0)
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(length > 0, length, 1.0)


def directions(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """``k`` unit vectors at most that the sample's rows gather around: seeds far from each other, then spherical k-means."""
    sample = np.unique(sample[np.abs(sample).sum(1) > 0], axis=0)
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        at = int(np.argmin(near))
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    seeds = sample[chosen]
    for _ in range(rounds):
        owner = np.argmax(sample @ seeds.T, axis=1)
        sums = np.zeros_like(seeds)
        np.add.at(sums, owner, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        seeds = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), seeds)
    return seeds


def flat(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; null components are NaN."""
    least = pc.min_max(pc.list_value_length(column)).as_py()
    if least["min"] != least["max"]:
        raise ValueError(f"vectors of {least['min']} to {least['max']} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tiles(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None, block: int = BLOCK, most: int = DIRECTIONS) -> DataFrame:
    """A written table of tiles: ``tile, n, ids, labels, body, only, centroid, radius``.

    ``body`` holds the vectors as they came, floats as floats and else as doubles, and ``only`` the label that all rows share. Rows without an id or a vector are left out. Directions are fitted to a sample of
    bounded size (``most`` times FIT rows) and order all rows; they decide how much is pruned, never what is found. Rows of no direction (zero vectors) have tiles
    of the widest radius.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    width = "float" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull) else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{width}>").alias("v"), label.alias("label")).filter("id is not null and v is not null")
    total = rows.count()
    wanted = max(1, min(most, TILE_DIRECTIONS * total // block))
    parts = max(1, total // (wanted * FIT))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("v").limit(2 * most * FIT).toPandas()
    seeds = directions(unit(np.stack(sample.v.to_numpy()).astype(float)), wanted) if len(sample) else np.zeros((0, 1))
    kind, kept, spark = rows.schema["id"].dataType, "f4" if width == "float" else "f8", rows.sparkSession
    ship(spark)
    placed = T.StructType.fromDDL("c1 int, c2 int, angle double, body binary, label string").add("id", kind)
    placed_arrow = to_arrow_schema(placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = flat(batch.column(1))
                v = unit(raw.astype(float))
                zero = ~v.any(1)
                if len(seeds):
                    c = v @ seeds.T
                    c1 = np.argmax(c, axis=1)
                    best = c[np.arange(len(v)), c1]
                    c[np.arange(len(v)), c1] = -2.0
                    c2 = np.argmax(c, axis=1)
                else:
                    c1, c2, best = np.zeros(len(v), int), np.zeros(len(v), int), np.zeros(len(v))
                values = (np.where(zero, -1, c1).astype(np.int32), c2.astype(np.int32), np.arccos(np.clip(best, -1, 1)), [r.tobytes() for r in raw], batch.column(2), batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(values, placed_arrow, strict=True)], schema=placed_arrow)

    made = T.StructType.fromDDL("tile long, n int, labels array<string>, body binary, only string, centroid array<double>, radius double").add("ids", T.ArrayType(kind))
    made_arrow = to_arrow_schema(made)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, labels, bodies, cell = [], [], [], None

        def tile() -> pa.RecordBatch:
            body = b"".join(bodies)
            v = unit(np.frombuffer(body, kept).reshape(len(ids), -1).astype(float))
            middle = unit(v.sum(0, keepdims=True))[0]
            radius = float(np.arccos(np.clip(v @ middle, -1, 1)).max()) + SLACK if cell != -1 and middle.any() else np.pi
            only = labels[0] if labels[0] is not None and len(set(labels)) == 1 else None
            values = (base + seq, len(ids), list(labels), body, only, middle.tolist(), radius, list(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(values, made_arrow, strict=True)], schema=made_arrow)

        for batch in batches:
            for c1, body, lab, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (c1 != cell or len(ids) >= block):
                    yield tile()
                    seq += 1
                    ids, labels, bodies = [], [], []
                cell = c1
                ids.append(key)
                labels.append(lab)
                bodies.append(body)
        if ids:
            yield tile()

    order = ["c1", "c2", "angle", "id"]
    size = int(kept[1]) * (len(sample.v.iloc[0]) if len(sample) else 1)
    heads = max(1, min(MANY_HEADS, total), -(-total * size // HEAD_BYTES))
    dealt = rows.mapInArrow(place, placed).repartitionByRange(heads, *order).sortWithinPartitions(*order)
    return cut(dealt.select("c1", "body", "label", "id").mapInArrow(build, made), "tiles")


def block_pairs(rows: DataFrame, block: int, total: int | None = None) -> DataFrame:
    """Adds ``own, ba, bb``: rows dealt to blocks of about ``block`` by a hash of ``id``, each sent to every pair of blocks with its own."""
    n = max(1, -(-(rows.count() if total is None else total) // block))
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.withColumns({"ba": F.least("own", "o"), "bb": F.greatest("own", "o")}).drop("o")


def sides(frame: pd.DataFrame, ba: int, bb: int):
    left = frame[frame.own == ba]
    return left, left if ba == bb else frame[frame.own == bb]


def tile_pairs(table: DataFrame, least: float = -1.0, apart: bool = False) -> DataFrame:
    """``a, b, bound`` (a <= b): pairs of tiles that may hold a pair of cosine ``least`` or more, and the largest cosine that they may hold.

    Only centroids and radii move, one row for each tile. ``apart`` leaves out pairs of tiles that have one label in common and no other.
    """
    small = table.select(F.col("tile").alias("id"), "only", "centroid", "radius")
    ship(table.sparkSession)

    def compare(key, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(frame, *key)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "bound": []})
        x, y = np.stack(left.centroid.to_numpy()), np.stack(right.centroid.to_numpy())
        gap = np.arccos(np.clip(x @ y.T, -1, 1)) - left.radius.to_numpy()[:, None] - right.radius.to_numpy()[None, :] - SLACK
        bound = np.cos(np.clip(gap, 0, np.pi))
        keep = bound >= least - 1e-9
        i, j = left.id.to_numpy(), right.id.to_numpy()
        if key[0] == key[1]:
            keep &= i[:, None] <= j[None, :]
        if apart:
            p, q = (np.array([None if v is None or v != v else v for v in s.only], object) for s in (left, right))
            keep &= (p[:, None] != q[None, :]) | (p == None)[:, None]  # noqa: E711
        at = np.nonzero(keep)
        return pd.DataFrame({"a": np.minimum(i[at[0]], j[at[1]]), "b": np.maximum(i[at[0]], j[at[1]]), "bound": bound[at]})

    return block_pairs(small, BLOCK).groupBy("ba", "bb").applyInPandas(compare, "a long, b long, bound double")


class Tile:
    """Ids, labels and vectors of a tile, or of neighbouring ones, in a task."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray, near: np.ndarray | None = None):
        self.ids, self.labels, self.raw = ids, labels, raw
        #: Unit vectors in single precision.
        self.near = unit(raw.astype(float)).astype(np.float32) if near is None else near

    @property
    def vectors(self) -> np.ndarray:
        """Unit vectors in double precision."""
        return unit(self.raw.astype(float))

    def __getitem__(self, rows: slice) -> Tile:
        return Tile(self.ids[rows], self.labels[rows], self.raw[rows], self.near[rows])


def joined(tiles: list[Tile]) -> Tile:
    return Tile(*(np.concatenate([getattr(t, k) for t in tiles]) for k in ("ids", "labels", "raw", "near")))


def tile_products(table: DataFrame, pairs: DataFrame, kernel: Callable[[Tile, Tile, bool], dict[str, object]], schema: T.StructType | str, merged: int = 0) -> DataFrame:
    """Run ``kernel(left, right, same)`` over pairs of tiles ``a, b``; it returns columns.

    Tiles meet in pairs of heads (MANY_HEADS parts of neighbours, one partition of ``tiles`` each): each tile is shipped once to a pair of heads in which it has a partner, so that what moves is
    the table times the number of heads, which is the same for any table up to MANY_HEADS times HEAD_BYTES. A task holds the tiles of one head and one tile of the other. With ``merged``,
    neighbouring partners of a tile go to the kernel together, up to about so many rows.
    """
    ship(table.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    heads = (table.agg(F.max(F.shiftright("tile", 32))).first()[0] or 0) + 1
    body = table.select("tile", "n", "ids", "labels", "body", F.size("centroid").alias("d"))
    met = pairs.select("a", "b", F.shiftright("a", 32).alias("ha"), F.shiftright("b", 32).alias("hb"))
    left = met.groupBy("ha", "hb", F.col("a").alias("tile")).agg(F.lit(None).cast("array<bigint>").alias("partners"))
    right = met.groupBy("ha", "hb", F.col("b").alias("tile")).agg(F.array_sort(F.collect_list("a")).alias("partners"))
    sides_ = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)))
    # a task of its own for each pair of heads: ha <= hb
    task = F.pmod(F.expr("hb * (hb + 1) div 2 + ha"), F.lit(MOST_TASKS)).cast("int")
    rows = body.join(sides_.hint("merge"), "tile").repartitionById(min(heads * (heads + 1) // 2, MOST_TASKS), task).sortWithinPartitions("ha", "hb", "kind", "tile")
    rows = rows.select("ha", "hb", "partners", "tile", "n", "d", "ids", "labels", "body")

    def spans(place: dict[int, tuple[int, int]], partners: list[int], at: int) -> Iterator[tuple[int, int, bool]]:
        lo = hi = 0
        for p in partners:
            x, y = place[p]
            if hi > lo and (x != hi or y - lo > merged or p == at):
                yield lo, hi, False
                lo = hi = x
            lo, hi = (x, y) if hi == lo else (lo, y)
            if p == at:
                yield lo, hi, True
                lo = hi = 0
        if hi > lo:
            yield lo, hi, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, place, whole = None, [], {}, None
        for batch in batches:
            for k in range(batch.num_rows):
                ha, hb, partners, at, n, d = (batch.column(c)[k].as_py() for c in range(6))
                ids, labels = (np.array(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in (6, 7))
                body = batch.column(8)[k].as_py()
                tile = Tile(ids, labels, np.frombuffer(body, f"f{len(body) // (n * d)}").reshape(n, d))
                if now != (ha, hb):
                    now, held, place, whole = (ha, hb), [], {}, None
                if partners is None:
                    start = place[held[-1][0]][1] if held else 0
                    held.append((at, tile))
                    place[at] = start, start + n
                    continue
                if whole is None:
                    whole, held = joined([t for _, t in held]), []
                found, size = [], 0
                for lo, hi, same in spans(place, partners, at):
                    out = kernel(whole[lo:hi], tile, same)
                    found.append(out)
                    size += len(out[arrow.names[0]])
                    if size >= HANDED:
                        yield gathered(found)
                        found, size = [], 0
                if size:
                    yield gathered(found)

    def gathered(found: list[dict[str, object]]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.array(out[f.name], type=f.type) for out in found if len(out[f.name])]) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def ordered(left: Tile, right: Tile, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smaller and larger id of each pair, and whether they were turned."""
    x, y = left.ids[i], right.ids[j]
    turned = np.asarray(x > y, bool)
    return np.where(turned, y, x), np.where(turned, x, y), turned


def products(left: Tile, right: Tile, same: bool, apart: bool) -> tuple[np.ndarray, float]:
    """Cosines of all pairs of two tiles in single precision, -inf where a pair is not asked for, and a bound on their error."""
    c = left.near @ right.near.T
    if same:
        c[np.tril_indices(len(c))] = -np.inf
    if apart:
        names = {v: k for k, v in enumerate({*left.labels, *right.labels})}
        p, q = (np.array([names[v] for v in t.labels]) for t in (left, right))
        c[p[:, None] == q[None, :]] = -np.inf
    return c, (left.near.shape[1] + 4) * 2.0**-23


def exact(left: Tile, right: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows ``i`` and ``j`` in double precision."""
    if 16 * len(i) > len(left.ids) * len(right.ids):
        return (left.vectors @ right.vectors.T)[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), GATHERED):
        x, y = i[at : at + GATHERED], j[at : at + GATHERED]
        out[at : at + GATHERED] = np.einsum("ij,ij->i", unit(left.raw[x].astype(float)), unit(right.raw[y].astype(float)))
    return out


def above(left: Tile, right: Tile, same: bool, apart: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``i, j`` of all pairs with cosine >= threshold, and their cosines."""
    c, error = products(left, right, same, apart)
    i, j = np.divmod(np.flatnonzero(c >= np.float32(max(threshold - 2 * error, -2.0))), c.shape[1])
    cosine = exact(left, right, i, j)
    keep = cosine >= threshold
    return i[keep], j[keep], cosine[keep]


def cosine_pairs(vectors: DataFrame, threshold: float, id_col: str = "stem", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``src, dst, cosine`` for src < dst with cosine >= threshold, exact in double precision, over pruned tiles.

    Null ids and vectors are left out; a zero vector has the cosine 0 with every other, and one with components that are not finite counts as zero.
    """
    table = tiles(vectors, id_col, vector_col, block=block)
    kind = table.schema["ids"].dataType.elementType

    def kernel(left: Tile, right: Tile, same: bool) -> dict[str, object]:
        i, j, cosine = above(left, right, same, False, threshold)
        src, dst, _ = ordered(left, right, i, j)
        keep = np.asarray(src != dst, bool)
        return {"src": src[keep], "dst": dst[keep], "cosine": cosine[keep]}

    schema = T.StructType().add("src", kind).add("dst", kind).add("cosine", "double")
    return tile_products(table, tile_pairs(table, threshold), kernel, schema, MERGED)


def pairs_in_buckets(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, buckets_col: str, block: int = BLOCK) -> DataFrame:
    """``src, dst, cosine`` as ``cosine_pairs``, of rows that share a bucket in one hash table at least: ``buckets_col`` has a row's bucket in each table, joined by commas.

    A pair meets once, whatever number of buckets it shares: no candidates are written out.
    """
    table = tiles(vectors, id_col, vector_col, buckets_col, block)
    kind = table.schema["ids"].dataType.elementType

    def buckets(tile: Tile, rows: np.ndarray) -> np.ndarray:
        own, at = np.unique(rows, return_inverse=True)
        return np.array([x.split(",") for x in tile.labels[own]], "U11").reshape(len(own), -1)[at]

    def kernel(left: Tile, right: Tile, same: bool) -> dict[str, object]:
        i, j, cosine = above(left, right, same, False, threshold)
        if len(i):
            shared = (buckets(left, i) == buckets(right, j)).any(1)
            i, j, cosine = i[shared], j[shared], cosine[shared]
        src, dst, _ = ordered(left, right, i, j)
        keep = np.asarray(src != dst, bool)
        return {"src": src[keep], "dst": dst[keep], "cosine": cosine[keep]}

    schema = T.StructType().add("src", kind).add("dst", kind).add("cosine", "double")
    return tile_products(table, tile_pairs(table, threshold), kernel, schema, MERGED)


def best_across(table: DataFrame, limit: int) -> tuple[list, int, int]:
    """The ``limit`` most similar pairs of rows of different labels, ties by both ids downwards; the tile pairs read, and all.

    Best first: tile pairs go in rounds, largest bound first, and the search ends when no bound that is left reaches the ``limit``-th best so far. Each tile pair
    returns its own ``limit`` best, and ``limit`` rows of a round reach the driver.
    """
    kind = table.schema["ids"].dataType.elementType

    def kernel(left: Tile, right: Tile, same: bool) -> dict[str, object]:
        c, error = products(left, right, same, True)
        at = np.flatnonzero(c >= np.float32(max(reached - 2 * error, -2.0)))
        if len(at) > limit:
            near = c.ravel()[at]
            at = at[near >= np.partition(near, -limit)[-limit] - np.float32(3 * error)]
        i, j = np.divmod(at, c.shape[1])
        src, dst, turned = ordered(left, right, i, j)
        p, q = left.labels[i], right.labels[j]
        out = pd.DataFrame({"src": src, "dst": dst, "cosine": exact(left, right, i, j), "left_split": np.where(turned, q, p), "right_split": np.where(turned, p, q)})
        return dict(out.sort_values(["cosine", "src", "dst"], ascending=False).head(limit).items())

    schema = T.StructType().add("src", kind).add("dst", kind).add("cosine", "double").add("left_split", "string").add("right_split", "string")
    order = [F.desc("bound"), F.asc("a"), F.asc("b")]
    pairs = cut(tile_pairs(table, apart=True), "tile-pairs")
    total = pairs.count()
    best: list = []
    left, read, width, reached = pairs, 0, FIRST_ROUND, -2.0
    while True:
        now = cut(left.orderBy(*order).limit(width), "round")
        edge = now.orderBy(F.asc("bound"), F.desc("a"), F.desc("b")).first()
        if edge is None:
            break
        read += now.count()
        some = table
        if width <= FEW_PAIRS:  # few tiles: the others need not move
            some = table.filter(F.col("tile").isin([r[0] for r in now.select(F.explode(F.array("a", "b"))).distinct().collect()]))
        found = tile_products(some, now, kernel, schema, MERGED).orderBy(F.desc("cosine"), F.desc("src"), F.desc("dst")).limit(limit).collect()
        best = sorted([*best, *found], key=lambda r: (r.cosine, r.src, r.dst), reverse=True)[:limit]
        reached = best[-1].cosine - 1e-9 if len(best) == limit else -2.0
        after = (F.col("bound") < edge.bound) | ((F.col("bound") == edge.bound) & ((F.col("a") > edge.a) | ((F.col("a") == edge.a) & (F.col("b") > edge.b))))
        left, width = pairs.filter(after & (F.col("bound") >= reached)), 4 * width
    return best, read, total


def top_across(vectors: DataFrame, label_col: str, limit: int, id_col: str = "stem", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``src, dst, cosine, left_split, right_split`` of ``best_across``."""
    table = tiles(vectors.filter(F.col(label_col).isNotNull()), id_col, vector_col, label_col, block)
    kind = table.schema["ids"].dataType.elementType
    schema = T.StructType().add("src", kind).add("dst", kind).add("cosine", "double").add("left_split", "string").add("right_split", "string")
    return vectors.sparkSession.createDataFrame([tuple(r) for r in best_across(table, limit)[0]], schema)


def extremes_across(table: DataFrame, threshold: float) -> tuple[int, float]:
    """Pairs of rows of different labels with cosine >= threshold, and the largest cosine of all such pairs (-1 without any)."""

    def kernel(left: Tile, right: Tile, same: bool) -> dict[str, object]:
        cosine = above(left, right, same, True, threshold)[2]
        return {"n": [len(cosine)], "c": [float(cosine.max(initial=-np.inf))]}

    row = tile_products(table, tile_pairs(table, threshold, apart=True), kernel, "n long, c double", MERGED).agg(F.sum("n").alias("n"), F.max("c").alias("c")).first()
    if row.n:
        return row.n, row.c
    best = best_across(table, 1)[0]
    return 0, best[0].cosine if best else -1.0
