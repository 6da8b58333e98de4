"""Connected components as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.forest import Forest
from tidemark.session import cut, drop_cut, ship


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge table: equal digests mean that a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def thinned(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 1_000_000) -> DataFrame:
    """``src, dst``: of each ``most`` edges of a task only those that connect what was apart, which leaves the components as they are. Ids are numbers; nulls and loops go."""
    kind = edges.schema[src].dataType
    schema = T.StructType().add("src", kind).add("dst", kind)
    arrow = to_arrow_schema(schema)
    ship(edges.sparkSession)

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy() for r in held]) for k in range(2))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = Forest(len(ids)).add(at[: len(a)], at[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(ids[v], type=f.type) for v, f in zip((x, y), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield forest(held)
                held, size = [], 0
        if held:
            yield forest(held)

    rows = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    return rows.mapInArrow(run, schema)


def connected_components(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    src: str = "src",
    dst: str = "dst",
    vertex: str = "id",
    max_rounds: int = 60,
) -> DataFrame:
    """Smallest reachable id for each vertex: ``(vertex, component)``.

    Alternates two star contractions (each vertex links its larger neighbours, then its smaller ones, to the
    smallest it knows); a path of n vertices needs O(log n) rounds. Minima come from partial aggregation and are joined back by sorting (packed files
    look small enough to broadcast long before they are), so that a hub's edges can be split by the skew join. Each round is written to the shared folder. Null ids and loops
    are ignored; ``vertices`` adds the isolated ones.
    """
    u, v = F.col("u"), F.col("v")
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    state = cut(raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _fingerprint(state)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = state.unionByName(state.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(v > u).join(low.hint("merge"), "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low.hint("merge"), "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = cut(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = _fingerprint(after)
        drop_cut(state)
        state = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = state.groupBy("u").agg(F.min("v").alias("component"))
    roots = state.select(v.alias("u"), v.alias("component")).distinct()
    labels = labels.unionByName(roots).select(u.alias(vertex), "component")
    if vertices is None:
        return labels
    ids = vertices.select(F.col(vertex)).distinct()
    return ids.join(labels.hint("merge"), vertex, "left").select(vertex, F.coalesce("component", vertex).alias("component"))


def group_members(edges: DataFrame, vertices: DataFrame, src: str = "src", dst: str = "dst", vertex: str = "stem") -> DataFrame:
    """``stem, group_id`` (smallest member) for every vertex, isolated ones too."""
    return connected_components(edges, vertices, src, dst, vertex).withColumnRenamed("component", "group_id")


def groups(members: DataFrame) -> DataFrame:
    """``group_id, size, first``, largest first, then by id; ``members`` itself lists who belongs to a group, so that none is gathered in one value."""
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("stem").alias("first")).orderBy(F.desc("size"), "group_id")
