"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of a label are dealt to tiles; each pair of tiles is one matrix product of int8 values (exact in float32 arithmetic up to 1040
dimensions, beyond that in float64). A bound on each vector's quantisation error tells which pairs may reach the
threshold, and only those are computed in double precision. Equal vectors of a label are one vector with a count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tiles import Forest, tiled
from tidemark.operators.graph import connected_components
from tidemark.session import cut, drop_cut, ship

#: Vectors of a tile.
TILE = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, and the length of the rounding error of each unit vector."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (doubles) with cosine >= threshold."""
    la, lb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    (qa, sa, ea), (qb, sb, eb) = quantise(a / la[:, None]), quantise(b / lb[:, None])
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    rough = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    # |x.y - x'.y'| <= |x'||e_y| + |e_x||y'| + |e_x||e_y|, and |x'| <= 1 + |e_x|; the last term covers rounding
    bound = eb[None, :] * (1 + ea)[:, None] + ea[:, None] * (1 + eb)[None, :] + ea[:, None] * eb[None, :] + 1e-9
    i, j = np.nonzero(rough + bound >= threshold)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 65_536):
        x, y = i[at : at + 65_536], j[at : at + 65_536]
        keep[at : at + 65_536] = (a[x] * b[y]).sum(1) / (la[x] * lb[y]) >= threshold
    return i[keep], j[keep]


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, most: int = TILE
) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Vectors link within one label (null links with nothing) at cosine >= ``threshold`` in double precision; null, zero or
    empty vectors, and those with null or non-finite components, link with nothing and are their own component, as are
    vectors of other lengths than those they meet. ``n_links`` counts other rows linked directly (equal vectors link),
    ``component_id`` is the smallest id reachable and ``kept`` tells that the row has it. Rows that repeat an id are
    vectors of their own for the count. Other columns are ignored; an empty table gives an empty result. A task gets two tiles of at most
    ``most`` vectors and returns counts and a forest of links, not all pairs.
    """
    ship(vectors.sparkSession)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # the label's length stands first, so that no label with a part of a vector reads like another label with another vector
    name = F.col("label").cast("string")
    rows = rows.withColumn("same", F.when(usable, F.sha2(F.concat_ws(",", F.length(name).cast("string"), name, v.cast("array<string>")), 256)))
    rows = cut(rows, "vectors")
    known = rows.filter("same is not null")
    classes = known.groupBy("same").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.size("v"))), "classes")
    dealt = tiled(classes, "label", F.col("same"), most)

    def link(key, frame: pd.DataFrame) -> pd.DataFrame:
        _, ta, tb = key
        left = frame[frame.tile == ta]
        right = left if ta == tb else frame[frame.tile == tb]
        if not len(left) or not len(right):
            return pd.DataFrame({"same": [], "other": [], "links": []})
        a, b = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
        forest, edges = Forest(len(a) + len(b) * (ta != tb)), []
        count = np.zeros(len(a) + len(b) * (ta != tb), np.int64)
        weight_a, weight_b = left.copies.to_numpy(), right.copies.to_numpy()
        shift = 0 if ta == tb else len(a)
        for at in range(0, len(a), 512):
            i, j = tile_links(a[at : at + 512], b, threshold)
            i = i + at
            if ta == tb:
                i, j = i[i != j], j[i != j]
                np.add.at(count, i, weight_b[j])
            else:
                np.add.at(count, i, weight_b[j])
                np.add.at(count, j + shift, weight_a[i])
            edges.append(forest.add(i, j + shift))
        names = left.same.to_numpy() if ta == tb else np.concatenate([left.same.to_numpy(), right.same.to_numpy()])
        has = np.flatnonzero(count)
        x = np.concatenate([e[0] for e in edges])
        y = np.concatenate([e[1] for e in edges])
        return pd.DataFrame({
            "same": np.concatenate([names[has], names[x]]),
            "other": np.concatenate([np.full(len(has), None, object), names[y]]),
            "links": np.concatenate([count[has], np.zeros(len(x), np.int64)]),
        })

    found = cut(dealt.groupBy("label", "ta", "tb").applyInPandas(link, "same string, other string, links bigint"), "links")
    counts = found.filter("other is null").groupBy("same").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("other is not null").select(F.col("same").alias("src"), F.col("other").alias("dst")))
    named = classes.select("same", "low", "copies").join(parts.select(F.col("id").alias("same"), "component"), "same", "left")
    named = cut(named.join(counts, "same", "left").select(
        "same", "low", F.coalesce("component", "same").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ), "named")
    drop_cut(found)
    drop_cut(classes)
    best = named.groupBy("component").agg(F.min("low").alias("component_id"))
    label = named.join(best, "component").select("same", "n_links", "component_id")
    return rows.select("id", "same").join(label, "same", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("same").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
