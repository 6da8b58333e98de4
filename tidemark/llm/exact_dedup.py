"""Exact deduplication by a heavy-hitter split (built-in functions only).

A frequent-items sketch of the Misra-Gries family (``approx_top_k``: bounded counters, mergeable, no frequent item
missed) names the digests that may be frequent. Their exact counts and winners come from one
partial aggregation; those at most ``tracked`` rows are broadcast and settle frequent groups map-side. Every other
digest is rarer than the sketch's error bound, so that an ordinary shuffle by digest is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    top: int = 2048,
    tracked: int = 16384,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays. A null id never
    wins over another id; where all ids of a group are null, ``keep_id`` is null and all its rows are kept. Rows
    that repeat the winner's id are the same document and share ``kept``. Other columns are ignored, an empty table
    gives an empty result, and texts are hashed whole, once: the later passes read the written digests. ``tracked``
    bounds the sketch and ``top`` the rows that are broadcast, whatever the input's size.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")), "digests")
    found = rows.agg(F.expr(f"approx_top_k(digest, {top}, {tracked})").alias("top")).first()[0] or []
    # a digest that the sketch saw once or twice is not frequent; verification below settles the rest
    frequent = [x["item"] for x in found if x["count"] > 2]
    heavy = None
    cold = rows
    parts = []
    if frequent:
        heavy = cut(
            rows.filter(F.col("digest").isin(frequent))
            .groupBy("digest")
            .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
            "heavy",
        )
        marked = rows.join(F.broadcast(heavy), "digest", "left")
        parts.append(marked.filter("group_size is not null").select("id", "digest", "keep_id", "group_size"))
        cold = marked.filter("group_size is null").select("id", "digest")
    group = Window.partitionBy("digest")
    parts.append(cold.select("id", "digest", F.max("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
