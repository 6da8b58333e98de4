"""Shards by a hierarchical weighted hash tree (built-in functions only).

A row descends from the root to a region, a rack and a shard. At each level every child draws a time, ``-ln(u) / weight`` with u a hash of the row's key and
the child's name, and the earliest wins, so that children get rows by their weights (sums of their shards') and a draw depends on nothing but key, name and
weight. A change of weights moves rows only to children whose weight went up and from those whose weight went down: other subtrees keep
their rows where they are. A shard that is added as a region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import places

#: Hexadecimal digits of a digest that make a draw.
DIGITS = 13


class Leaf(NamedTuple):
    """A shard and its place: racks belong to one region, shards to one rack."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0, 1, ... of weight 1 in racks of ``per_rack`` and regions of ``racks``."""
    return [Leaf(n // (per_rack * racks), n // per_rack, n) for n in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own."""
    return [*tree, Leaf(*(1 + max(leaf[k] for leaf in tree) for k in range(3)), weight)]


def check_tree(tree: Sequence[Leaf]) -> None:
    if not tree or min(leaf.weight for leaf in tree) <= 0:
        raise ValueError("a tree has shards, and their weights are positive")
    if len({leaf.shard for leaf in tree}) < len(tree) or any(len({x[k] for x in tree if x[k + 1] == leaf[k + 1]}) > 1 for leaf in tree for k in (0, 1)):
        raise ValueError("a shard stands in one rack, and a rack in one region")


def _earliest(key: Column, level: str, children: Column) -> Column:
    """The child of the smallest draw; ties go to the smaller number."""

    def draw(child: Column) -> Column:
        digest = F.sha2(F.concat(key, F.lit(f":{level}:"), child["id"].cast("string")), 256)
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return F.struct((-F.log(u) / child["weight"]).alias("at"), child["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def tree_shard(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key (a string) in a tree."""
    check_tree(tree)

    def children(level: int, parent: int | None = None) -> Column:
        inside = [leaf for leaf in tree if parent is None or leaf[level - 1] == parent]
        names = sorted({leaf[level] for leaf in inside})
        weights = {n: float(sum(leaf.weight for leaf in inside if leaf[level] == n)) for n in names}
        return F.array(*[F.struct(F.lit(n).alias("id"), F.lit(weights[n]).alias("weight")) for n in names])

    def of(level: int, parent: Column) -> Column:
        return F.create_map(*[x for p in sorted({leaf[level - 1] for leaf in tree}) for x in (F.lit(p), children(level, p))])[parent]

    region = _earliest(key, "region", children(0))
    rack = _earliest(key, "rack", of(1, region))
    return _earliest(key, "shard", of(2, rack))


def shard_rows(docs: DataFrame, tree: Sequence[Leaf], more: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``key``: the id and the tree decide alone, so that copies of a text go where their ids go and a large group of them fills no shard.
    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` their CRC-32 (null text: no bytes). ``slot`` numbers the rows of a shard from 0 in order of id
    (null ids first, which all have the empty string's shard; rows that repeat an id follow each other in any order). ``grown_shard`` is the shard in the tree
    ``more``, by default one with one more shard. An empty table gives an empty result; other columns are ignored.
    """
    octets = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(octets) + 1).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, tree).alias("shard"),
        tree_shard(key, more or grown(tree)).alias("grown_shard"),
    )
    placed = places(rows, [F.col(id_col).asc_nulls_first()], "slot", within=["shard"], start=0)
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Sequence[Leaf], id_col: str = "doc_id", rows_in_file: int = 1_000_000) -> None:
    """Write whole rows as ``path/shard=N/``, straight from the tasks that read them: placing a row by its key needs no shuffle."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the table has a column of the name shard")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs.withColumn("shard", tree_shard(key, tree)).write.option("maxRecordsPerFile", rows_in_file).partitionBy("shard").parquet(path)
