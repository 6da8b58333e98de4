"""SimHash near-duplicates through pivot distance tables.

A table holds each distinct fingerprint's Hamming distances to many reference fingerprints, block by block (r + 3 blocks of bits for a radius
of r). By the triangle inequality a block's coordinates differ by no more than its bits do. Fingerprints that differ in at most r bits
have three blocks without a difference at least, whose coordinates are the same: they meet in the cell of those coordinates, one for each choice of
three blocks. There a pair is out whose largest coordinate differences, summed over the other blocks, exceed r; survivors
are verified. Links kept in a cell form a forest, never all pairs of a group, and distributed components close them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import map_texts
from tidemark.llm.tiles import Forest, map_groups, tiled
from tidemark.operators.graph import connected_components
from tidemark.session import cut, drop_cut, ship

#: Reference fingerprints, bits of a distance within a block, rows of a cell before it is split into tiles.
PIVOTS, BITS, TILE = 12, 5, 4096


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: bit b is set where over half of the shingles' XXH64 have it; no words give 0.

    A-Z are lower-cased, words are runs of other than ASCII white space, and shingles count as often as they occur;
    a text of fewer words is one shingle.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, seed)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        end = (begin + size)[shingle - 1 :].tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin.tolist(), end, strict=False)), np.uint64, len(end))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    out = np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")
    return int(out[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` of every whole text (null: empty)."""

    def make():
        return lambda keys, texts: {id_col: keys, "fp": [fingerprint(t, shingle) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, f"{id_col} {kind}, fp bigint", make)


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def pivot_table(prints: np.ndarray, blocks: int, pivots: int = PIVOTS) -> np.ndarray:
    """For each fingerprint and block the distances to the reference fingerprints within the block, BITS bits each in one number."""
    from xxhash import xxh64_intdigest

    reference = np.array([xxh64_intdigest(b"pivot", n) for n in range(pivots)], np.uint64)
    apart = prints.view(np.uint64)[:, None] ^ reference[None, :]
    place = np.uint64(1) << (np.arange(pivots, dtype=np.uint64) * np.uint64(BITS))
    return np.stack([(np.bitwise_count(apart & np.uint64(m)).astype(np.uint64) * place).sum(1, dtype=np.uint64) for m in _block_masks(blocks)], 1).view(np.int64)


def pivot_tables(prints: DataFrame, blocks: int) -> DataFrame:
    """``fp, t0, t1, ...``: the table's row of each fingerprint."""
    ship(prints.sparkSession)
    schema = T.StructType([T.StructField("fp", T.LongType()), *[T.StructField(f"t{k}", T.LongType()) for k in range(blocks)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, k]) for k in range(blocks)]], schema=arrow)

    return prints.select("fp").mapInArrow(run, schema)


def _farthest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest coordinate difference of a block."""
    out, mask = np.zeros(len(a), np.int64), (1 << BITS) - 1
    for n in range(PIVOTS):
        np.maximum(out, np.abs((a >> (n * BITS) & mask) - (b >> (n * BITS) & mask)), out=out)
    return out


def _links(columns: dict[str, np.ndarray], radius: int) -> dict:
    prints, group = np.ascontiguousarray(columns["fp"]), columns["__group"]
    rest = [columns[f"r{k}"] for k in range(radius)]
    # distance to the first reference over the blocks that may differ
    first = sum((r & ((1 << BITS) - 1) for r in rest), np.zeros(len(prints), np.int64))
    order = np.lexsort((first, group))
    prints, group, first, rest = prints[order], group[order], first[order], [r[order] for r in rest]
    tile, mixed = columns["tile"][order], (columns["ta"] != columns["tb"])[order]
    forest, found = Forest(len(prints)), []
    row = np.arange(len(prints))
    step = 0
    while len(row):
        step += 1
        row = row[row + step < len(prints)]
        # sorted by the first reference: past its bound no later pair of the row can link
        row = row[(group[row + step] == group[row]) & (first[row + step] - first[row] <= radius)]
        a, b = row, row + step
        apart = ~mixed[a] | (tile[a] != tile[b])
        a, b = a[apart], b[apart]
        most = np.zeros(len(a), np.int64)
        for r in rest:
            most = most + _farthest(r[a], r[b])
            near = most <= radius
            a, b, most = a[near], b[near], most[near]
        near = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64)) <= radius
        a, b = forest.add(a[near], b[near])
        if len(a):
            found.append((prints[a], prints[b]))
    src = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    dst = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    return {"src": src, "dst": dst}


def hamming_links(prints: DataFrame, radius: int = 3, most: int = TILE) -> DataFrame:
    """``src, dst``: links between distinct fingerprints (column ``fp``) of at most ``radius`` bits, enough of them to connect all that link.

    The table is computed once for each fingerprint; a row of a cell carries the coordinates of the blocks that may differ there. Cells of over
    ``most`` rows are dealt to tiles.
    """
    blocks = radius + 3
    cells = []
    for n, chosen in enumerate(combinations(range(blocks), 3)):
        rest = [F.col(f"t{k}").alias(f"r{i}") for i, k in enumerate(k for k in range(blocks) if k not in chosen)]
        cells.append(F.struct(F.xxhash64(F.lit(n), *[F.col(f"t{k}") for k in chosen]).alias("key"), *rest))
    rows = pivot_tables(prints, blocks).select("fp", F.inline(F.array(*cells)))
    dealt = tiled(rows, "key", F.col("fp"), most)
    return map_groups(dealt, ["key", "ta", "tb"], "src bigint, dst bigint", lambda c: _links(c, radius))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: ``id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links).

    Fingerprints link at ``radius`` or fewer differing bits; documents of equal fingerprints are linked, texts without words
    (null and empty ones too: fingerprint zero) like any other. Copies are one fingerprint in the join. Null ids
    never name a component: one of null ids alone is null. Repeated rows share their component; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle).select(F.col(id_col).alias("id"), "fp"), "prints")
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    parts = connected_components(hamming_links(distinct, radius))
    named = distinct.join(parts.select(F.col("id").alias("fp"), "component"), "fp", "left")
    named = cut(named.select("fp", "low", F.coalesce("component", "fp").alias("component")), "named")
    drop_cut(distinct)
    # most fingerprints link with none: only linked ones need a minimum over their component
    best = named.groupBy("component").agg(F.min("low").alias("component_id"))
    label = named.join(best, "component").select("fp", "component_id")
    return rows.join(label, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc, other``: links between ids, the larger one first, enough of them to connect what ``simhash_components`` does.

    Documents of one fingerprint are linked with the smallest of them, fingerprints of at most ``radius`` bits by their smallest ids. Null ids take no part.
    """
    rows = cut(fingerprints(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, shingle).select(F.col(id_col).alias("id"), "fp"), "prints")
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    same = rows.join(distinct, "fp").filter("id <> low").select(F.col("id").alias("doc"), F.col("low").alias("other"))
    ends = (distinct.select(F.col("fp").alias(fp), F.col("low").alias(low)) for fp, low in (("src", "a"), ("dst", "b")))
    near = hamming_links(distinct, radius)
    for end in ends:
        near = near.join(end, end.columns[0])
    return cut(near.filter("a <> b").select(F.greatest("a", "b").alias("doc"), F.least("a", "b").alias("other")).unionByName(same).distinct(), "links")
