"""Near-duplicate documents by Jaccard similarity of word shingles, verified in full.

A document is the set of its word shingles. Candidates share one of BANDS keys, each made of ROWS minima of
hash functions over the set: a pair of similarity s shares none with probability (1 - s^ROWS)^BANDS, 0.00003 at 0.8 and
less above. Sizes and parity bitmaps (the bits that differ are at most the shingles that differ) rule candidates out,
and the survivors' whole sets are compared. A document goes where an earlier one matches it, so that it needs one verified
match: each proposes a few earlier ones under a key, and only those with none verified and more to propose go on to a next round.
A caller may hand in links of its own, SimHash's in the pipeline: they are verified beside the first proposals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import give_back, text_or_empty
from tidemark.llm.line_dedup import DOC_BITS, _filter_of, _in_filter, word_digests
from tidemark.llm.tiles import map_groups, tiled
from tidemark.session import cut, drop_cut, ship

#: Keys of a document, minima in a key, 64-bit words of its parity bitmap.
BANDS, ROWS, WIDE = 20, 4, 8
#: Rows of a key before it is split into tiles, first number of candidates under a key, characters handled at once.
TILE, CANDIDATES, CHARS = 4096, 2, 4_000_000

_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the texts' distinct shingles, text after text, and how many each text has.

    A-Z are lower-cased, words are runs of other than ASCII white space; a text of fewer words is one shingle, one without words none.
    """
    parts = [t.encode().lower() for t in texts]
    data = b"\n".join(parts)
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.searchsorted(np.cumsum(length + 1) - length - 1, begin, "right") - 1
    code = word_digests(data, begin, end)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.flatnonzero(np.arange(len(code)) - first[owner] <= np.maximum(count[owner] - shingle, 0))
    owner, out = owner[at], np.zeros(len(at), np.uint64)
    for k in range(shingle):
        more = slice(None) if k == 0 else np.flatnonzero(k < count[owner])
        out[more] = _mixed((out[more] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD) ^ code[at[more] + k])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with shingles, and where they start."""
    some = np.flatnonzero(size)
    return some, (np.cumsum(size) - size)[some]


def _digest(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit digest of each set (a sum of mixed shingles); no shingles give 0."""
    out, (some, starts) = np.zeros(len(size), np.uint64), _starts(size)
    if len(some):
        out[some] = np.add.reduceat(_mixed(words + np.uint64(0x9E3779B97F4A7C15)), starts)
    return out.view(np.int64)


def band_keys(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has shingles, one row a text."""
    some, starts = _starts(size)
    out = np.zeros((len(some), BANDS), np.uint64)
    for band in range(BANDS if len(some) else 0):
        key = np.full(len(some), band + 1, np.uint64)
        for k in range(ROWS):
            key = _mixed(key * np.uint64(0xFF51AFD7ED558CCD) ^ np.minimum.reduceat(words * _MULTIPLIERS[band * ROWS + k], starts))
        out[:, band] = key
    return out.view(np.int64)


def _bitmaps(words: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Parity bitmaps of 64 * WIDE bits, ``w0, w1, ...``."""
    some, starts = _starts(size)
    slot, bit, out = (words >> np.uint64(55)) % np.uint64(WIDE), np.uint64(1) << (words >> np.uint64(58)), {}
    for k in range(WIDE):
        out[f"w{k}"] = np.zeros(len(size), np.int64)
        if len(some):
            out[f"w{k}"][some] = np.bitwise_xor.reduceat(np.where(slot == k, bit, np.uint64(0)), starts).view(np.int64)
    return out


def text_hash(text_col: str):
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text_or_empty(text_col))


def _map_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, schema: T.StructType, kernel, among=None) -> DataFrame:
    """Run ``kernel(rows, words, size) -> columns`` over all documents with an id (``doc, text, digest, text_hash``), about CHARS characters at a time.

    ``among`` is a filter of document digests: texts of those it rules out are not read.
    """
    ship(docs.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if among is not None:
                batch = batch.filter(pa.array(_in_filter(among.value, batch.column(2).to_numpy() % DOC_BITS)))
            ends = np.cumsum(pa.compute.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS)))
                part = batch.slice(at, end - at)
                at = end
                out = kernel(part, *shingle_sets(part.column(1).to_pylist(), shingle))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"), F.xxhash64(id_col).alias("digest"), text_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(run, schema)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc, text_hash, sig, n, keys, w0, w1, ...`` of all documents with an id."""
    longs = T.ArrayType(T.LongType())
    maps = [T.StructField(f"w{k}", T.LongType()) for k in range(WIDE)]
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", longs), *maps])

    def kernel(part, words, size):
        offsets = np.concatenate(([0], np.cumsum((size > 0) * BANDS))).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(words, size).ravel(), pa.int64()))
        return {"doc": part.column(0), "text_hash": part.column(3), "sig": _digest(words, size), "n": size.astype(np.int32), "keys": keys} | _bitmaps(words, size)

    return _map_sets(docs, id_col, text_col, shingle, schema, kernel)


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, among) -> DataFrame:
    """``sig, words`` of the documents that the filter lets through."""
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def kernel(part, words, size):
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return {"sig": _digest(words, size), "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64)))}

    return _map_sets(docs, id_col, text_col, shingle, schema, kernel, among).dropDuplicates(["sig"])


def _ranks(doc: np.ndarray) -> np.ndarray:
    """Numbers in the order of the document ids."""
    return doc if doc.dtype.kind == "i" else np.unique(doc, return_inverse=True)[1]


def _proposals(columns: dict[str, np.ndarray], threshold: float, limit: int, probes: np.ndarray | None) -> dict:
    """Under each key, earlier sets for each set that pass all filters: ``sig, other, full``; ``full`` tells that ``limit`` stopped it."""
    group = columns["__group"]
    order = np.lexsort((columns["sig"], _ranks(columns["low"]), group))
    group, sig, size, tile = group[order], columns["sig"][order], columns["n"][order].astype(np.int64), columns["tile"][order]
    mixed = (columns["ta"] != columns["tb"])[order]
    maps = [columns[f"w{k}"][order] for k in range(WIDE)]
    fresh = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    taken = np.zeros(len(group), np.int64)
    pending, step, found = np.arange(len(group)), 0, []
    if probes is not None:
        pending = pending[_in_filter(probes, sig[pending] % DOC_BITS)]
    while len(pending):
        # each set against the step-th of its key, earliest first
        pending = pending[(start[pending] + step < pending) & (taken[pending] < limit)]
        y, x = pending, start[pending] + step
        step += 1
        near = (sig[x] != sig[y]) & (~mixed[x] | (tile[x] != tile[y]))
        near &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
        y, x = y[near], x[near]
        apart = sum((np.bitwise_count((m[x] ^ m[y]).view(np.uint64)).astype(np.int64) for m in maps), np.zeros(len(x), np.int64))
        near = apart <= (1 - threshold) / (1 + threshold) * (size[x] + size[y]) + 1e-9
        y, x = y[near], x[near]
        taken[y] += 1
        found.append((y, x))
    y = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    x = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
    return {"sig": sig[y], "other": sig[x], "full": taken[y] >= limit}


def _linked_sets(links: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """``sig, other, full`` of links ``doc, other`` between documents: the set whose smallest id is the larger one, and the other."""
    of = rows.select("doc", "sig").distinct()
    met = links.join(of, "doc").join(of.select(F.col("doc").alias("other"), F.col("sig").alias("b")), "other").select(F.col("sig").alias("a"), "b").filter("a <> b").distinct()
    for side in "ab":
        met = met.join(first.select(F.col("sig").alias(side), F.col("low").alias(f"{side}_low")), side)
    later = F.col("a_low") > F.col("b_low")
    met = met.filter("a_low <> b_low")
    return met.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("sig"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("other"), F.lit(False).alias("full"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, links: DataFrame | None = None, most: int = TILE) -> DataFrame:
    """The documents, as id and ``text_hash``, that one of a smaller id matches: Jaccard similarity of their shingle sets of ``threshold`` or more.

    A document goes even where the one it matches goes itself; nothing goes by a chain of matches alone, and no two documents
    that stay match. Equal sets match, those of texts without words too. Null ids take no part. Rows that repeat an id are judged by their
    own texts. ``links`` (``doc, other``: ids) are verified as the pairs that share a key are. Shingles are told apart by
    64-bit digests, sets by a 64-bit sum of them.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    maps = [f"w{k}" for k in range(WIDE)]
    rows = cut(_sketches(docs, id_col, text_col, shingle), "sketches")
    first = cut(rows.groupBy("sig").agg(F.min("doc").alias("low"), *[F.first(n).alias(n) for n in ("n", "keys", *maps)]), "first-sets")
    keyed = first.select(F.explode("keys").alias("key"), "sig", "low", "n", *maps)
    # a key of one set proposes nothing
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared-keys")
    dealt = cut(tiled(keyed.join(shared, "key", "left_semi"), "key", F.col("sig"), most), "keyed")
    drop_cut(shared)
    matched, probes, limit = None, None, CANDIDATES
    while True:
        bits = probes
        propose = lambda c, limit=limit, bits=bits: _proposals(c, threshold, limit, bits.value if bits else None)
        pairs = map_groups(dealt, ["key", "ta", "tb"], "sig bigint, other bigint, full boolean", propose)
        if probes is None and links is not None:
            pairs = pairs.unionByName(_linked_sets(links, rows, first))
        pairs = cut(pairs.groupBy("sig", "other").agg(F.max("full").alias("full")), "candidates")
        asked = pairs.select(F.explode(F.array("sig", "other")).alias("sig")).distinct()
        among = broadcast(_filter_of(first.join(asked, "sig", "left_semi").select(F.pmod(F.xxhash64("low"), F.lit(DOC_BITS)).alias("s")), DOC_BITS))
        sets = cut(_sets(docs, id_col, text_col, shingle, among), "sets")
        both = pairs.join(sets, "sig").join(sets.select(F.col("sig").alias("other"), F.col("words").alias("theirs")), "other")
        ok = F.size(F.array_intersect("words", "theirs")) >= (threshold / (1 + threshold)) * (F.size("words") + F.size("theirs")) - 1e-9
        state = cut(both.select("sig", "full", ok.alias("ok")).groupBy("sig").agg(F.max("full").alias("full"), F.max("ok").alias("ok")), "verified")
        drop_cut(pairs)
        drop_cut(sets)
        new = state.filter("ok").select("sig")
        matched = new if matched is None else matched.unionByName(new)
        rest = state.filter("full and not ok").select("sig")
        if rest.isEmpty():
            break
        probes, limit = broadcast(_filter_of(rest.select(F.pmod("sig", F.lit(DOC_BITS)).alias("s")), DOC_BITS)), limit * 16
    drop_cut(dealt)
    kept = first.join(matched.distinct(), "sig", "left_anti").select(F.col("low").alias("doc"), "sig")
    return rows.select("doc", "sig", "text_hash").distinct().join(kept, ["doc", "sig"], "left_anti").select(F.col("doc").alias(id_col), "text_hash")
