"""Line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased). One pass counts words in a sketch of fixed size; it orders words by rarity. Two
sets of Jaccard similarity t or more share a word among the first ``n - ceil(t n) + 1`` of either. A second pass sends each
line under those words, packed by bucket: its place, size, the word's position, and a parity bitmap as wide as the line needs (the bits that
differ are at most the words that differ). Where a word's lines meet, the length filter, the positional filter and the bitmaps
discard pairs, and a line names the nearest earlier lines that are left; the word sets of those alone are read again and compared in full.
A line goes where an earlier one (by document id, then line number) matches it, so that it needs one verified match, not
all its pairs; only lines with none verified and more to name go on to a next round, in which the words of those lines alone are sent.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import fresh_name, give_back, text_or_empty
from tidemark.session import cut, drop_cut, ship

#: Words are told apart by the first so many bits of their digests; with a line's number they make one 64-bit number.
WORD_BITS = 48
LINES_AT_ONCE = 1 << (64 - WORD_BITS)
#: Cells of the count sketch (one byte each where it is broadcast), and the parts in which it is summed.
CELLS, PARTS = 1 << 24, 64
#: Steps of the rarity code for a doubling of the count.
STEPS = 6
#: Share of the allowed difference that makes a candidate sure. Lines of a hot word's tile, first number of candidates under a word, characters handled at once, pairs compared at once.
SURE, TILE, CANDIDATES, CHARS, PAIRS = 0.25, 4096, 8, 5_000_000, 1_000_000
#: Words of a line for each 64 bits of its parity bitmap, and the widest bitmap in words of 64 bits (as a power of two).
PER_WORD, WIDEST = 56, 5
#: Bytes of prefix rows that a task packs at once, and prefix rows of a bucket.
PACK, BUCKET = 24_000_000, 200_000
#: Bits of the filters that tell which lines' word sets are asked for, and in which documents they stand.
LINE_BITS, DOC_BITS, LINE_STEP = 1 << 26, 1 << 23, 40503
#: Bits of the filter of words in a later round.
WORD_SPOTS = 1 << 23

_MASK = np.uint64((1 << WORD_BITS) - 1)
_OWNER = np.uint64(WORD_BITS)
_CELL = np.uint64(WORD_BITS - 24)


def word_digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the words data[begin:end]: eight bytes of all words that have them at a time."""
    padded = data + b"\0" * 8
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    left = end - begin
    out = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo, at = None, begin
    while True:
        h = (out if todo is None else out[todo]) ^ (eight[at] & masks[np.minimum(left, 8)])
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        if todo is None:
            out = h
        else:
            out[todo] = h
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        todo, at, left = more if todo is None else todo[more], at[more] + 8, left[more] - 8


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of the bytes: runs of other than ASCII white space."""
    gap = (raw == 32) | (raw - np.uint8(9) < 5)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(raw))
    return edge[0::2], edge[1::2]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Digests spread over all 64 bits."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x


class Tokens:
    """Words of many lines as they stand: ``row`` and ``line`` of each line, digests in ``words``, line ``k`` from ``first[k]`` on."""

    def __init__(self, texts: list[str], base: int):
        data = "\n".join(texts).encode().lower()
        raw = np.frombuffer(data, np.uint8)
        begin, end = word_bounds(raw)
        counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.line = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.row += base
        self.words = word_digests(data, begin, end) >> np.uint64(64 - WORD_BITS)
        self.first = np.concatenate(([0], np.searchsorted(begin, np.flatnonzero(raw == 10)), [len(begin)]))

    def firsts(self) -> np.ndarray:
        """Words of the lines whose words are no copy of an earlier line's here."""
        count = np.diff(self.first)
        some = np.flatnonzero(count)
        if not len(some):
            return self.words
        digest = np.add.reduceat(_mixed(self.words), self.first[some])
        chosen = np.zeros(len(count), bool)
        chosen[some[np.unique(digest, return_index=True)[1]]] = True
        return self.words[np.repeat(chosen, count)]

    def sets(self, least: int) -> Iterator[Lines]:
        """The word sets of ``least`` words or more, LINES_AT_ONCE lines at a time."""
        for at in range(0, len(self.row), LINES_AT_ONCE):
            until = min(at + LINES_AT_ONCE, len(self.row))
            count = np.diff(self.first[at : until + 1])
            key = (np.repeat(np.arange(until - at, dtype=np.uint64), count) << _OWNER) | self.words[self.first[at] : self.first[until]]
            key.sort()
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            key = key[fresh]
            size = np.bincount((key >> _OWNER).astype(np.int64), minlength=until - at)
            lines = Lines(self.row[at:until], self.line[at:until], key & _MASK, size)
            yield lines.take(np.flatnonzero(size >= least))


class Lines:
    """Word sets of many lines as flat arrays, sorted by line and word."""

    def __init__(self, row, line, words, size):
        self.row, self.line, self.words, self.size = row, line, words, size
        self.starts = np.cumsum(size) - size

    def sig(self) -> np.ndarray:
        """64-bit digest of each set (a sum of mixed words)."""
        return np.add.reduceat(_mixed(self.words), self.starts) if len(self.starts) else np.zeros(0, np.uint64)

    def take(self, chosen: np.ndarray) -> Lines:
        """The given lines (indexes in ascending order), each with a word or more."""
        if len(chosen) == len(self.size):
            return self
        keep = np.zeros(len(self.size), bool)
        keep[chosen] = True
        return Lines(self.row[chosen], self.line[chosen], self.words[np.repeat(keep, self.size)], self.size[chosen])


def _map_lines(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable) -> DataFrame:
    """Run ``make()(ids, digests, texts)``, a generator of columns, over all documents with an id, about CHARS characters at a time; ``kernel(None, None, None)`` ends a task."""
    ship(docs.sparkSession)
    spark_schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS)))
                part = batch.slice(at, until - at)
                at = until
                yield from map(pack, kernel(part.column(0), part.column(2), part.column(1).to_pylist()))
        yield from map(pack, kernel(None, None, None))
        give_back()  # the worker goes on to other stages

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"), F.xxhash64(id_col).alias("digest"))
    return rows.mapInArrow(run, spark_schema)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def _lead(size: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a line's prefix."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _index_lead(size: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a line's prefix under which lines of its size or more can match it; under the others it only looks for smaller lines."""
    return size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1


def _joinable(least: int, threshold: float) -> int:
    """Words of the smallest line that can match a line of another set: one word more or fewer has to leave ``threshold``."""
    n = max(1, least)
    while n / (n + 1) < threshold - 1e-9 and n < 1 << 20:
        n += 1
    return n


def _rarity(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[np.ndarray, int]:
    """For each cell of the sketch STEPS times the logarithm of its count, rounded up (a byte a cell, whatever the corpus), and about how many prefix rows there are.

    Copies of a line within a slice of texts count once. Code 0 is of words that occur in no two such lines.
    """
    ship(docs.sparkSession)

    def make():
        sketch = np.zeros(CELLS, np.uint32)

        def kernel(ids, digests, texts):
            if ids is not None:
                np.add.at(sketch, (Tokens(texts, 0).firsts() >> _CELL).astype(np.int64), np.uint32(1))
                return
            import zstandard

            packer = zstandard.ZstdCompressor(level=1)
            for part, counts in enumerate(sketch.reshape(PARTS, -1)):
                cell = np.flatnonzero(counts).astype("<u4")
                if len(cell):
                    columns = np.diff(cell, prepend=np.uint32(0)).tobytes() + counts[cell].astype("<u4").tobytes()
                    yield {"part": [part], "counts": [packer.compress(columns)]}

        return kernel

    arrow = to_arrow_schema(T.StructType.fromDDL("part int, codes binary, total bigint"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                delta, counts = np.frombuffer(reader.decompress(data), "<u4").reshape(2, -1)
                total = sums.setdefault(part, np.zeros(CELLS // PARTS, np.int64))
                total[np.cumsum(delta, dtype=np.int64)] += counts
        for part, total in sums.items():
            codes = np.where(total > 1, np.minimum(255, np.ceil(STEPS * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(codes.tobytes(), 1)]), pa.array([int(total.sum())])], schema=arrow)

    parts = _map_lines(docs, id_col, text_col, "part int, counts binary", make)
    merged = parts.repartition("part").mapInArrow(merge, "part int, codes binary, total bigint").toArrow()
    import zstandard

    out, rows = np.zeros((PARTS, CELLS // PARTS), np.uint8), 0
    for part, codes, total in zip(*(c.to_pylist() for c in merged.columns), strict=True):
        out[part] = np.frombuffer(zstandard.decompress(codes), np.uint8)
        rows += total
    return out.ravel(), int(rows * (1 - threshold) * 1.2)


def _widths(size: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a line's parity bitmap, as powers of two."""
    out = np.zeros(len(size), np.int64)
    for k in range(WIDEST):
        out += size > PER_WORD << k
    return out


def _bitmaps(lines: Lines, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the lines one after the other, and where each begins (and the last ends)."""
    k = _widths(lines.size)
    at = np.concatenate(([0], np.cumsum(1 << k)))
    # a line's words ascend, so that those of a slot, their highest bits, stand together
    slot = at[owner] + (lines.words >> (_OWNER - k.astype(np.uint64))[owner]).astype(np.int64)
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.zeros(at[-1], np.uint64)
    if len(starts):
        out[slot[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (lines.words & np.uint64(63)), starts)
    return out, at


def _spread(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs starts[k], starts[k] + 1, ... of the given lengths, one after the other."""
    return np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())


def _by_set(sig: np.ndarray, rank: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest line of each set, and the others of other places (rows that repeat a document repeat its lines)."""
    order = np.lexsort((line, rank, sig))
    head = np.ones(len(order), bool)
    head[1:] = sig[order][1:] != sig[order][:-1]
    first = order[head]
    its = first[np.cumsum(head) - 1]
    return first, order[(rank[order] != rank[its]) | (line[order] != line[its])]


class Packer:
    """Rows as one compressed value, column by column; a document id that is no integer travels apart."""

    PREFIX = (("group", "<u4"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4"), ("copy", "u1"))
    #: what is packed: line sets, prefix rows, prefix rows with their places in the filter of lines
    COLUMNS = {"sets": (("sig", "<u8"), ("line", "<i4")), "prefix": PREFIX, "again": (*PREFIX, ("spot", "<i4"))}

    @classmethod
    def pack(cls, packer, kind: str, columns: dict[str, np.ndarray], chosen: np.ndarray) -> bytes:
        doc = columns["doc"][chosen]
        whole = doc.dtype.kind in "iu"
        ids = np.diff(doc.astype("<i8"), prepend=0).tobytes() if whole else pickle.dumps(doc.tolist())
        head = np.array([len(chosen), whole, len(ids)], "<i8").tobytes()
        parts = [head, ids, *(columns[n][chosen].astype(t).tobytes() for n, t in cls.COLUMNS[kind])]
        if kind != "sets":
            count = 1 << _widths(columns["size"][chosen])
            parts.append(columns["bits"][_spread(columns["from"][chosen], count)].astype("<u8").tobytes())
        return packer.compress(b"".join(parts))

    @classmethod
    def unpack(cls, kind: str, values: list[bytes]) -> dict[str, np.ndarray]:
        import zstandard

        reader, found = zstandard.ZstdDecompressor(), []
        for value in values:
            data = reader.decompress(value)
            (n, whole, size), at, part = np.frombuffer(data, "<i8", 3).tolist(), 24, {}
            part["doc"] = np.cumsum(np.frombuffer(data, "<i8", n, at)) if whole else np.array(pickle.loads(data[at : at + size]), object)
            at += size
            for name, dtype in cls.COLUMNS[kind]:
                part[name] = np.frombuffer(data, dtype, n, at)
                at += part[name].nbytes
            if kind != "sets":
                part["bits"] = np.frombuffer(data, "<u8", -1, at)
            found.append(part)
        return {name: np.concatenate([p[name] for p in found]) for name in found[0]}


def _packed(docs, id_col, text_col, least, threshold, sketch, most, buckets, words=None) -> DataFrame:
    """``bucket, rows``: each line under its rarest words (buckets from 0), and in the first round under the digest of its set (below -1).

    In later rounds ``words`` is a filter of the words that count.

    A line of a set that stands earlier in the same slice of texts goes to bucket -1 at once. A hot word's lines are dealt to tiles; those that
    larger lines may look for under it, few as the word is frequent, go to all of its tiles.
    """
    joined, kind = _joinable(least, threshold), "prefix" if words is None else "again"

    def make():
        import zstandard

        codes, packer = sketch.value, zstandard.ZstdCompressor(level=1)
        held: list[dict] = []
        size = [0]

        def prefix_rows(doc, digest, lines):
            owner = np.repeat(np.arange(len(lines.size)), lines.size)
            bits, begin = _bitmaps(lines, owner)
            often = codes[(lines.words >> _CELL).astype(np.int64)].astype(np.uint64)
            # by line, then rarity, then digest
            key = (owner.astype(np.uint64) << np.uint64(48)) | (often << np.uint64(40)) | (lines.words & np.uint64((1 << 40) - 1))
            key.sort()
            lead = _lead(lines.size, threshold)
            key = key[_spread(lines.starts, lead)]
            pos = np.arange(len(key)) - np.repeat(np.cumsum(lead) - lead, lead)
            often = (key >> np.uint64(40)) & np.uint64(255)
            keep = np.flatnonzero(often)  # a word that occurs once matches nothing
            if words is not None:
                keep = keep[_in_filter(words.value, (key[keep] & np.uint64(WORD_SPOTS - 1)).astype(np.int64))]
            key, often, pos = key[keep], often[keep].astype(np.int64), pos[keep]
            line, word = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 40) - 1)
            copy = np.zeros(len(key), bool)
            parts = np.maximum(1, np.ceil(2.0 ** (often / STEPS) / most)).astype(np.int64)
            if len(parts) and parts.max() > 1:
                tile = (_mixed(lines.words[lines.starts] + lines.size.astype(np.uint64))[line] % parts.astype(np.uint64)).astype(np.int64)
                many = np.where(pos < _index_lead(lines.size, threshold)[line], parts, 1)
                row = np.repeat(np.arange(len(key)), many)
                # its own tile, then the others
                part = (tile[row] + _spread(np.zeros(len(many), np.int64), many)) % parts[row]
                word, copy = word[row] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), part != tile[row]
                line, pos = line[row], pos[row]
            word = _mixed(word)
            out = {} if kind == "prefix" else {"spot": (digest[lines.row[line]] % LINE_BITS + lines.line[line] * LINE_STEP % LINE_BITS) % LINE_BITS}
            return out | {
                "bucket": (word >> np.uint64(32)) % np.uint64(buckets), "group": word & np.uint64(0xFFFFFFFF), "doc": doc[lines.row[line]], "line": lines.line[line],
                "size": lines.size[line], "pos": pos, "copy": copy, "from": begin[line], "bits": bits,
            }

        def values(what, columns):
            bucket = columns["bucket"].astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=1 << 40)) + 1
            names, rows, start = [], [], 0
            for end in ends.tolist():
                names.append(int(bucket[order[start]]))
                rows.append(Packer.pack(packer, what, columns, order[start:end]))
                start = end
            return {"bucket": names, "rows": rows}

        def flush():
            out = {n: np.concatenate([c[n] for c in held]) for n in held[0]}
            held.clear()
            size[0] = 0
            return values(kind, out)

        def kernel(ids, digests, texts):
            if ids is None:
                if held:
                    yield flush()
                return
            doc = _ids(ids)
            rank = doc if doc.dtype.kind in "iu" else np.unique(doc, return_inverse=True)[1]
            for lines in Tokens(texts, 0).sets(least):
                sig = lines.sig()
                first, again = _by_set(sig, rank[lines.row], lines.line)
                if kind == "prefix":
                    bucket = -2 - (sig % np.uint64(buckets)).astype(np.int64)
                    bucket[again] = -1
                    some = np.sort(np.concatenate((first, again)))
                    yield values("sets", {"bucket": bucket[some], "doc": doc[lines.row[some]], "sig": sig[some], "line": lines.line[some]})
                own = lines.take(np.sort(first))
                own = own.take(np.flatnonzero(own.size >= joined))
                if len(own.size):
                    rows = prefix_rows(doc, digests.to_numpy(), own)
                    rows["from"] = rows["from"] + sum(len(c["bits"]) for c in held)
                    held.append(rows)
                    size[0] += 64 * len(rows["line"]) + 8 * len(rows["bits"])
                    if size[0] >= PACK:
                        yield flush()

        return kernel

    return _map_lines(docs, id_col, text_col, "bucket int, rows binary", make)


def _found(packed: DataFrame, id_type: T.DataType, threshold: float, limit: int, probes) -> DataFrame:
    """``doc, line, other, other_line, full`` of the lines and those that they may match; no other for lines whose very set stands earlier."""
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("line", T.IntegerType()), T.StructField("other", id_type), T.StructField("other_line", T.IntegerType()), T.StructField("full", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def work():
            out = _repeated(held, now) if now < 0 else _candidates(Packer.unpack("again" if probes else "prefix", held), threshold, limit, probes.value if probes else None)
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for bucket, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (bucket != now or now == -1):
                    yield work()
                    held = []
                now = bucket
                held.append(value)
        if held:
            yield work()
        held.clear()
        give_back()

    # lines of bucket -1 need not meet
    salt = F.when(F.col("bucket") == -1, F.xxhash64("rows")).otherwise(F.lit(0))
    return packed.repartition("bucket", salt).sortWithinPartitions("bucket").mapInArrow(run, schema)


def _repeated(values: list[bytes], bucket: int) -> dict:
    """The lines of a bucket of set digests but the earliest of each."""
    columns = Packer.unpack("sets", values)
    doc, line = columns["doc"], columns["line"]
    if bucket < -1:
        rank = doc if doc.dtype.kind in "iu" else np.unique(doc, return_inverse=True)[1]
        again = _by_set(columns["sig"], rank, line)[1]
        doc, line = doc[again], line[again]
    return {"doc": doc, "line": line, "other": pa.nulls(len(line)), "other_line": pa.nulls(len(line)), "full": np.zeros(len(line), bool)}


def _in_filter(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1) > 0


def _apart(bits, begin, width, fold, y, x) -> np.ndarray:
    """Bits that the bitmaps of the rows differ by, at the narrower one's width (the slots of a wider one fold together)."""
    out = np.bitwise_count(fold[x] ^ fold[y]).astype(np.int64)
    wide = np.flatnonzero((width[x] > 0) & (width[y] > 0))
    kind = width[x[wide]] * 8 + width[y[wide]]
    for code in np.unique(kind).tolist():
        at, low = wide[kind == code], min(divmod(code, 8))
        mine = _folded(bits, begin[x[at]], code // 8, low)
        mine ^= _folded(bits, begin[y[at]], code % 8, low)
        out[at] = np.bitwise_count(mine).sum(1, dtype=np.int64)
    return out


def _folded(bits, begin, width, low) -> np.ndarray:
    """Bitmaps of 2 ** width words brought to 2 ** low: neighbouring slots are joined."""
    out = bits[begin[:, None] + np.arange(1 << width)]
    return out if width == low else np.bitwise_xor.reduce(out.reshape(len(begin), 1 << low, -1), axis=2)


def _candidates(columns: dict, threshold: float, limit: int, probes: np.ndarray | None = None) -> dict:
    """Under each word, for each line the nearest earlier lines that pass all filters: ``limit`` of them, or in the first round the nearest alone where it differs by SURE of what is allowed at most.

    ``full`` tells that there are more.
    """
    n = len(columns["size"])
    width = _widths(columns["size"])
    begin = np.cumsum(1 << width) - (1 << width)
    fold = np.bitwise_xor.reduceat(columns["bits"], begin) if n else columns["bits"]
    order = np.argsort(columns["group"].astype(np.int64) << 31 | columns["size"])
    fold = fold[order]
    size, pos, group = (columns[c][order].astype(np.int64) for c in ("size", "pos", "group"))
    doc, line = columns["doc"][order], columns["line"][order]
    width, begin, bits = width[order], begin[order], columns["bits"]
    rank = doc if doc.dtype.kind in "iu" else np.unique(doc, return_inverse=True)[1]
    part = (1 - threshold) / (1 + threshold)
    allowed_of, rest_of, need_of = part * size, size - pos, threshold / (1 + threshold) * size
    # each line looks among the smaller lines of its word, in order of size, from the length filter's bound to the positional filter's
    index, seek = np.flatnonzero(pos < _index_lead(size, threshold)), np.flatnonzero(columns["copy"][order] == 0)
    key, at_word = (group << 31 | size)[index], group[seek] << 31
    most_of = np.minimum(size, np.floor((size - pos) * (1 + threshold) / threshold - size + 1e-9).astype(np.int64))[seek]
    low = np.searchsorted(key, at_word | np.ceil(threshold * size - 1e-9).astype(np.int64)[seek])
    count = np.maximum(0, np.searchsorted(key, at_word | np.maximum(0, most_of), "right") - low)
    n = len(seek)
    best: list[np.ndarray] = []
    weight = np.cumsum(count)
    at = 0
    while at < n:
        # a run of rows of about PAIRS pairs; a row of more is cut by its partners
        until = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + PAIRS)))
        rows = np.arange(at, until)
        for skip in range(0, max(1, int(count[at])) if until == at + 1 else 1, PAIRS):
            many = np.minimum(count[rows] - skip, PAIRS) if until == at + 1 else count[rows]
            y, x = seek[np.repeat(rows, many)], index[_spread(low[rows] + skip, many)]
            near = np.bitwise_count(fold[x] ^ fold[y]) <= allowed_of[x] + allowed_of[y] + 1e-9
            y, x = y[near], x[near]
            near = (np.minimum(rest_of[x], rest_of[y]) >= need_of[x] + need_of[y] - 1e-9)
            y, x = y[near], x[near]
            allowed = part * (size[x] + size[y]) + 1e-9
            apart = _apart(bits, begin, width, fold, y, x)
            near = apart <= allowed
            y, x, ratio = y[near], x[near], (apart[near] / allowed[near]).astype(np.float32)
            later = (rank[x] > rank[y]) | ((rank[x] == rank[y]) & (line[x] > line[y]))
            # of lines of one size the later one looks; rows that repeat a document are no pairs
            keep = (size[x] < size[y]) | (~later & ((rank[x] != rank[y]) | (line[x] != line[y])))
            y, x, ratio = np.where(later, x, y)[keep], np.where(later, y, x)[keep], ratio[keep]
            if probes is not None:
                asked = _in_filter(probes, columns["spot"][order][y])
                y, x, ratio = y[asked], x[asked], ratio[asked]
            best.append(_nearest(y, x, ratio, np.zeros(len(y), bool), limit, probes is None))
            if len(best) > 8:
                best = [_nearest(*_joined(best), limit, probes is None)]
        at = until
    y, x, ratio, more = _nearest(*_joined(best), limit, probes is None) if best else (np.zeros(0, np.int64),) * 4
    return {"doc": doc[y], "line": line[y], "other": doc[x], "other_line": line[x], "full": np.asarray(more, bool)}


def _joined(parts):
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _nearest(y, x, ratio, more, limit, sure):
    """Of each row's candidates the ``limit`` nearest (with ``sure`` the first is enough where it differs by SURE of what is allowed at most); ``more`` tells that others were left."""
    order = np.lexsort((x, ratio, y))
    y, x, ratio, more = y[order], x[order], ratio[order], more[order]
    head = np.flatnonzero(np.diff(y, prepend=-1))
    if not len(head):
        return y, x, ratio, more
    count = np.diff(np.append(head, len(y)))
    keep = np.where(sure & (ratio[head] <= SURE), 1, limit)
    more = np.repeat(np.logical_or.reduceat(more, head) | (count > keep), count)
    chosen = np.arange(len(y)) - np.repeat(head, count) < np.repeat(keep, count)
    return y[chosen], x[chosen], ratio[chosen], more[chosen]


def _filter_of(spots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each spot (column ``s``): ``bits`` / 8 bytes, however many there are."""
    words = spots.groupBy(F.expr("s div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint8)


def _spot(doc: Column, line: Column) -> Column:
    """Place of a line in the filter of lines."""
    return F.pmod(F.pmod(F.xxhash64(doc), F.lit(LINE_BITS)) + F.pmod(line.cast("bigint") * F.lit(LINE_STEP), F.lit(LINE_BITS)), F.lit(LINE_BITS))


def _word_sets(docs, id_col, text_col, lines, among) -> DataFrame:
    """``doc, line, words`` of the lines that the filters let through; other lines are not even cut into words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def kernel(ids, digests, texts):
            if ids is None:
                return
            digest = digests.to_numpy()
            row, line, kept = [], [], []
            for n in np.flatnonzero(_in_filter(among.value, digest % DOC_BITS)).tolist():
                parts = texts[n].split("\n")
                spot = (digest[n] % LINE_BITS + np.arange(len(parts)) * LINE_STEP % LINE_BITS) % LINE_BITS
                for k in np.flatnonzero(_in_filter(lines.value, spot)).tolist():
                    row.append(n)
                    line.append(k)
                    kept.append(parts[k])
            if not kept:
                return
            for sets in Tokens(kept, 0).sets(1):
                ends = np.append(sets.starts, len(sets.words)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets.words.view(np.int64)))
                yield {"doc": ids.take(pa.array(np.array(row)[sets.row])), "line": np.array(line)[sets.row], "words": words}

        return kernel

    return _map_lines(docs, id_col, text_col, f"doc {kind}, line int, words array<bigint>", make)


def _verified(docs, id_col, text_col, pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``doc, line, ok, full`` of the lines that have pairs: whether one is of the similarity, whole word sets compared; and those sets."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    asked = pairs.select("doc", "line").unionByName(pairs.select(F.col("other").alias("doc"), F.col("other_line").alias("line")))
    lines = broadcast(_filter_of(asked.select(_spot(F.col("doc"), F.col("line")).alias("s")), LINE_BITS))
    among = broadcast(_filter_of(asked.select(F.pmod(F.xxhash64("doc"), F.lit(DOC_BITS)).alias("s")), DOC_BITS))
    sets = cut(_word_sets(docs, id_col, text_col, lines, among), "word-sets")
    theirs = sets.select(F.col("doc").alias("other"), F.col("line").alias("other_line"), F.col("words").alias("theirs"))
    both = pairs.join(sets, ["doc", "line"]).join(theirs, ["other", "other_line"])
    shared = F.size(F.array_intersect("words", "theirs"))
    ok = shared >= (threshold / (1 + threshold)) * (F.size("words") + F.size("theirs")) - 1e-9
    out = cut(both.groupBy("doc", "line").agg(F.max(ok).alias("ok"), F.max("full").alias("full")), "verified")
    lines.unpersist()
    among.unpersist()
    return out, sets


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, least: int = 1, most: int = TILE) -> DataFrame:
    """``doc, line`` of the lines of at least ``least`` different words that an earlier line matches."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    kind = docs.schema[id_col].dataType
    codes, rows = _rarity(docs, id_col, text_col, threshold)
    sketch, buckets = broadcast(codes), max(64, -(-rows // BUCKET))
    gone, matched, probes, words, limit = None, [], None, None, CANDIDATES
    while True:
        packed = _packed(docs, id_col, text_col, max(1, least), threshold, sketch, most, buckets, words)
        found = cut(_found(packed, kind, threshold, limit, probes), "found")
        if gone is None:
            gone = found.filter("other is null").select("doc", "line")
        # a line that goes by its set needs no other match
        pairs = found.filter("other is not null").groupBy("doc", "line", "other", "other_line").agg(F.max("full").alias("full"))
        pairs = cut(pairs.join(gone, ["doc", "line"], "left_anti"), "pairs")
        state, sets = _verified(docs, id_col, text_col, pairs, threshold)
        drop_cut(pairs)
        matched.append(state.filter("ok").select("doc", "line"))
        open_lines = state.filter("full and not ok")
        if open_lines.isEmpty():
            drop_cut(sets)
            break
        asked = open_lines.join(sets, ["doc", "line"]).select(F.explode("words").alias("word")).select(F.pmod("word", F.lit(WORD_SPOTS)).alias("s"))
        words = broadcast(_filter_of(asked, WORD_SPOTS))
        drop_cut(sets)
        probes = broadcast(_filter_of(open_lines.select(_spot(F.col("doc"), F.col("line")).alias("s")), LINE_BITS))
        limit *= 256
    for more in matched:
        gone = gone.unionByName(more)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, least: int = 1, most: int = TILE) -> DataFrame:
    """All input columns with the text's repeated lines left out, and ``n_lines, n_removed``.

    A line goes where a line of an earlier document (smaller id), or an earlier line of the same one, has word sets of Jaccard
    similarity ``threshold`` or more with it; it goes even where that line goes itself. With ``least`` 1 that holds for every line
    with a word; lines of fewer than ``least`` different words stay, in their places, and so do blank ones
    (no words), whatever ``least``, and all lines of documents with a null id. Null texts stay null
    (no lines), empty ones empty. Rows that repeat an id are the same document: they lose the same lines. An
    empty table gives an empty result. The added columns ``n_lines, n_removed`` win over input columns of their names; any other
    name may occur. Words are told apart by 48-bit digests, line sets by a 64-bit sum of them.
    """
    removed = removed_lines(docs, id_col, text_col, threshold, least, most)
    base = docs.drop("n_lines", "n_removed")
    key, gone_col = fresh_name("removed_doc", base.columns), fresh_name("removed_lines", base.columns)
    lists = removed.groupBy(F.col("doc").alias(key)).agg(F.collect_set("line").alias(gone_col))
    joined = base.join(lists, base[id_col] == lists[key], "left").drop(key)
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    order = [f.name for f in base.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, gone = part.column(text_col), part.column(gone_col)
                lines = pa.compute.add(pa.compute.count_substring(texts, "\n"), 1)
                lines = pa.compute.if_else(pa.compute.equal(pa.compute.coalesce(pa.compute.binary_length(texts), 0), 0), 0, lines)
                touched = gone.is_valid()
                new = []
                for text, numbers in zip(texts.filter(touched).to_pylist(), gone.filter(touched).to_pylist(), strict=True):
                    numbers = set(numbers)
                    new.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in numbers))
                if new:
                    texts = pa.compute.replace_with_mask(texts, touched, pa.array(new, texts.type))
                columns = {**{n: part.column(n) for n in order}, text_col: texts}
                columns |= {"n_lines": lines, "n_removed": pa.compute.coalesce(pa.compute.list_value_length(gone), 0)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
        give_back()

    return joined.mapInArrow(run, schema)
