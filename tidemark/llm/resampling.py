"""Importance resampling towards a target distribution, over hashed n-gram features.

A feature's bucket is a CRC-32 modulo the bucket count. N-grams of a batch are interned in an open-addressed NumPy table: XXH64 keys choose slots by
linear probing, equal keys are verified byte by byte, and a slot holds the n-gram's bucket and count, so that a bucket is computed once for each
distinct n-gram. Occurrences keep their slot ids; a document's weight gathers the buckets' gains through them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import give_back, map_texts, text_or_empty
from tidemark.operators.ranges import places
from tidemark.session import cut, ship

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of text that one table takes; longer texts are read in pieces. Occurrences that are interned at a time.
SLICE, STEP = 4 << 20, 1 << 17
#: Word bytes of lower-cased UTF-8: digits, a-z, and every byte of other than ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many short byte ranges, those of one length at a time; ranges of 32 bytes or more go to the library."""
    from xxhash import xxh64_intdigest

    out = np.empty(len(starts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        rows, size = order[a:b], int(sizes[order[a]])
        if size >= 32:
            out[rows] = [xxh64_intdigest(data[s : s + size].tobytes(), seed) for s in starts[rows].tolist()]
            continue
        at = data[starts[rows, None] + np.arange(size)] if size else np.zeros((len(rows), 0), np.uint8)
        h = np.full(len(rows), np.uint64((seed + int(P5) + size) & 0xFFFFFFFFFFFFFFFF))
        done = 0
        while size - done >= 8:
            lane = np.ascontiguousarray(at[:, done : done + 8]).view("<u8")[:, 0]
            h = _rotl(h ^ (_rotl(lane * P2, 31) * P1), 27) * P1 + P4
            done += 8
        if size - done >= 4:
            lane = np.ascontiguousarray(at[:, done : done + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = _rotl(h ^ (lane * P1), 23) * P2 + P3
            done += 4
        for k in range(done, size):
            h = _rotl(h ^ (at[:, k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair of ranges of one size (at least 1): whether their bytes are equal."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    same = data[np.repeat(a, sizes) + within] == data[np.repeat(b, sizes) + within]
    return np.logical_and.reduceat(same, first)


class Table:
    """Open-addressed table of the distinct byte ranges of one buffer, with a bucket and a count a slot."""

    def __init__(self, data: np.ndarray, buckets: int, hashes=xxh64, bits: int = 12):
        self.data, self.raw, self.buckets, self.hashes, self.used = data, data.tobytes(), buckets, hashes, 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        n = 1 << bits
        self.mask = n - 1
        self.key, self.start = np.zeros(n, np.uint64), np.full(n, -1, np.int64)  # a start of -1 is an empty slot
        self.size, self.bucket, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _grow(self, incoming: int) -> np.ndarray | None:
        """Room for ``incoming`` more at half load; returns the slots' new places if they moved."""
        if 2 * (self.used + incoming) <= self.mask + 1:
            return None
        old = np.flatnonzero(self.start >= 0)
        kept = [x[old] for x in (self.key, self.start, self.size, self.bucket, self.count)]
        moved = np.full(self.mask + 1, -1, np.int64)
        self._alloc((2 * (self.used + incoming) - 1).bit_length())
        slot, todo, claim = (kept[0] & np.uint64(self.mask)).astype(np.int64), np.arange(len(old)), np.full(self.mask + 1, -1, np.int64)
        while len(todo):
            free = todo[claim[slot[todo]] < 0]
            claim[slot[free]] = free  # of several that want a slot the last gets it
            todo = todo[claim[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        for mine, theirs in zip((self.key, self.start, self.size, self.bucket, self.count), kept, strict=True):
            mine[slot] = theirs
        moved[old] = slot
        return moved

    def intern(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slot of every range; counts go up, and new ranges get their bucket."""
        out = np.empty(len(starts), np.int64)
        for at in range(0, len(starts), STEP):
            part = slice(at, at + STEP)
            moved = self._grow(len(out[part]))
            if moved is not None and at:
                out[:at] = moved[out[:at]]
            out[part] = self._intern(starts[part], sizes[part])
        return out

    def _intern(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        key = self.hashes(self.data, starts, sizes)
        slot, todo = (key & np.uint64(self.mask)).astype(np.int64), np.arange(len(starts))
        while len(todo):
            s = slot[todo]
            free = todo[self.start[s] < 0]
            if len(free):
                new = np.unique(slot[free])
                self.start[slot[free]] = starts[free]
                winner = free[self.start[slot[free]] == starts[free]]
                self.key[slot[winner]], self.size[slot[winner]] = key[winner], sizes[winner]
                begins = self.start[new]
                ranges = zip(begins.tolist(), (begins + self.size[new]).tolist(), strict=True)
                self.bucket[new] = [zlib.crc32(self.raw[a:b]) % self.buckets for a, b in ranges]
                self.used += len(new)
            near = (self.key[s] == key[todo]) & (self.size[s] == sizes[todo])
            same = near & (self.start[s] == starts[todo])
            asked = np.flatnonzero(near & ~same)
            same[asked] = equal_ranges(self.data, starts[todo[asked]], self.start[s[asked]], sizes[todo[asked]])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.count += np.bincount(slot, minlength=self.mask + 1)
        return slot


def pieces(text: bytes, longest: int, size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """A lower-cased text in pieces that cut no word, each with the number of words at its start that are the last of the piece before."""
    at, carried = 0, []
    while at < len(text) or at == 0:
        end = at + size
        if end < len(text):
            flags = IS_WORD[np.frombuffer(text[at:end], np.uint8)]
            back = np.flatnonzero(~flags)
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one long word: to its end
                while end < len(text) and IS_WORD[text[end]]:
                    end += 1
        own = text[at:end]
        yield b" ".join([*carried, own]), len(carried)
        if longest > 1 and end < len(text):
            arr = np.frombuffer(own, np.uint8)
            marks = np.diff(IS_WORD[arr].astype(np.int8), prepend=0, append=0)
            words = [own[a:b] for a, b in zip(np.flatnonzero(marks == 1)[1 - longest :], np.flatnonzero(marks == -1)[1 - longest :], strict=True)]
            carried = [*carried, *words][1 - longest :]
        at = max(end, 1)


def slices(texts: list[str], longest: int, size: int = SLICE) -> Iterator[list[tuple[int, bytes, int]]]:
    """Units (text number, piece, carried words) in slices of about ``size`` bytes."""
    held, total = [], 0
    for n, text in enumerate(texts):
        for piece, carried in pieces(text.encode().lower(), longest, size):
            if held and total + len(piece) > size:
                yield held
                held, total = [], 0
            held.append((n, piece, carried))
            total += len(piece)
    if held:
        yield held


def occurrences(units: list[tuple[int, bytes, int]], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of a slice, start, size and text number of every run of 1 to ``longest`` words, and text number of every word."""
    data = np.frombuffer(b"\n".join(p for _, p, _ in units) + b"\n", np.uint8)
    flags = IS_WORD[data]
    keep = flags.copy()
    keep[1:] |= flags[:-1]  # a word and one byte after it
    ends_at = np.cumsum([len(p) + 1 for _, p, _ in units])
    kept = np.cumsum(keep)
    data, flags = np.where(flags, data, 32).astype(np.uint8)[keep], flags[keep]
    marks = np.diff(flags.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)
    unit = np.searchsorted(kept[ends_at - 1], starts, side="right")
    owner, carried = np.array([u[0] for u in units]), np.array([u[2] for u in units])
    first = np.searchsorted(unit, np.arange(len(units)))
    place = np.arange(len(starts)) - first[unit]
    parts = []
    for n in range(1, longest + 1):
        last = np.flatnonzero(place >= np.maximum(n - 1, carried[unit]))
        parts.append((starts[last - (n - 1)], ends[last] - starts[last - (n - 1)], owner[unit[last]]))
    words = parts[0][2]
    begins, sizes, of = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return data, begins, sizes, of, words


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of every bucket over all texts: tasks sum their own, Spark adds them, and one number a bucket reaches the driver."""
    ship(texts.sparkSession)
    kind = T.StructType.fromDDL("bucket long, n long")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for units in slices(batch.column(0).slice(at, 512).to_pylist(), longest):
                    data, begins, sizes, _, _ = occurrences(units, longest)
                    table = Table(data, buckets)
                    table.intern(begins, sizes)
                    np.add.at(total, table.bucket, table.count)  # empty slots count nothing
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=arrow)
        give_back()

    out = np.zeros(buckets, np.int64)
    for row in texts.select(text_or_empty(text_col).alias("text")).mapInArrow(run, kind).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the buckets' smoothed target and raw shares."""
    size, total, wanted = len(raw), float(raw.sum()), float(target.sum())
    pairs = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (total + size)) / ((s + 1.0) * (wanted + size)))) for s, t in pairs], np.int64)


def draw(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of a Gumbel draw that depends on seed and id alone (null id: the empty string)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id, n_features, weight, score, rank``; ``rank`` (1, 2, ...) is set on the documents drawn.

    Words are runs of digits, letters and other than ASCII characters after lower-casing A-Z; features are all runs of 1 to ``longest`` words. ``weight`` is the
    floored mean gain of a document's features (0 without any), ``score`` adds the draw of its id, and ``percent`` of the documents of ``least_words`` words or more
    are drawn, highest scores first, ties by the smaller id. Null texts are empty; rows that repeat an id are documents of their own with the same draw, ranked
    in any order where their scores are equal; a null id draws as the empty string and ties before others; without documents the result is empty, without
    target texts all features weigh by their rarity. Other columns are ignored. What leaves the tasks is one count for each of ``buckets``, whatever the corpus's size.
    """
    ratio = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))

    def make():
        def kernel(ids: list, texts: list[str]) -> dict[str, object]:
            sums, features, words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for units in slices(texts, longest):
                data, begins, sizes, of, word_of = occurrences(units, longest)
                table = Table(data, buckets)
                slot = table.intern(begins, sizes)
                of_slot = ratio[table.bucket]
                np.add.at(sums, of, of_slot[slot])
                features += np.bincount(of, minlength=len(texts))
                words += np.bincount(word_of, minlength=len(texts))
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            score = weight + np.array([draw(i, seed) for i in ids], np.int64)
            return {id_col: ids, "n_words": words, "n_features": features, "weight": weight, "score": score}

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(map_texts(docs, id_col, text_col, f"{id_col} {kind}, n_words long, n_features long, weight long, score long", make), "weights")
    fit = F.col("n_words") >= least_words
    drawn = rows.filter(fit).count() * percent // 100
    ranked = places(rows.filter(fit), [F.desc("score"), F.col(id_col).asc_nulls_first()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("n_words")
