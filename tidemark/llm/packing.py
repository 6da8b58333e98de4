"""Sum-of-squares packing of token sequences into windows of fixed size.

A document, or what is left of it after whole windows are cut off, goes to the fill level (or a new window) that leaves the smallest sum
of squared counts of partly filled windows over all levels. The counts are kept in an array with one cell for each level.
Each task packs its rows as they come and writes a window as soon as it is full. Windows that are left at the end (and the fuller half
when more than ``open_windows`` are open) are closed by cutting their pieces: whole windows first, and the rest by powers of two,
which need no padding.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import MEMO_ENTRIES, give_back, text_or_empty, tokenizer_path
from tidemark.session import ship

WINDOW, OPEN_WINDOWS = 2048, 4096


class _Spelled(dict):
    """Ids of parts between white space; one that is missing is cut to words, and each word spelled once."""

    def __init__(self, words: Callable[[str], list[str]], tokenize: Callable, letters: dict[int, str]):
        super().__init__()
        self.words, self.tokenize, self.letters = words, tokenize, letters

    def __missing__(self, part: str) -> bytes:
        # letters alone are one word, which the pattern need not find; a word cut off by the pattern is cut no further
        words = None if part.isalpha() else self.words(part)
        if words is not None and words != [part]:
            ids = b"".join([self[w] for w in words])
        else:
            spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        self[part] = ids
        return ids


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, each word's looked up once.

    Only for texts of plain Latin letters, where lower-casing and the vocabulary's word pattern act on each word alone; others go to
    the library whole.
    """

    #: the vocabulary file's own pattern, and what a text may hold to be cut by it
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: the character that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on
    PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
    BYTES = {b: chr(b) for b in PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(PRINTED)))}
    OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf\xc0-\xffŒœ–—‘-”…€]|<\\|")

    def __init__(self, path: str, entries: int = 2 * MEMO_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = self._plain(path)
        self.entries = entries
        self.parts = _Spelled(regex.compile(self.PATTERN).findall, self.library.model.tokenize, self.BYTES)

    def _plain(self, path: str) -> bool:
        import json

        if array("I").itemsize != 4 or sys.byteorder != "little":
            return False
        with open(path, encoding="utf-8") as f:
            split = json.load(f).get("pre_tokenizer") or {}
        parts = split.get("pretokenizers", [split])
        return any(p.get("pattern", {}).get("Regex") == self.PATTERN for p in parts)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.plain or self.OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.parts) > self.entries:
            self.parts.clear()
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


class Packer:
    """One task's windows. ``emit(doc, start, ids, total, window, offset)`` gets each piece once."""

    def __init__(self, emit: Callable, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, first: int = 0):
        self.emit, self.window, self.limit, self.next = emit, window, open_windows, first
        #: the level array: open windows by their fill
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def add(self, doc, ids: bytes) -> None:
        """Place a document's ids (4 bytes each)."""
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self._write([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        size = total - at
        if size:
            self._place((doc, at, ids[4 * at :], total), size)

    def _place(self, piece: tuple, size: int) -> None:
        fills = np.flatnonzero(self.counts[1 : self.window - size + 1]) + 1
        level = 0
        if len(fills):
            # change of the sum of squares, halved and without its constant; a full window counts nowhere
            ends = fills + size
            change = np.where(ends < self.window, self.counts[ends] + 1, 0.5) - self.counts[fills]
            best = int(np.argmin(change))
            if change[best] <= self.counts[size] + 0.5:
                level = int(fills[best])
        if level:
            pieces = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._write(pieces)
            return
        self.levels[level + size].append(pieces)
        self.counts[level + size] += 1
        self.open += 1
        if self.open > self.limit:
            self.close(self.limit // 2)

    def close(self, keep: int = 0) -> None:
        """Write open windows, fullest first, until ``keep`` are left: cut where a window is full, the rest by powers of two."""
        ready, filled = [], 0
        for level in range(self.window - 1, 0, -1):
            while self.levels[level] and self.open > keep:
                pieces = self.levels[level].pop()
                self.counts[level] -= 1
                self.open -= 1
                for doc, at, ids, total in pieces:
                    while filled + len(ids) // 4 >= self.window:
                        room = self.window - filled
                        ready.append((doc, at, ids[: 4 * room], total))
                        self._write(ready)
                        ready, filled = [], 0
                        at, ids = at + room, ids[4 * room :]
                    if ids:
                        ready.append((doc, at, ids, total))
                        filled += len(ids) // 4
        while filled:
            room = 1 << (filled.bit_length() - 1)
            filled -= room
            part = []
            while room:
                doc, at, ids, total = ready[0]
                take = min(room, len(ids) // 4)
                part.append((doc, at, ids[: 4 * take], total))
                room -= take
                if 4 * take == len(ids):
                    ready.pop(0)
                else:
                    ready[0] = (doc, at + take, ids[4 * take :], total)
            self._write(part)

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, at, ids, total in pieces:
            self.emit(doc, at, ids, total, self.next, offset)
            offset += len(ids) // 4
        self.next += 1


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "word_bpe_49k.json",
    path: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    keep_ids: bool = False,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` on request).

    A document's ids are the tokenizers library's without special tokens, then ``end_id``; a null or empty text has
    that id alone. Each id lies in one piece; pieces of a sequence follow each other without gaps. A sequence
    is full, or its length is a power of two. Repeated rows and rows with a null id are packed each; other columns
    are ignored; an empty table gives an empty result. Sequence ids are unique: the task's number, then a counter. The tasks
    follow the input's splits, so that nothing is shuffled, and a task that is run again over the same split gives
    the same rows. At most ``open_windows`` windows are open in a task.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    schema = docs.sparkSession.createDataFrame([], schema + ", ids array<bigint>" * keep_ids).schema
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = WordIds(path or tokenizer_path(model))
        out: list[tuple] = []

        def emit(doc, at, ids, total, sequence, offset):
            row = (doc, at, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
            out.append((*row, np.frombuffer(ids, "<u4")) if keep_ids else row)

        def flush():
            columns = list(zip(*out, strict=True)) or [[] for _ in arrow]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        packer = Packer(emit, window, open_windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.ids(text.as_py()) + end)
                if len(out) >= 4096:
                    yield flush()
        packer.close()
        yield flush()
        words.parts.clear()
        give_back()

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)
