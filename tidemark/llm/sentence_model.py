"""A compiled sentence-piece BPE model: its fields, its normaliser with source alignment, and its pieces.

The normaliser replaces, at each position, the longest prefix that the compiled character map lists; what it writes
remembers where it came from. Piece segmentation itself is the installed library's, run on text that is
already normalised.
"""

from __future__ import annotations

import re
import struct
from functools import cached_property, lru_cache

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, raw bytes or 4-byte strings."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size


def _message(*fields: tuple[int, int | bytes]) -> bytes:
    """The reverse of ``_fields`` for integers and byte strings."""

    def varint(value):
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in fields)


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double-array trie over UTF-8, then the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        firsts = [b for b in range(256) if self.units and self._child(self.units[0], 0, b)]
        #: bytes that no rule begins with are copied in runs
        self.skip = re.compile(b"[^" + b"".join(re.escape(bytes([b])) for b in firsts) + b"]+") if firsts else None

    def _child(self, unit: int, at: int, byte: int):
        at ^= ((unit >> 10) << ((unit & 512) >> 6)) ^ byte
        if at < len(self.units) and self.units[at] & 0x800000FF == byte:
            return at, self.units[at]
        return None

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement, for the longest listed prefix of ``data[start:]``."""
        found, at, unit = None, 0, self.units[0]
        for k in range(start, len(data)):
            step = self._child(unit, at, data[k])
            if step is None:
                break
            at, unit = step
            if unit >> 8 & 1:
                leaf = self.units[at ^ ((unit >> 10) << ((unit & 512) >> 6))]
                found = k + 1 - start, leaf & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _starts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text, where its character starts."""
    at = np.arange(len(data))
    return np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, at)) if len(data) else at


class SentenceModel:
    def __init__(self, proto: bytes):
        self.pieces, self.kinds, self.scores = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self._trainer = value
            elif number == 3:
                normalizer = dict(_fields(value))
        self.proto = proto
        self.is_bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        #: bytes of normalised text that a piece covers
        self.widths = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        words = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER, UNUSED)]
        #: no piece holds a space mark after another character: each word is then segmented alone
        self.splits_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in words)
        self.newline_is_alone = not any("\n" in p for p in words)

    @cached_property
    def library(self):
        """The installed library with the original model."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    @cached_property
    def segmenter(self):
        """The installed library with a model that leaves normalised text as it is."""
        import sentencepiece

        kept = []
        for number, value in _fields(self.proto):
            if number == 3:
                value = _message((1, b"identity"), (3, 0), (4, 0), (5, 0))
            if number in (1, 2, 3):
                kept.append((number, value))
        return sentencepiece.SentencePieceProcessor(model_proto=_message(*kept))

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the source byte where its source starts."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map.skip is None and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            at = _starts(raw)
            lead = self.dummy_prefix
            if not self.escape:
                return (" " if lead else "") + text, np.concatenate([np.zeros(int(lead), np.int64), at, [len(data)]])
            at = np.repeat(at, np.where(raw == 32, 3, 1))
            return (SPACE if lead else "") + text.replace(" ", SPACE), np.concatenate([np.zeros(3 * lead, np.int64), at, [len(data)]])
        return self._normalize_slow(data)

    def normalize_text(self, text: str) -> str:
        """Normalised text without its alignment."""
        if text and self.map.skip is None and not self.squeeze and self.escape:
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.normalize(text)[0]

    def _normalize_slow(self, data: bytes) -> tuple[str, np.ndarray]:
        out, src = [], []  # chunks, and arrays of source positions
        at, n = 0, len(data)
        while at < n:
            run = self.map.skip.match(data, at) if self.map.skip else re.compile(b"(?s).+").match(data, at)
            if run:
                piece = run.group()
                out.append(piece)
                src.append(at + _starts(np.frombuffer(piece, np.uint8)))
                at = run.end()
                continue
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                hit = size, data[at : at + size]
            out.append(hit[1])
            src.append(np.full(len(hit[1]), at, np.int64))
            at += hit[0]
        text = b"".join(out)
        pos = np.concatenate(src) if src else np.zeros(0, np.int64)
        end = n
        if self.squeeze:
            raw = np.frombuffer(text, np.uint8)
            space = raw == 32
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]  # the first of a run of spaces
            text, pos = raw[keep].tobytes(), pos[keep]
        if not text:
            return "", np.zeros(1, np.int64)
        first = int(pos[0])
        if self.dummy_prefix:
            text, pos = b" " + text, np.concatenate([[first], pos])
        if self.escape:
            raw = np.frombuffer(text, np.uint8)
            pos = np.repeat(pos, np.where(raw == 32, 3, 1))
            text = text.replace(b" ", SPACE.encode())
        mark = SPACE.encode() if self.escape else b" "
        while self.squeeze and text.endswith(mark):
            text, pos, end = text[: -len(mark)], pos[: -len(mark)], int(pos[-len(mark)])
        if not text:
            return "", np.zeros(1, np.int64)
        return text.decode(errors="replace"), np.concatenate([pos, [end]])

    def words(self, normal: str) -> list[str]:
        """Parts of normalised text that no piece crosses."""
        if not self.splits_at_space or not self.escape:
            return [normal]
        if SPACE + SPACE not in normal and "\0" not in normal:
            if self.newline_is_alone:
                normal = normal.replace("\n", "\0\n\0")
            return normal.replace(SPACE, "\0" + SPACE).split("\0")
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal)


@lru_cache(maxsize=4)
def load(path: str) -> SentenceModel:
    """The model file's contents; kept by the worker."""
    with open(path, "rb") as f:
        return SentenceModel(f.read())
