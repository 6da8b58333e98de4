"""Offset-preserving sentence-piece encoding and decoding."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts, tokenizer_path
from tidemark.llm.sentence_model import SentenceModel, load


class Encoder:
    """Ids and source byte spans of whole texts."""

    def __init__(self, model: SentenceModel):
        self.model = model

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the source alignment of the normalised bytes that they cover."""
        normal, align = self.model.normalize(text)
        if not normal:
            return np.zeros(0, np.int32), align
        return self.model.segmenter.encode(normal, return_type="numpy"), align

    def spans(self, ids: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte span of each id. Of a character spelled in byte pieces the last piece has the span, the others are empty."""
        ends = np.cumsum(self.model.widths[ids])
        return align[ends - self.model.widths[ids]], align[ends]


def _encoder(path: str | None, model: str) -> Encoder:
    return Encoder(load(path or tokenizer_path(model)))


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", path: str | None = None, end_id: bool = True
) -> DataFrame:
    """One row per input row: ``id, ids, begins, ends`` (arrays; spans in bytes of the UTF-8 source).

    ``end_id`` appends the model's end id with an empty span at the end. Null or empty texts have no other id.
    Repeated rows are encoded each; other columns are ignored; an empty table gives an empty result. ``path`` names
    the model file on every executor; else ``model`` is looked up among the public vocabularies.
    """

    def make():
        encoder = _encoder(path, model)
        eos = encoder.model.library.eos_id()

        def kernel(keys, texts):
            out = {id_col: keys, "ids": [], "begins": [], "ends": []}
            for text in texts:
                ids, align = encoder.encode(text)
                begins, ends = encoder.spans(ids, align)
                if end_id:
                    ids, begins, ends = np.append(ids, eos), np.append(begins, align[-1]), np.append(ends, align[-1])
                for name, values in (("ids", ids), ("begins", begins), ("ends", ends)):
                    out[name].append(values)
            return out

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, f"{id_col} {kind}, ids array<int>, begins array<bigint>, ends array<bigint>", make)


def decode_ids(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """``id, text``: ids decoded by the library; null or empty lists give an empty text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decode(ids):
        library = load(path or tokenizer_path(model)).library
        return ids.map(lambda x: library.decode([int(i) for i in x]) if x is not None else "")

    return coded.select(id_col, decode(ids_col).alias("text"))


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", path: str | None = None
) -> DataFrame:
    """Encode with spans, decode again, and keep digests: ``id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered``.

    ``ids_sha256`` is over the decimal ids (end id included) joined by one space, ``spans_sha256`` over begin and end
    of each id as little-endian 64-bit numbers, and ``covered`` counts source bytes inside spans. The cases of
    ``encode_texts`` hold.
    """

    def make():
        encoder = _encoder(path, model)
        library = encoder.model.library
        eos = library.eos_id()
        decimal = [str(i) for i in range(len(encoder.model.pieces))]

        def kernel(keys, texts):
            out = {id_col: keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_sha256": [], "covered": []}
            for text in texts:
                ids, align = encoder.encode(text)
                begins, ends = encoder.spans(ids, align)
                coded = [*ids.tolist(), eos]
                decoded = library.decode(coded)
                out["n_tokens"].append(len(ids) + 1)
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal.__getitem__, coded)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                both = np.stack([np.append(begins, align[-1]), np.append(ends, align[-1])], 1).astype("<i8")
                out["spans_sha256"].append(hashlib.sha256(both.tobytes()).hexdigest())
                out["covered"].append(int((ends - begins).sum()))
            return out

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(
        docs, id_col, text_col, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered bigint", make
    )
