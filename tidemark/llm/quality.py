"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into blocks, each block is compressed
with either dictionary, and the difference of the summed sizes over the text's own size goes through a logistic curve that is fitted
on further labelled texts. The score is the curve's value: the likelihood of label 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, text_or_empty

#: Bounds of the fit: labelled rows of each class, and the share of them that calibrates.
FIT_ROWS, CALIBRATION = 1500, 4
#: Dictionary bytes, compression level, block bytes, and sizes that dampen the difference and the score of very short texts.
DICT_BYTES, LEVEL, BLOCK, DAMP, SHORT = 49_152, 3, 2048, 48, 48


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    #: share of label 1, the score of a text without content
    prior: float

    def curve(self, difference: float, size: int) -> float:
        """Score of a text of ``size`` bytes; the fewer they are, the nearer it stays to the prior."""
        prior = math.log(self.prior / (1 - self.prior)) if 0 < self.prior < 1 else 0.0
        x = self.slope * difference + self.offset
        x = prior + (x - prior) * size / (size + SHORT)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Sizes:
    """Compressed sizes of a text under both dictionaries, as one normalised difference (positive: like good text)."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.sides = []
        for data in (bad, good):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            words = zstandard.ZstdCompressionDict(data, dict_type=kind)
            words.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_dict_id=False, write_content_size=False))

    def difference(self, data: bytes) -> float:
        if not data:
            return 0.0
        bad, good = (sum(len(side.compress(data[k : k + BLOCK])) for k in range(0, len(data), BLOCK)) for side in self.sides)
        return (bad - good) / (len(data) + DAMP)


def _score(model: QualityModel | None, sizes: Sizes | None, text: str) -> float:
    if model is None:
        return 0.5
    data = text.encode()
    return model.curve(sizes.difference(data), len(data)) if data else model.prior


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    samples = [b[k : k + 1024] for t in texts for b in [t.encode()] for k in range(0, len(b), 1024)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: use it as it is
        return (b"".join(samples)[-DICT_BYTES:] or b" " * 8).ljust(8)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted, lightly damped logistic fit."""
    scale = float(x.std()) or 1.0
    features = np.stack([x / scale, np.ones_like(x)], 1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (w * (p - y)) + ridge @ beta
        step = np.linalg.solve(features.T @ (features * (w * p * (1 - p))[:, None]) + ridge, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0]) / scale), float(beta[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS
) -> QualityModel | None:
    """Fit on at most ``rows`` labelled texts of each class, chosen by a hash of their id and read whole.

    ``labels`` holds what may be learnt from. Null labels and ids with contradicting labels are left out. Every
    CALIBRATION-th chosen text calibrates, the rest make the dictionaries. None where a class has no text at all.
    """
    clean = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
        .filter("y = y2")
    )
    total = dict(clean.groupBy("y").count().collect())
    chosen = {}
    for y in (0, 1):
        order = clean.filter(F.col("y") == y).select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(rows)
        chosen |= {r["id"]: (r["h"], y) for r in order.collect()}
    if not chosen:
        return None
    picked = docs.filter(F.col(id_col).isin(list(chosen)) & F.col(text_col).isNotNull())
    # of rows that repeat an id the least text counts
    texts = picked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).groupBy("id").agg(F.min("text")).collect()
    texts = sorted((chosen[i], t) for i, t in texts)
    sides = {y: [t for (_, k), t in texts if k == y] for y in (0, 1)}
    if not all(sides.values()):
        return None
    train = {y: [t for n, t in enumerate(v) if n % CALIBRATION or len(v) < CALIBRATION] for y, v in sides.items()}
    held = {y: [t for n, t in enumerate(v) if not n % CALIBRATION] for y, v in sides.items()}
    # lines that several texts share (licences, quoted passages) tell what was copied, not how good a text is
    seen = Counter(line for v in sides.values() for t in v for line in set(t.split("\n")))
    train = {y: ["\n".join(line for line in t.split("\n") if seen[line] < 2) for t in v] for y, v in train.items()}
    # both dictionaries see as many texts, so that neither is better for its amount of text alone
    least = min(map(len, train.values()))
    good, bad = _dictionary(train[1][:least]), _dictionary(train[0][:least])
    sizes = Sizes(good, bad)
    x = np.array([sizes.difference(t.encode()) for y in (0, 1) for t in held[y]])
    y = np.array([y for y in (0, 1) for _ in held[y]], float)
    weight = np.array([total[k] / len(held[k]) for k in (0, 1) for _ in held[k]])
    slope, offset = _logistic(x, y, weight * len(x) / weight.sum())
    return QualityModel(good, bad, slope, offset, total[1] / sum(total.values()))


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id, score, predicted`` (1 where the score reaches ``threshold``).

    Whole texts are compressed, block by block, so that memory stays at one text. Null and empty texts
    score the share of label 1 among the labelled rows. Without a model every score is 0.5. Repeated rows score
    alike, other columns are ignored, and an empty table gives an empty result.
    """

    def make():
        sizes = Sizes(model.good, model.bad) if model else None

        def kernel(keys, texts):
            scores = [_score(model, sizes, t) for t in texts]
            return {id_col: keys, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, f"{id_col} {kind}, score double, predicted int", make)


def quality_column(model: QualityModel | None, text_col: str = "text") -> Column:
    """The score as a column, for filters that keep a table's other columns where they are."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(model.good, model.bad) if model else None  # once a task
        for texts in batches:
            yield texts.map(lambda t: _score(model, sizes, t))

    return score(text_or_empty(text_col))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: rows of fold 0 are held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit outside fold 0, score every document: ``id, held_out, score, predicted``."""
    model = fit_quality(docs, labels.filter(fold(id_col) != 0), id_col, text_col)
    scored = score_quality(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
