"""Scoring of image tables with a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import geometry
from tidemark.functions.labels import UNKNOWN
from tidemark.operators.dense import report_masks
from tidemark.operators.imagejobs import from_model, pixels_of, to_model, unrolled
from tidemark.operators.splits import in_split
from tidemark.session import ship

#: A model maps a batch (n, 3, h, w) to logits (n, classes, h', w') or to vectors (n, d).
Model = Callable[[np.ndarray], np.ndarray]


def score_masks(images: DataFrame, make: Callable[[], Model], target: tuple[int, int] = (384, 512), mode: str = "stretch", batch: int = 8) -> DataFrame:
    """``stem, height, width, labels``: the class of each source pixel, unknown where the model did not see it.

    ``make`` builds the model once for each task; ``images`` are decoded ones.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = list(frame.itertuples(index=False))
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                logits = model(np.stack([to_model(pixels_of(r), target, mode) for r in part]))
                yield pd.DataFrame([(r.stem, r.height, r.width, from_model(z, (r.height, r.width), target, mode).tobytes()) for r, z in zip(part, logits, strict=True)], columns=["stem", "height", "width", "labels"])

    return images.select("stem", "height", "width", "channels", "data").mapInPandas(run, "stem string, height int, width int, labels binary")


def embed_images(images: DataFrame, make: Callable[[], Model], target: tuple[int, int] = (224, 224), batch: int = 32) -> DataFrame:
    """``stem, embedding``: normalised vectors of the caller's model."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    ship(images.sparkSession)
    size = 3 * target[0] * target[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r.stem, to_model(pixels_of(r), target, "stretch").reshape(-1)) for r in frame.itertuples(index=False)], columns=["stem", "x"])

    def build():
        model = make()

        def unit(x):
            v = np.asarray(model(x.reshape(-1, 3, *target)), np.float32)
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

        return unit

    inputs = images.select("stem", "height", "width", "channels", "data").mapInPandas(run, "stem string, x array<float>")
    embed = predict_batch_udf(build, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    return inputs.select("stem", embed("x").alias("embedding"))


def geometry_manifest(images: DataFrame, target: tuple[int, int], mode: str) -> DataFrame:
    """``stem, geometry`` of every image: what was resized, padded and cut."""
    return images.select("stem", geometry(F.col("height"), F.col("width"), target, mode).alias("geometry"))


def pixel_rows(masks: DataFrame, name: str) -> DataFrame:
    """``stem, y, x, <name>`` of dense masks."""
    return unrolled(masks, ["stem"], "labels", {name: "smallint"})


def aligned(masks: DataFrame, scored: DataFrame) -> DataFrame:
    """``stem, y, x, target, pred`` of every target pixel; one without a prediction is unknown, which no metric counts.

    Images meet whole, one row each, and their pixels come out together: no pixel is shuffled.
    """

    @F.pandas_udf("array<smallint>")
    def values(data):
        return data.map(lambda b: np.frombuffer(b, np.uint8).astype(np.int16))

    zipped = F.arrays_zip(values("target").alias("target"), values("pred").alias("pred"))
    flat = mask_pairs(masks, scored).select("stem", "width", F.posexplode(zipped).alias("at", "v")).filter("v.target is not null")
    y, x = F.floor(F.col("at") / F.col("width")).cast("int"), (F.col("at") % F.col("width")).cast("int")
    return flat.select("stem", y.alias("y"), x.alias("x"), F.col("v.target").alias("target"), F.coalesce("v.pred", F.lit(UNKNOWN).cast("smallint")).alias("pred"))


def mask_pairs(masks: DataFrame, scored: DataFrame) -> DataFrame:
    """The same as dense pairs: ``stem, height, width, target, pred``, one image a row."""
    both = masks.select("stem", "height", "width", F.col("labels").alias("target")).join(scored.select("stem", F.col("labels").alias("pred")), "stem", "left")
    unknown = F.unhex(F.repeat(F.lit(f"{UNKNOWN:02x}"), (F.col("height") * F.col("width")).cast("int")))
    return both.withColumn("pred", F.coalesce("pred", unknown))


def without_prediction(masks: DataFrame, scored: DataFrame) -> DataFrame:
    """Stems of masks that no prediction belongs to (none, if all is well)."""
    return masks.select("stem").join(scored.select("stem"), "stem", "left_anti")


def evaluate(images: DataFrame, masks: DataFrame, split: DataFrame, name: str, make: Callable[[], Model], target: tuple[int, int] = (384, 512), mode: str = "stretch") -> DataFrame:
    """The metric report of a model over one split: score, put the masks beside, one kernel an image, sums. Images without a prediction count as images, their pixels as unknown."""
    scored = score_masks(in_split(images, split, name), make, target, mode)
    return report_masks(mask_pairs(in_split(masks, split, name), scored))
