"""Metrics over arriving batches: the state holds sums only, ratios are projected where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import confusion_sums, pixel_scores


def running_confusion(pixels: DataFrame, *keys: str) -> DataFrame:
    """Confusion sums by key over a stream (or table) of ``target, pred, keys...``; update or complete output."""
    return pixels.groupBy(*keys).agg(*confusion_sums())


def once_per_image(pixels: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Drops rows that a source delivers again, as long as the watermark lets it remember them."""
    return pixels.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def running_scores(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixel_scores(running_confusion(pixels, *keys), *keys)


def windowed_confusion(pixels: DataFrame, time_col: str, width: str, delay: str) -> DataFrame:
    """Confusion sums for each event-time window; late rows within ``delay`` still count."""
    return pixels.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("window")).agg(*confusion_sums())
