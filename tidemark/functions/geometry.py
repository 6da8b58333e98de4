"""Sizes, padding and crops of the three ways to bring an image to a model's size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("stretch", "letterbox", "center_crop")


def scaled(height: Column, width: Column, target: tuple[int, int], cover: bool) -> tuple[Column, Column]:
    """Size after one scale for both sides, inside or covering the target; halves round to even."""
    by_height, by_width = F.lit(target[0]) / height, F.lit(target[1]) / width
    scale = F.greatest(by_height, by_width) if cover else F.least(by_height, by_width)
    return tuple(F.greatest(F.lit(1), F.bround(side * scale, 0).cast("int")) for side in (height, width))


def geometry(height: Column, width: Column, target: tuple[int, int], mode: str) -> Column:
    """One struct: mode, original, target, resized size, padding (letterbox) or crop (center_crop), each left, top, right, bottom."""
    if mode not in MODES:
        raise ValueError(f"unknown geometry mode: {mode}")
    h, w = target
    size = lambda a, b: F.struct(a.cast("int").alias("height"), b.cast("int").alias("width"))
    box = lambda *v: F.struct(*[x.cast("int").alias(n) for n, x in zip(("left", "top", "right", "bottom"), v, strict=True)])
    none = F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int>")
    padding = crop = none
    rh, rw = F.lit(h), F.lit(w)
    half = lambda x: F.floor(x / 2)
    if mode == "letterbox":
        rh, rw = scaled(height, width, target, cover=False)
        left, top = half(F.lit(w) - rw), half(F.lit(h) - rh)
        padding = box(left, top, F.lit(w) - rw - left, F.lit(h) - rh - top)
    elif mode == "center_crop":
        rh, rw = scaled(height, width, target, cover=True)
        left, top = half(rw - F.lit(w)), half(rh - F.lit(h))
        crop = box(left, top, left + w, top + h)
    return F.struct(
        F.lit(mode).alias("mode"), size(height, width).alias("original_size"), size(F.lit(h), F.lit(w)).alias("target_size"),
        size(rh, rw).alias("resized_size"), padding.alias("padding"), crop.alias("crop"),
    )


def normalise(pixel: Column, mean: float, std: float) -> Column:
    return (pixel / 255.0 - mean) / std
