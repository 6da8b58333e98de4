"""Neighbourhood operations on pixel tables ``(stem, y, x, ...)`` as window functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spread(pixels: DataFrame, wanted: dict[str, tuple[Column, int, Callable]]) -> DataFrame:
    """Separable square neighbourhoods, each ``name: (value, radius, aggregate)``: along rows, then along columns; frames end at the image's border.

    All of them share one sort along rows and one along columns.
    """
    row = lambda r: Window.partitionBy("stem", "y").orderBy("x").rangeBetween(-r, r)
    column = lambda r: Window.partitionBy("stem", "x").orderBy("y").rangeBetween(-r, r)
    across = pixels.withColumns({f"__m_{n}": agg(v.cast("int")).over(row(r)) for n, (v, r, agg) in wanted.items()})
    return across.withColumns({n: agg(f"__m_{n}").over(column(r)).cast("boolean") for n, (_, r, agg) in wanted.items()}).drop(*[f"__m_{n}" for n in wanted])


def dilate(pixels: DataFrame, mask: Column, radius: int, out: str) -> DataFrame:
    """True where any pixel within the square radius is; outside counts as false."""
    return _spread(pixels, {out: (mask, radius, F.max)})


def erode(pixels: DataFrame, mask: Column, radius: int, out: str) -> DataFrame:
    """True where all pixels within the square radius are; outside counts as true."""
    return _spread(pixels, {out: (mask, radius, F.min)})


def boundaries(pixels: DataFrame, masks: dict[str, Column], radius: int) -> DataFrame:
    """Dilation without erosion, of each ``name: mask``. Images' borders make none."""
    wanted = {f"__{k}_{n}": (m, radius, agg) for n, m in masks.items() for k, agg in (("d", F.max), ("e", F.min))}
    return _spread(pixels, wanted).withColumns({n: F.col(f"__d_{n}") & ~F.col(f"__e_{n}") for n in masks}).drop(*wanted)


def boundary(pixels: DataFrame, mask: Column, radius: int, out: str) -> DataFrame:
    """The same of one mask."""
    return boundaries(pixels, {out: mask}, radius)


def dense_boundary(mask: np.ndarray, radius: int) -> np.ndarray:
    """The same for one dense image."""
    return dense_dilate(mask, radius) & dense_dilate(~mask, radius)


def dense_dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Square dilation through a summed-area table; outside counts as false."""
    total = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    total[1:, 1:] = mask.astype(np.int64).cumsum(0).cumsum(1)
    top, bottom = np.maximum(np.arange(mask.shape[0]) - radius, 0), np.minimum(np.arange(mask.shape[0]) + radius + 1, mask.shape[0])
    left, right = np.maximum(np.arange(mask.shape[1]) - radius, 0), np.minimum(np.arange(mask.shape[1]) + radius + 1, mask.shape[1])
    inside = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    return inside > 0


def runs(pixels: DataFrame, mask: Column) -> DataFrame:
    """``stem, y, x0, x1``: maximal horizontal runs of pixels where the mask holds."""
    row = Window.partitionBy("stem", "y").orderBy("x")
    inside = pixels.filter(mask).select("stem", "y", "x", (F.col("x") - F.row_number().over(row)).alias("__g"))
    return inside.groupBy("stem", "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__g")


def adjacent_runs(runs_: DataFrame) -> DataFrame:
    """Pairs of runs in consecutive rows that touch, corners included: ``stem, y, x0, below_x0``."""
    a = runs_.select("stem", "y", "x0", "x1")
    b = runs_.select("stem", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    touch = (F.col("x0") <= F.col("bx1") + 1) & (F.col("x1") >= F.col("bx0") - 1)
    return a.join(b.hint("merge"), ["stem", "y"]).filter(touch).select("stem", "y", "x0", F.col("bx0").alias("below_x0"))


def boundary_counts(pixels: DataFrame, tolerances: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``stem, tolerance, predicted, tp_precision, target, tp_recall`` over valid pixels.

    ``pixels(stem, y, x, target, pred)``. Boundaries come from the obstacle masks of the whole image; ignored pixels are
    left out afterwards. A boundary pixel counts where the other side has one within the square tolerance.
    """
    from tidemark.functions.labels import OBSTACLE, valid

    px = boundaries(pixels, {"pb": F.col("pred") == OBSTACLE, "tb": F.col("target") == OBSTACLE}, 1)
    px = px.withColumns({"pb": F.col("pb") & valid(), "tb": F.col("tb") & valid()})
    px = _spread(px, {f"{s}d{d}": (F.col(f"{s}b"), d, F.max) for d in tolerances for s in "pt"})
    sums = [
        F.struct(
            F.lit(d).alias("tolerance"),
            F.count_if(F.col("pb")).alias("predicted"),
            F.count_if(F.col("pb") & F.col(f"td{d}")).alias("tp_precision"),
            F.count_if(F.col("tb")).alias("target"),
            F.count_if(F.col("tb") & F.col(f"pd{d}")).alias("tp_recall"),
        )
        for d in tolerances
    ]
    return px.groupBy("stem").agg(F.array(*sums).alias("t")).select("stem", F.inline("t"))
