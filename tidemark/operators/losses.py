"""Loss terms as aggregates over logged logits: ``(stem, y, x, target, student[, teacher])``, logits as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import IGNORE, OBSTACLE, ratio
from tidemark.functions.vectors import cross_entropy, kl
from tidemark.operators.morphology import boundary


def _valid() -> Column:
    return F.col("target") != IGNORE


def _ce() -> Column:
    return F.when(_valid(), cross_entropy(F.col("student"), F.col("target")))


def _per_image(pixels: DataFrame, highest: float) -> DataFrame:
    """``stem, weight``: root of valid over obstacle pixels, at most ``highest``."""
    counts = pixels.groupBy("stem").agg(F.count_if(_valid()).alias("v"), F.count_if(F.col("target") == OBSTACLE).alias("o"))
    return counts.select("stem", F.least(F.sqrt(F.greatest("v", F.lit(1)) / F.greatest("o", F.lit(1))), F.lit(highest)).alias("weight"))


def pair_logits(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Student and teacher logits of the same pixel."""
    return student.join(teacher.select("stem", "y", "x", F.col("student").alias("teacher")).hint("merge"), ["stem", "y", "x"])  # pixels are never broadcast


def objective(
    pixels: DataFrame, boundary_weight: float = 0.0, sparse_weight: float = 0.0, kd_weight: float = 0.0, temperature: float = 4.0, radius: int = 3, highest: float = 8.0
) -> DataFrame:
    """One row: ``cross_entropy, boundary_band_ce, sparse_obstacle, kd, segmentation, total``; terms of weight 0 are null.

    With a boundary weight the band term replaces plain cross entropy (it is not added to it); distillation and the sparse term
    are added with their weights.
    """
    if min(boundary_weight, sparse_weight, kd_weight, radius) < 0:
        raise ValueError("weights and radius must not be negative")
    if kd_weight > 0 and "teacher" not in pixels.columns:
        raise ValueError("teacher logits are needed when the distillation weight is positive")
    px = pixels
    if boundary_weight > 0:
        px = boundary(px, (F.col("target") == OBSTACLE) & _valid(), radius, "band")
    if sparse_weight > 0:
        px = px.join(_per_image(pixels, highest).hint("merge"), "stem")
    px = px.withColumns({"ce": _ce(), "ok": _valid()})
    mean = lambda v, w=None: ratio(F.coalesce(F.sum(v), F.lit(0.0)), F.count_if("ok") if w is None else F.sum(w))
    terms = {"cross_entropy": mean(F.col("ce"))}
    if boundary_weight > 0:
        weight = F.when(F.col("ok"), 1.0 + boundary_weight * F.col("band").cast("int"))
        terms["boundary_band_ce"] = mean(F.col("ce") * weight, F.coalesce(weight, F.lit(0.0)))
    if sparse_weight > 0:
        terms["sparse_obstacle"] = mean(F.col("ce") * F.when(F.col("target") == OBSTACLE, F.col("weight")).otherwise(1.0))
    if kd_weight > 0:
        terms["kd"] = temperature**2 * mean(F.when(F.col("ok"), kl(F.col("teacher"), F.col("student"), temperature)))
    out = px.agg(*[v.alias(k) for k, v in terms.items()])
    for name in ("boundary_band_ce", "sparse_obstacle", "kd"):
        if name not in terms:
            out = out.withColumn(name, F.lit(None).cast("double"))
    segmentation = F.col("boundary_band_ce" if boundary_weight > 0 else "cross_entropy")
    extra = lambda name, w: F.coalesce(F.col(name), F.lit(0.0)) * w
    total = segmentation + extra("kd", kd_weight) + extra("sparse_obstacle", sparse_weight)
    return out.withColumns({"segmentation": segmentation, "total": total})


def class_weights(histograms: DataFrame) -> DataFrame:
    """Weights by the inverse root of class frequency, with a frequency-weighted mean of 1: ``class, weight``."""
    sums = histograms.agg(*[F.sum(c).cast("double").alias(c) for c in ("obstacle", "water", "sky")])
    raw = lambda c: F.when(F.col(c) > 0, 1 / F.sqrt(c)).otherwise(0.0)
    total = F.col("obstacle") + F.col("water") + F.col("sky")
    mean = sum((F.col(c) / total * raw(c) for c in ("obstacle", "water", "sky")), F.lit(0.0))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("class"), (raw(c) / mean).alias("weight")) for c in ("obstacle", "water", "sky")])))


def region_weights(pixels: DataFrame, small: DataFrame, low: float = 0.25, high: float = 6.0) -> DataFrame:
    """Pixel weights of region-weighted distillation: ``stem, y, x, weight``, with mean 1 over valid pixels.

    ``pixels(stem, y, x, target, student, teacher)``; ``small(stem, y, x)`` has the pixels of target components of at most 1024
    pixels. Obstacle, small component, boundary band and disagreement add up before the clip.
    """
    from tidemark.functions.vectors import argmax, clamp, softmax

    px = boundary(pixels, (F.col("target") == OBSTACLE) & _valid(), 3, "band")
    px = px.join(small.select("stem", "y", "x", F.lit(1).alias("s")).distinct().hint("merge"), ["stem", "y", "x"], "left").filter(_valid())
    sure = clamp((F.array_max(softmax(F.col("teacher"))) - 0.5) / 0.5, 0.0, 1.0)
    region = 1 + (F.col("target") == OBSTACLE).cast("int") + 2 * F.coalesce("s", F.lit(0)) + F.col("band").cast("int")
    region = region + (argmax(F.col("teacher")) != argmax(F.col("student"))).cast("int")
    px = px.withColumn("w", clamp(region * (0.25 + 0.75 * sure), low, high))
    mean = px.agg(F.avg("w").alias("m")).withColumn("k", F.lit(1))
    return px.withColumn("k", F.lit(1)).join(F.broadcast(mean), "k").select("stem", "y", "x", (F.col("w") / F.col("m")).alias("weight"), "student", "teacher")


def weighted_kd(weighted: DataFrame, temperature: float = 4.0) -> DataFrame:
    """Sum of weight times KL over the sum of weights."""
    return weighted.agg((F.sum(F.col("weight") * kl(F.col("teacher"), F.col("student"), temperature)) / F.sum("weight")).alias("region_kd"))
