"""Label, class and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label ids, area bins, score weights and colours of the evaluation protocol.
OBSTACLE, WATER, SKY, IGNORE, UNKNOWN = 0, 1, 2, 4, 255
CLASS_NAMES = ("obstacle", "water", "sky")
AREA_BINS = (("tiny", 1, 64), ("very_small", 65, 256), ("small", 257, 1024), ("medium_plus", 1025, None))
SMALL_BINS = ("tiny", "very_small", "small")
SCORE_WEIGHTS = {"obstacle_f1": 0.40, "small_component_recall": 0.30, "boundary_f1_tol3": 0.20, "one_minus_obstacle_pixel_fpr": 0.10}
PALETTE = {OBSTACLE: (255, 210, 0), WATER: (0, 210, 255), SKY: (55, 70, 150)}
TOLERANCES = (1, 3, 5)


def valid(target: str = "target", pred: str | None = "pred") -> Column:
    """Pixels that count: target not ignored, prediction (if any) not unknown."""
    keep = F.col(target) != IGNORE
    return keep if pred is None else keep & (F.col(pred) != UNKNOWN)


def is_class(label: str, k: int) -> Column:
    return F.col(label) == k


def area_bin(area: Column) -> Column:
    """Name of the area's bin; an area below 1 is an error."""
    out = F.when(area < 1, F.raise_error(F.concat(F.lit("invalid component area: "), area.cast("string"))))
    for name, low, high in AREA_BINS:
        out = out.when((area >= low) & (area <= high) if high else area >= low, F.lit(name))
    return out


def ratio(num: Column, den: Column, least: float = 1) -> Column:
    """num / max(den, least): an undefined ratio is 0."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(float(least)))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def safety_score(obstacle_f1: Column, small_recall: Column, boundary_f1: Column, fpr: Column) -> Column:
    parts = zip(SCORE_WEIGHTS.values(), (obstacle_f1, small_recall, boundary_f1, 1.0 - fpr), strict=True)
    return sum((part * weight for weight, part in parts), F.lit(0.0))


def colour(label: Column, fallback: tuple[int, int, int] = (128, 128, 128)) -> Column:
    """RGB of a label; ``fallback`` for those without a colour (gray for predictions, black for previews)."""
    out = None
    for k, rgb in PALETTE.items():
        rgb = F.array(*[F.lit(v) for v in rgb])
        out = F.when(label == k, rgb) if out is None else out.when(label == k, rgb)
    return out.otherwise(F.array(*[F.lit(v) for v in fallback]))
