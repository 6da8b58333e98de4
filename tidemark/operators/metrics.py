"""Segmentation metrics as sums that merge, and ratios that are projected from them at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import AREA_BINS, CLASS_NAMES, SMALL_BINS, TOLERANCES, f1, ratio, safety_score, valid
from tidemark.operators.components import component_outcomes
from tidemark.operators.morphology import boundary_counts

CELLS = [(t, p) for t in range(3) for p in range(3)]


def confusion_sums() -> list[Column]:
    """Nine aggregate columns ``c_<target><pred>``; they add up over any partition of the pixels."""
    return [F.count_if(valid() & (F.col("target") == t) & (F.col("pred") == p)).alias(f"c_{t}{p}") for t, p in CELLS]


def confusion(pixels: DataFrame, *keys: str) -> DataFrame:
    """The confusion matrix of valid pixels, in all or by key."""
    return pixels.groupBy(*keys).agg(*confusion_sums())


def cell_counts(pixels: DataFrame) -> DataFrame:
    """The matrix in long form: ``target, pred, n``."""
    return pixels.filter(valid()).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))


def histograms(labels: DataFrame, label: str = "target") -> DataFrame:
    """Pixels of each class for every image; other labels are left out."""
    return labels.groupBy("stem").agg(*[F.count_if(F.col(label) == k).alias(n) for k, n in enumerate(CLASS_NAMES)])


def class_scores(matrix: DataFrame, *keys: str) -> DataFrame:
    """TP, FP, FN, IoU, precision, recall and F1 of each class from a confusion row: one row a class."""
    cell = lambda t, p: F.col(f"c_{t}{p}")
    rows = []
    for k, name in enumerate(CLASS_NAMES):
        fp = sum((cell(t, k) for t in range(3) if t != k), F.lit(0))
        fn = sum((cell(k, p) for p in range(3) if p != k), F.lit(0))
        rows.append(F.struct(F.lit(name).alias("class"), cell(k, k).alias("tp"), fp.alias("fp"), fn.alias("fn")))
    out = matrix.select(*keys, F.inline(F.array(*rows)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({"iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def pixel_scores(matrix: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, mean IoU (an absent class counts 0), obstacle scores and false-positive rate, IoU of each class."""
    cell = lambda t, p: F.col(f"c_{t}{p}")
    row = lambda t: sum((cell(t, p) for p in range(3)), F.lit(0))
    col = lambda p: sum((cell(t, p) for t in range(3)), F.lit(0))
    iou = [ratio(cell(k, k), row(k) + col(k) - cell(k, k)) for k in range(3)]
    precision, recall = ratio(cell(0, 0), col(0)), ratio(cell(0, 0), row(0))
    return matrix.select(
        *keys,
        ratio(cell(0, 0) + cell(1, 1) + cell(2, 2), row(0) + row(1) + row(2)).alias("pixel_accuracy"),
        ((iou[0] + iou[1] + iou[2]) / 3).alias("mean_iou"),
        precision.alias("obstacle_precision"), recall.alias("obstacle_recall"), f1(precision, recall).alias("obstacle_f1"),
        ratio(cell(1, 0) + cell(2, 0), row(1) + row(2)).alias("obstacle_pixel_fpr"),
        *[x.alias(f"iou_{n}") for x, n in zip(iou, CLASS_NAMES, strict=True)],
    )


def boundary_scores(counts: DataFrame, *keys: str) -> DataFrame:
    """Boundary F1 at each tolerance, counts pooled over images."""
    pooled = counts.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("tolerance") == d, F.col(c))).alias(f"{c}{d}") for d in TOLERANCES for c in ("predicted", "tp_precision", "target", "tp_recall")
    ])
    out = boundary_ratios(pooled)
    return out.select(*keys, *[f"boundary_f1_tol{d}" for d in TOLERANCES])


def boundary_ratios(pooled: DataFrame) -> DataFrame:
    """Adds the boundary F1 of each tolerance to columns ``predicted1, tp_precision1, ...``."""
    count = lambda c, d: F.coalesce(f"{c}{d}", F.lit(0))
    score = lambda d: f1(ratio(count("tp_precision", d), count("predicted", d)), ratio(count("tp_recall", d), count("target", d)))
    return pooled.withColumns({f"boundary_f1_tol{d}": score(d) for d in TOLERANCES})


def component_scores(outcomes: DataFrame, images: DataFrame, *keys: str) -> DataFrame:
    """Component counts and recall by area bin, pooled recall of small ones, false positives per 100 images.

    ``images`` has one row for each evaluated image (with the keys), those without components too.
    """
    target, bins = F.col("side") == "target", [n for n, _, _ in AREA_BINS]
    sums = [F.count_if(target & (F.col("bin") == n)).alias(f"n_{n}") for n in bins] + [F.count_if(target & F.col("accepted") & (F.col("bin") == n)).alias(f"r_{n}") for n in bins]
    left = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("images"))
    right = outcomes.groupBy(*keys).agg(*sums, F.count_if("false_positive").alias("fp"))
    both = _beside(left, right, keys)
    out = component_ratios(both)
    return out.select(
        *keys, "images", *[f"component_count_{n}" for n in bins], *[f"component_recall_{n}" for n in bins], "small_component_recall", "false_positive_components_per_100_images"
    )


def component_ratios(sums: DataFrame) -> DataFrame:
    """Adds counts, recalls and false positives to columns ``images, n_<bin>, r_<bin>, fp``."""
    bins = [n for n, _, _ in AREA_BINS]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    small = lambda p: sum((zero(f"{p}_{n}") for n in SMALL_BINS), F.lit(0))
    return sums.withColumns(
        {f"component_count_{n}": zero(f"n_{n}").cast("double") for n in bins}
        | {f"component_recall_{n}": ratio(zero(f"r_{n}"), zero(f"n_{n}")) for n in bins}
        | {"small_component_recall": ratio(small("r"), small("n")), "false_positive_components_per_100_images": 100.0 * ratio(zero("fp"), F.col("images"))}
    )


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join by key; frames of one row each are put side by side."""
    if keys:
        return left.join(right, list(keys), "left")
    return left.withColumn("__k", F.lit(1)).join(F.broadcast(right.withColumn("__k", F.lit(1))), "__k", "left").drop("__k")  # one row each


def water_edge(pixels: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute and root mean square distance of the topmost water pixel, over columns where both sides have water."""
    columns = pixels.groupBy(*keys, "stem", "x").agg(
        F.min(F.when(F.col("target") == 1, F.col("y"))).alias("t"), F.min(F.when(F.col("pred") == 1, F.col("y"))).alias("p")
    )
    d = (F.col("p") - F.col("t")).cast("double")
    return columns.groupBy(*keys).agg(
        F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias("water_edge_mae_px"), F.sqrt(F.coalesce(F.avg(d * d), F.lit(0.0))).alias("water_edge_rmse_px")
    )


def report(pixels: DataFrame, *keys: str) -> DataFrame:
    """Every metric in one row, in all or by key: ``pixels(stem, y, x, target, pred, keys...)``.

    A stem belongs to one key. The parts are sums of their own and meet as one row a key.
    """
    owner = pixels.select("stem", *keys).distinct()
    keyed = lambda t: t.join(owner, "stem") if keys else t
    out = pixel_scores(confusion(pixels, *keys), *keys)
    for part in (
        boundary_scores(keyed(boundary_counts(pixels)), *keys),
        component_scores(keyed(component_outcomes(pixels)), owner, *keys),
        water_edge(pixels, *keys),
    ):
        out = _beside(out, part, keys)
    return with_score(out)


def with_score(out: DataFrame) -> DataFrame:
    """Adds the headline boundary F1 and the safety score."""
    score = safety_score(F.col("obstacle_f1"), F.col("small_component_recall"), F.col("boundary_f1_tol3"), F.col("obstacle_pixel_fpr"))
    return out.withColumns({"boundary_f1": F.col("boundary_f1_tol3"), "safety_score": score})
