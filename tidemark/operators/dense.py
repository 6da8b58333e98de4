"""Evaluation of dense mask pairs: one kernel an image yields counters, and Spark only sums them.

The windowed operators of ``morphology``, ``components`` and ``metrics`` give the same numbers from pixel tables, for pixels that are
no whole images; here an image is one row, so that nothing but its counters is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import AREA_BINS, IGNORE, OBSTACLE, TOLERANCES, UNKNOWN, WATER
from tidemark.operators.components import best_assignment, image_runs
from tidemark.operators.metrics import CELLS, boundary_ratios, component_ratios, pixel_scores, with_score
from tidemark.operators.morphology import dense_boundary, dense_dilate
from tidemark.session import ship

BOUNDARY = ("predicted", "tp_precision", "target", "tp_recall")
BINS = [name for name, _, _ in AREA_BINS]
#: The counters of an image, in order.
COUNTERS = (
    *(f"c_{t}{p}" for t, p in CELLS),
    *(f"{c}{d}" for d in TOLERANCES for c in BOUNDARY),
    *(f"n_{b}" for b in BINS), *(f"r_{b}" for b in BINS), "fp",
    "edge_columns", "edge_distance", "edge_square",
)


def mask_pairs(pixels: DataFrame, *keys: str) -> DataFrame:
    """Dense pairs ``stem, keys, height, width, target, pred`` (a byte a pixel) from a pixel table: an image's pixels meet in one row."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col("target").cast("int").alias("t"), F.col("pred").cast("int").alias("p"))))
    out = pixels.groupBy("stem", *keys).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), cells.alias("c"))
    data = lambda v: F.unhex(F.array_join(F.transform("c", lambda c: F.lpad(F.hex(c[v]), 2, "0")), ""))
    return out.select("stem", *keys, "height", "width", data("t").alias("target"), data("p").alias("pred"))


def gray_images(pixels: DataFrame, value: str) -> DataFrame:
    """Gray images ``stem, height, width, channels, data`` from a pixel table."""
    images = mask_pairs(pixels.select("stem", "y", "x", F.col(value).alias("target"), F.lit(0).alias("pred")))
    return images.select("stem", "height", "width", F.lit(1).alias("channels"), F.col("target").alias("data"))


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pixel's component (0: none, else from 1 in raster order of first pixels), their areas, and their first pixels as (y << 32) + x."""
    y, x0, x1, root = image_runs(mask)
    first, number = np.unique(root, return_inverse=True)
    size = x1 - x0 + 1
    labels = np.zeros(mask.size, np.int64)
    start = y * mask.shape[1] + x0
    labels[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(number + 1, size)
    areas = np.bincount(number, weights=size, minlength=len(first)).astype(np.int64)
    return labels.reshape(mask.shape), areas, (y[first].astype(np.int64) << 32) + x0[first]


def matched(target: np.ndarray, pred: np.ndarray, areas: np.ndarray, pred_areas: np.ndarray) -> list[tuple[int, int, int]]:
    """(target component, predicted one, shared pixels) of the one-to-one pairs whose IoU sums highest; components from 0.

    Components that overlap, directly or through others, are one block; ties go to those first in raster order.
    """
    both = (target > 0) & (pred > 0)
    code, inter = np.unique((target[both] - 1) * max(1, len(pred_areas)) + pred[both] - 1, return_counts=True)
    a, b = np.divmod(code, max(1, len(pred_areas)))
    iou = inter / np.maximum(areas[a] + pred_areas[b] - inter, 1)
    block = np.arange(len(areas))
    while True:  # the least target component that a component reaches
        least = np.full(len(pred_areas), len(areas))
        np.minimum.at(least, b, block[a])
        new = block.copy()
        np.minimum.at(new, a, least[b])
        if np.array_equal(new, block):
            break
        block = new
    out = []
    order = np.argsort(block[a], kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(block[a][order])) + 1) if len(order) else []:
        rows, cols = np.unique(a[part]), np.unique(b[part])
        if len(rows) == 1 or len(cols) == 1:
            best = part[np.lexsort((b[part], a[part], -iou[part]))[0]]
            out.append((int(a[best]), int(b[best]), int(inter[best])))
            continue
        cost, shared = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), np.int64)
        place = np.searchsorted(rows, a[part]), np.searchsorted(cols, b[part])
        cost[place], shared[place] = iou[part], inter[part]
        out += [(int(rows[r]), int(cols[c]), int(shared[r, c])) for r, c in best_assignment(cost) if cost[r, c] > 0]
    return out


def _bins(areas: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted([high for _, _, high in AREA_BINS[:-1]], areas), minlength=len(AREA_BINS))


def outcomes(target: np.ndarray, pred: np.ndarray, coverage: float = 0.5, least_area: int = 16) -> dict[str, np.ndarray]:
    """Components of both sides with what became of them, as ``operators.components.component_outcomes`` tells it."""
    ok = (target != IGNORE) & (pred != UNKNOWN)
    (t, t_area, t_first), (p, p_area, p_first) = components((target == OBSTACLE) & ok), components((pred == OBSTACLE) & ok)
    t_done, p_done = np.zeros(len(t_area), bool), np.zeros(len(p_area), bool)
    for i, j, inter in matched(t, p, t_area, p_area):
        if inter / max(t_area[i], 1) >= coverage:
            t_done[i] = p_done[j] = True
    return {
        "side": np.repeat(["target", "pred"], [len(t_area), len(p_area)]), "component": np.concatenate([t_first, p_first]), "area": np.concatenate([t_area, p_area]),
        "accepted": np.concatenate([t_done, p_done]), "false_positive": np.concatenate([np.zeros(len(t_area), bool), ~p_done & (p_area >= least_area)]),
    }


def counters(target: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """The image's COUNTERS."""
    ok = (target != IGNORE) & (pred != UNKNOWN)
    plain = ok & (target < 3) & (pred < 3)
    out = [np.bincount(target[plain].astype(np.int64) * 3 + pred[plain], minlength=9)]
    tb, pb = dense_boundary(target == OBSTACLE, 1) & ok, dense_boundary(pred == OBSTACLE, 1) & ok
    for d in TOLERANCES:
        out.append([pb.sum(), (pb & dense_dilate(tb, d)).sum(), tb.sum(), (tb & dense_dilate(pb, d)).sum()])
    found = outcomes(target, pred)
    mine = found["side"] == "target"
    out += [_bins(found["area"][mine]), _bins(found["area"][mine & found["accepted"]]), [found["false_positive"].sum()]]
    water = [(m == WATER) for m in (target, pred)]
    both = water[0].any(0) & water[1].any(0)
    gap = (water[1].argmax(0) - water[0].argmax(0))[both]
    out.append([len(gap), np.abs(gap).sum(), (gap * gap).sum()])
    return np.concatenate(out).astype(np.int64)


def _images(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            shape = row.height, row.width
            yield row, np.frombuffer(row.target, np.uint8).reshape(shape), np.frombuffer(row.pred, np.uint8).reshape(shape)


def image_counters(pairs: DataFrame, *keys: str) -> DataFrame:
    """``stem, keys`` and one column for each of COUNTERS: ``pairs(stem, keys, height, width, target, pred)``."""
    ship(pairs.sparkSession)
    kept = ["stem", *keys]

    def run(frames):
        for row, t, p in _images(frames):
            yield pd.DataFrame([(*[getattr(row, k) for k in kept], counters(t, p))], columns=[*kept, "n"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in kept)
    out = pairs.select(*kept, "height", "width", "target", "pred").mapInPandas(run, f"{kinds}, n array<bigint>")
    return out.select(*kept, *[F.get("n", k).alias(name) for k, name in enumerate(COUNTERS)])


def mask_outcomes(pairs: DataFrame) -> DataFrame:
    """``stem, side, component, area, accepted, false_positive`` of every component."""
    ship(pairs.sparkSession)

    def run(frames):
        for row, t, p in _images(frames):
            found = pd.DataFrame(outcomes(t, p))
            found.insert(0, "stem", row.stem)
            yield found

    kind = pairs.schema["stem"].dataType.simpleString()
    return pairs.select("stem", "height", "width", "target", "pred").mapInPandas(run, f"stem {kind}, side string, component bigint, area bigint, accepted boolean, false_positive boolean")


def _component_pairs(pairs: DataFrame, chosen) -> DataFrame:
    """``stem, gt, pred, inter, gt_area, pred_area`` of the pairs of components that ``chosen(target, pred, areas, areas)`` names by number."""
    ship(pairs.sparkSession)
    columns = ["stem", "gt", "pred", "inter", "gt_area", "pred_area"]

    def run(frames):
        for row, target, pred in _images(frames):
            ok = (target != IGNORE) & (pred != UNKNOWN)
            (t, t_area, t_first), (p, p_area, p_first) = components((target == OBSTACLE) & ok), components((pred == OBSTACLE) & ok)
            found = [(row.stem, t_first[i], p_first[j], n, t_area[i], p_area[j]) for i, j, n in chosen(t, p, t_area, p_area)]
            yield pd.DataFrame(found, columns=columns)

    kind = pairs.schema["stem"].dataType.simpleString()
    schema = f"stem {kind}, " + ", ".join(f"{c} bigint" for c in columns[1:])
    return pairs.select("stem", "height", "width", "target", "pred").mapInPandas(run, schema)


def _shared(target: np.ndarray, pred: np.ndarray, areas: np.ndarray, pred_areas: np.ndarray) -> list[tuple[int, int, int]]:
    both = (target > 0) & (pred > 0)
    code, inter = np.unique((target[both] - 1) * max(1, len(pred_areas)) + pred[both] - 1, return_counts=True)
    return list(zip(*(x.tolist() for x in np.divmod(code, max(1, len(pred_areas)))), inter.tolist(), strict=True))


def mask_overlaps(pairs: DataFrame) -> DataFrame:
    """``stem, gt, pred, inter``: pixels that a target and a predicted component share, as ``components.overlaps`` gives them."""
    return _component_pairs(pairs, _shared).select("stem", "gt", "pred", "inter")


def mask_matches(pairs: DataFrame) -> DataFrame:
    """``stem, gt, pred, inter, gt_area, pred_area, iou`` of the one-to-one pairs whose IoU sums highest, as ``components.match_components`` gives them."""
    found = _component_pairs(pairs, matched)
    return found.withColumn("iou", F.col("inter") / F.greatest(F.col("gt_area") + F.col("pred_area") - F.col("inter"), F.lit(1)))


def boundary_counts(pairs: DataFrame) -> DataFrame:
    """``stem, tolerance, predicted, tp_precision, target, tp_recall``."""
    sums = [F.struct(F.lit(d).alias("tolerance"), *[F.col(f"{c}{d}").alias(c) for c in BOUNDARY]) for d in TOLERANCES]
    return image_counters(pairs).select("stem", F.inline(F.array(*sums)))


def report_masks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Every metric in one row, in all or by key, as ``metrics.report`` gives them: one pass over the images, one small aggregation."""
    sums = image_counters(pairs, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), *[F.sum(c).alias(c) for c in COUNTERS])
    rest = ["images", *COUNTERS]
    out = pixel_scores(sums, *keys, *rest)
    out = component_ratios(boundary_ratios(out))
    n = F.greatest("edge_columns", F.lit(1))
    out = out.withColumns({"water_edge_mae_px": F.col("edge_distance") / n, "water_edge_rmse_px": F.sqrt(F.col("edge_square") / n)})
    return with_score(out).drop(*COUNTERS)
