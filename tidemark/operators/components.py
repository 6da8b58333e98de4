"""Pixel components (8-connected), their overlaps, and one-to-one matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import OBSTACLE, area_bin, valid
from tidemark.operators.graph import connected_components
from tidemark.operators.morphology import adjacent_runs, runs
from tidemark.session import cut, ship


def label_runs(runs_: DataFrame) -> DataFrame:
    """Adds ``component`` to runs: its first pixel in raster order as ``y, x0`` packed in one number.

    Purely relational: touching runs are edges, distributed components close them.
    """
    coded = lambda y, x: F.shiftleft(y.cast("bigint"), 32) + x
    node = lambda y, x: F.struct(F.col("stem").alias("stem"), coded(y, x).alias("at"))
    runs_ = cut(runs_, "runs")
    edges = adjacent_runs(runs_).select(node(F.col("y"), F.col("x0")).alias("src"), node(F.col("y") + 1, F.col("below_x0")).alias("dst"))
    nodes = runs_.select("*", node(F.col("y"), F.col("x0")).alias("id"))
    parts = connected_components(edges).select("id", F.col("component.at").alias("first"))
    return nodes.join(parts.hint("merge"), "id", "left").select("stem", "y", "x0", "x1", F.coalesce("first", F.col("id.at")).alias("component"))


def component_areas(labelled: DataFrame) -> DataFrame:
    """``stem, component, area``."""
    return labelled.groupBy("stem", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def pixel_components(pixels: DataFrame, mask: Column) -> DataFrame:
    """``stem, y, x0, x1, component`` of the pixels where the mask holds."""
    return label_runs(runs(pixels, mask))


def image_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one dense image with their components: (y, x0, x1, component as index of its first run)."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1] - 1
    root = np.arange(len(y))
    first = np.searchsorted(y, np.arange(mask.shape[0] + 1))
    a, b = [], []
    for row in range(mask.shape[0] - 1):
        up, low = slice(first[row], first[row + 1]), slice(first[row + 1], first[row + 2])
        touch = (x0[up][:, None] <= x1[low][None, :] + 1) & (x1[up][:, None] >= x0[low][None, :] - 1)
        i, j = np.nonzero(touch)
        a.append(i + first[row])
        b.append(j + first[row + 1])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tolist() != root.tolist():
            root = up
    return y, x0, x1, root


def mask_components(masks: DataFrame) -> DataFrame:
    """Runs with components from dense masks ``(stem, height, width, labels)``; labels are bytes, the mask is obstacle.

    The dense twin of ``pixel_components``: one image a row, in batches of Arrow.
    """
    ship(masks.sparkSession)

    def work(frames):
        for frame in frames:
            out = []
            for stem, h, w, data in zip(frame.stem, frame.height, frame.width, frame.labels, strict=True):
                y, x0, x1, root = image_runs(np.frombuffer(data, np.uint8).reshape(h, w) == OBSTACLE)
                out.append(pd.DataFrame({"stem": stem, "y": y, "x0": x0, "x1": x1, "component": (y[root].astype(np.int64) << 32) + x0[root]}))
            yield pd.concat(out) if out else pd.DataFrame({"stem": [], "y": [], "x0": [], "x1": [], "component": []})

    kind = masks.schema["stem"].dataType.simpleString()
    return masks.select("stem", "height", "width", "labels").mapInPandas(work, f"stem {kind}, y int, x0 int, x1 int, component bigint")


def to_masks(pixels: DataFrame, value: Column) -> DataFrame:
    """Dense masks from a pixel table: one image's pixels meet in one row."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", value.cast("int").alias("v"))))
    out = pixels.groupBy("stem").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), cells.alias("c"))
    data = F.unhex(F.array_join(F.transform("c", lambda c: F.lpad(F.hex(c["v"]), 2, "0")), ""))
    return out.select("stem", "height", "width", data.alias("labels"))


def overlaps(targets: DataFrame, preds: DataFrame) -> DataFrame:
    """``stem, gt, pred, inter``: pixels that a target and a predicted component share, from their runs."""
    a = targets.select("stem", "y", "x0", "x1", F.col("component").alias("gt"))
    b = preds.select("stem", "y", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("component").alias("pred"))
    both = a.join(b.hint("merge"), ["stem", "y"]).filter("x0 <= p1 and x1 >= p0")
    return both.groupBy("stem", "gt", "pred").agg(F.sum(F.least("x1", "p1") - F.greatest("x0", "p0") + 1).alias("inter"))


def best_assignment(iou: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a largest-sum one-to-one assignment of rows to columns (shortest augmenting paths with potentials)."""
    flip = iou.shape[0] > iou.shape[1]
    cost = -(iou.T if flip else iou).astype(np.float64)
    n, m = cost.shape
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for row in range(n):
        near, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last = row, -1
        gained = 0.0
        while True:
            slack = cost[at] - u[at] - v + gained
            closer = ~done & (slack < near)
            near[closer], via[closer] = slack[closer], last
            open_ = np.where(done, np.inf, near)
            last = int(open_.argmin())
            gained = open_[last]
            done[last] = True
            if row_of[last] < 0:
                break
            at = row_of[last]
        u[row] += gained
        for column in np.flatnonzero(done):
            if column != last:
                u[row_of[column]] += gained - near[column]
            v[column] -= gained - near[column]
        while last >= 0:
            before = via[last]
            row_of[last] = row_of[before] if before >= 0 else row
            last = before
    pairs = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    return sorted((c, r) for r, c in pairs) if flip else sorted(pairs)


def match_components(shared: DataFrame, gt_areas: DataFrame, pred_areas: DataFrame) -> DataFrame:
    """``stem, gt, pred, inter, gt_area, pred_area, iou`` of the one-to-one pairs whose IoU sums highest in each image.

    Only overlapping pairs can count later, so that an image falls into blocks of components that overlap, directly or through
    others. A block with one component on a side is a maximum, told by a window; the rest are small assignment
    problems, one each. Ties go to the components that come first in raster order.
    """
    a = gt_areas.select("stem", F.col("component").alias("gt"), F.col("area").alias("gt_area"))
    b = pred_areas.select("stem", F.col("component").alias("pred"), F.col("area").alias("pred_area"))
    pairs = shared.join(a.hint("merge"), ["stem", "gt"]).join(b.hint("merge"), ["stem", "pred"])
    pairs = cut(pairs.withColumn("iou", F.col("inter") / F.greatest(F.col("gt_area") + F.col("pred_area") - F.col("inter"), F.lit(1))), "pairs")
    node = lambda side, c: F.struct("stem", F.lit(side).alias("side"), F.col(c).alias("c"))
    parts = connected_components(pairs.select(node(0, "gt").alias("src"), node(1, "pred").alias("dst")))
    pairs = pairs.withColumn("id", node(0, "gt")).join(parts.hint("merge"), "id").drop("id").withColumnRenamed("component", "block")
    w = Window.partitionBy("block")
    pairs = pairs.withColumns({"lo": F.min("gt").over(w) == F.max("gt").over(w), "ro": F.min("pred").over(w) == F.max("pred").over(w)})
    one = F.row_number().over(w.orderBy(F.desc("iou"), "gt", "pred"))
    simple = pairs.filter("lo or ro").withColumn("__n", one).filter("__n = 1")
    names = ["stem", "gt", "pred", "inter", "gt_area", "pred_area", "iou"]
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    ship(shared.sparkSession)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(frame["gt"]), np.unique(frame["pred"])  # a frame's gt is a method
        iou = np.zeros((len(rows), len(cols)))
        i, j = np.searchsorted(rows, frame["gt"]), np.searchsorted(cols, frame["pred"])
        iou[i, j] = frame["iou"]
        chosen = {(r, c) for r, c in best_assignment(iou) if iou[r, c] > 0}
        return frame[[(r, c) in chosen for r, c in zip(i, j, strict=True)]][names]

    hard = pairs.filter("not (lo or ro)").groupBy("block").applyInPandas(solve, ", ".join(f"{n} {kinds[n]}" for n in names))
    return simple.select(*names).unionByName(hard)


def component_tables(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled runs of target and predicted obstacles; pixels that do not count are left out before labelling."""
    return (
        cut(pixel_components(pixels, (F.col("target") == OBSTACLE) & valid()), "target-runs"),
        cut(pixel_components(pixels, (F.col("pred") == OBSTACLE) & valid()), "pred-runs"),
    )


def component_outcomes(pixels: DataFrame, coverage: float = 0.5, least_area: int = 16) -> DataFrame:
    """``stem, side, component, area, bin, accepted``: target components are accepted when recalled, predicted ones when they recall one.

    A matched pair counts from ``coverage`` of the target's pixels on. ``false_positive`` marks predicted components without
    an accepted pair, from ``least_area`` pixels on.
    """
    gt_runs, pred_runs = component_tables(pixels)
    gt, pred = component_areas(gt_runs), component_areas(pred_runs)
    pairs = match_components(overlaps(gt_runs, pred_runs), gt, pred).filter(F.col("inter") / F.greatest("gt_area", F.lit(1)) >= coverage)
    pairs = cut(pairs.select("stem", "gt", "pred"), "accepted")
    done = lambda c: pairs.select("stem", F.col(c).alias("component"), F.lit(True).alias("accepted"))
    sides = [t.join(done(c).hint("merge"), ["stem", "component"], "left").withColumn("side", F.lit(s)) for t, c, s in ((gt, "gt", "target"), (pred, "pred", "pred"))]
    out = sides[0].unionByName(sides[1]).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    fp = (F.col("side") == "pred") & ~F.col("accepted") & (F.col("area") >= least_area)
    return out.select("stem", "side", "component", "area", area_bin(F.col("area")).alias("bin"), "accepted", fp.alias("false_positive"))
