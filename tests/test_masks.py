import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.labels import SCORE_WEIGHTS, area_bin, colour
from tidemark.operators import components, losses, metrics, morphology


def table(spark, target, pred=None, stem="a"):
    pred = target if pred is None else pred
    h, w = target.shape
    return spark.createDataFrame([(stem, y, x, int(target[y, x]), int(pred[y, x])) for y in range(h) for x in range(w)], "stem string, y int, x int, target int, pred int")


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_window_and_dense_boundaries_agree(spark, radius):
    mask = np.random.default_rng(42).random((19, 23)) < 0.3
    got = morphology.boundary(table(spark, np.where(mask, 0, 1)), F.col("target") == 0, radius, "b").collect()
    out = np.zeros(mask.shape, bool)
    for r in got:
        out[r.y, r.x] = r.b
    assert (out == morphology.dense_boundary(mask, radius)).all()


def test_dilation_is_square():
    mask = np.zeros((9, 11), bool)
    mask[4, 5] = True
    out = np.zeros_like(mask)
    out[2:7, 3:8] = True
    assert (morphology.dense_dilate(mask, 2) == out).all()
    assert not morphology.dense_boundary(np.ones((5, 5), bool), 1).any()


@pytest.mark.parametrize("shift", [1, 3, 4])
def test_boundary_tolerance(spark, shift):
    target, pred = np.ones((16, 30), int), np.ones((16, 30), int)
    target[:, :12], pred[:, : 12 + shift] = 0, 0
    row = metrics.boundary_scores(morphology.boundary_counts(table(spark, target, pred))).first()
    assert (row.boundary_f1_tol3 == 1.0) == (shift <= 3)


def test_components_are_eight_connected(spark):
    m = np.ones((16, 16), int)
    m[5, 5] = m[6, 6] = 0
    px = table(spark, m)
    assert [r.area for r in components.component_areas(components.pixel_components(px, F.col("target") == 0)).collect()] == [2]


def test_relational_and_dense_components_agree(spark, rows):
    m = np.where(np.random.default_rng(3).random((20, 25)) < 0.45, 0, 1)
    m[0] = 1
    m[3, 2:22] = 0
    px = table(spark, m)
    a = components.pixel_components(px, F.col("target") == 0)
    b = components.mask_components(components.to_masks(px, F.col("target")))
    assert rows(a.select("y", "x0", "x1", "component")) == rows(b.select("y", "x0", "x1", "component"))


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in [(2, 2), (3, 5), (5, 3), (4, 4), (1, 3)]:
        for _ in range(10):
            s = rng.random((n, m)) * (rng.random((n, m)) < 0.7)
            got = sum(s[r, c] for r, c in components.best_assignment(s))
            a, b = (s, (n, m)) if n <= m else (s.T, (m, n))
            best = max(sum(a[i, p[i]] for i in range(b[0])) for p in itertools.permutations(range(b[1]), b[0]))
            assert got == pytest.approx(best)
    assert components.best_assignment(np.array([[0.9, 0.8], [0.85, 0.1]])) == [(0, 1), (1, 0)]


def test_one_to_one_recall_and_false_positives(spark):
    target, pred = np.ones((32, 32), int), np.ones((32, 32), int)
    target[4:8, 4:8] = target[4:8, 12:16] = 0
    pred[4:8, 4:16] = 0
    pred[20:24, 4:8] = 0
    pred[20:23, 20:25] = 0
    row = metrics.component_scores(components.component_outcomes(table(spark, target, pred)), spark.createDataFrame([("a",)], "stem string")).first()
    assert row.component_count_tiny == 2 and row.component_recall_tiny == 0.5 and row.false_positive_components_per_100_images == 100.0


def test_report_of_a_perfect_prediction_and_of_nothing(spark):
    m = np.full((12, 12), 1)
    m[:4], m[6:9, 3:6], m[11] = 2, 0, 4
    row = metrics.report(table(spark, m)).first()
    assert row.pixel_accuracy == row.mean_iou == row.obstacle_f1 == row.boundary_f1 == 1.0 and row.safety_score == pytest.approx(1.0)
    assert row.water_edge_mae_px == row.false_positive_components_per_100_images == 0.0
    ignored = metrics.pixel_scores(metrics.confusion(table(spark, np.full((3, 3), 4)))).first()
    assert set(ignored) == {0.0}
    unknown = metrics.confusion(table(spark, np.zeros((3, 3), int), np.full((3, 3), 255))).first()
    assert sum(unknown) == 0


def test_bins_colours_weights(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (64,), (65,), (256,), (257,), (1024,), (1025,)], "a int").select(area_bin(F.col("a"))).collect()]
    assert got == ["tiny", "tiny", "very_small", "very_small", "small", "small", "medium_plus"]
    with pytest.raises(Exception, match="invalid component area"):
        spark.createDataFrame([(0,)], "a int").select(area_bin(F.col("a"))).collect()
    assert [r[0] for r in spark.createDataFrame([(0,), (9,)], "l int").select(colour(F.col("l"))).collect()] == [[255, 210, 0], [128, 128, 128]]
    assert sum(SCORE_WEIGHTS.values()) == pytest.approx(1.0)


def logit_table(spark, target, wrong, ignore=()):
    rows = []
    for (y, x), t in np.ndenumerate(target):
        t = 4 if (y, x) in ignore else int(t)
        right = t if t < 3 else 0
        k = (right + 1) % 3 if (y, x) in wrong else right
        rows.append(("a", y, x, t, [5.0 if c == k else -5.0 for c in range(3)]))
    return spark.createDataFrame(rows, "stem string, y int, x int, target int, student array<double>")


def test_band_errors_cost_more(spark):
    target = np.ones((17, 17), int)
    target[3:14, 3:14] = 0
    loss = lambda wrong: losses.objective(logit_table(spark, target, wrong, {(0, 0)}), boundary_weight=4.0).first()
    edge, inside = loss({(3, 8)}), loss({(8, 8)})
    assert edge.boundary_band_ce > inside.boundary_band_ce and edge.cross_entropy == pytest.approx(inside.cross_entropy)
    assert edge.total == edge.boundary_band_ce


def test_objective_checks(spark):
    px = logit_table(spark, np.zeros((2, 2), int), set())
    with pytest.raises(ValueError):
        losses.objective(px, kd_weight=1.0)
    with pytest.raises(ValueError):
        losses.objective(px, boundary_weight=-1.0)
    same = losses.objective(losses.pair_logits(px, px), kd_weight=1.0).first()
    assert same.kd == pytest.approx(0.0)


def test_region_weights_have_mean_one(spark):
    px = logit_table(spark, np.array([[0, 0, 1], [1, 2, 2]]), {(0, 1)})
    px = px.withColumn("teacher", F.col("student"))
    w = losses.region_weights(px, px.filter("target = 0").select("stem", "y", "x"))
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
