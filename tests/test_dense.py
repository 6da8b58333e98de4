import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, components, dense, metrics, neardup, scoring, splits
from tidemark.sources import files


def random_pairs(seed, shape, n):
    rng = np.random.default_rng(seed)
    for stem in range(n):
        coarse = rng.integers(0, 3, (-(-shape[0] // 3), -(-shape[1] // 3)))
        t = np.kron(coarse, np.ones((3, 3), int))[: shape[0], : shape[1]]
        p = np.where(rng.random(shape) < 0.15, rng.integers(0, 3, shape), t)
        t = np.where(rng.random(shape) < 0.05, 4, t)
        p = np.where(rng.random(shape) < 0.03, 255, p)
        yield stem, t.astype(np.uint8), p.astype(np.uint8)


def frame_of(spark, pairs):
    rows = [(s, *t.shape, bytearray(t.tobytes()), bytearray(p.tobytes()), s % 2) for s, t, p in pairs]
    return spark.createDataFrame(rows, "stem int, height int, width int, target binary, pred binary, half int")


def pixels_of(spark, pairs):
    rows = [(s, y, x, int(t[y, x]), int(p[y, x]), s % 2) for s, t, p in pairs for y in range(t.shape[0]) for x in range(t.shape[1])]
    return spark.createDataFrame(rows, "stem int, y int, x int, target int, pred int, half int")


def values(frame):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(r.asDict().items())) for r in frame.collect()], key=str)


def test_dense_report_equals_the_windowed_one(spark):
    pairs = list(random_pairs(3, (17, 22), 4))
    masks, px = frame_of(spark, pairs), pixels_of(spark, pairs)
    assert values(dense.mask_pairs(px, "half")) == values(masks)
    assert values(dense.mask_outcomes(masks)) == values(components.component_outcomes(px).drop("bin"))
    assert values(dense.report_masks(masks)) == values(metrics.report(px))
    assert values(dense.report_masks(masks, "half")) == values(metrics.report(px, "half"))


def test_dense_counters_of_full_size_and_degenerate_masks():
    _, t, p = next(random_pairs(5, (384, 512), 1))
    n = dict(zip(dense.COUNTERS, dense.counters(t, p).tolist(), strict=True))
    assert sum(n[f"c_{a}{b}"] for a in range(3) for b in range(3)) == ((t != 4) & (p != 255)).sum()
    assert sum(n[f"n_{b}"] for b in dense.BINS) == len(dense.components((t == 0) & (p != 255))[1])
    for a in (np.zeros((1, 1), np.uint8), np.full((3, 2), 4, np.uint8), np.ones((2, 5), np.uint8)):
        assert len(dense.counters(a, a)) == len(dense.COUNTERS)


def test_images_without_prediction_are_counted(spark):
    _, t, p = next(random_pairs(6, (8, 8), 1))
    masks = spark.createDataFrame([(s, 8, 8, bytearray(t.tobytes())) for s in ("a", "b")], "stem string, height int, width int, labels binary")
    scored = spark.createDataFrame([("a", 8, 8, bytearray(p.tobytes()))], "stem string, height int, width int, labels binary")
    assert [r.stem for r in scoring.without_prediction(masks, scored).collect()] == ["b"]
    row = dense.report_masks(scoring.mask_pairs(masks, scored)).first()
    assert row.images == 2 and row.pixel_accuracy == dense.report_masks(scoring.mask_pairs(masks.filter("stem = 'a'"), scored)).first().pixel_accuracy
    assert scoring.aligned(masks, scored).filter("stem = 'b' and pred = 255").count() == 64


def test_mask_suffixes_and_written_files(spark, tmp_path):
    rows = [("images/x.jpg", b"1"), ("images/y.png", b"22"), ("images/z.bmp", b"0"), ("masks/x.TIFF", b"3"), ("masks/xm.tif", b"4"), ("masks/y.jpg", b"5"), ("masks/z.tiff", b"6"), ("masks/z.png", b"7")]
    frame = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary")
    assert files.write_files(frame, str(tmp_path / "c")) == 8 and files.write_files(frame.limit(0), str(tmp_path / "none")) == 0
    table = files.file_table(spark, str(tmp_path / "c"), content=True)
    assert sorted((r.name, bytes(r.content)) for r in table.collect()) == sorted((a.split("/")[1], b) for a, b in rows)
    side = lambda n: table.filter(F.col("path").contains(f"/{n}/"))
    pairs = {r.stem: r.mask_path and r.mask_path.rsplit("/", 1)[1] for r in files.pair_files(side("images"), side("masks")).collect()}
    assert pairs == {"x": "xm.tif", "y": None, "z": "z.png"}


def test_ranked_within_and_problem_samples(spark):
    rows = spark.createDataFrame([(k % 3, f"s{k:03d}") for k in range(200)], "g int, stem string")
    got = splits.ranked_within(rows, "g", splits.seeded(1, F.col("stem"))).collect()
    import hashlib

    for g in range(3):
        want = sorted((r.stem for r in got if r.g == g), key=lambda s: hashlib.sha256(f"1:{s}".encode()).hexdigest())
        assert [r.stem for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == want
    found = audit.problem_samples(rows.select(F.col("g").cast("string").alias("problem"), "stem"), 4).collect()
    assert {r.problem: (r.n, r.examples) for r in found} == {str(g): (len([k for k in range(200) if k % 3 == g]), [f"s{k:03d}" for k in range(g, 200, 3)][:4]) for g in range(3)}


@pytest.mark.parametrize("block", [7, 1000])
def test_top_across_splits_needs_no_threshold(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 6))
    frame = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "stem int, embedding array<double>")
    members = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)], "stem int, split string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted(((float(u[i] @ u[j]), i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 != j % 2), reverse=True)[:25]
    got = neardup.top_across_splits(frame, members, 25, block).collect()
    assert [(r.src, r.dst) for r in got] == [(i, j) for _, i, j in want] and all(r.left_split == "ab"[r.src % 2] and r.right_split == "ab"[r.dst % 2] for r in got)


def test_assignment_is_not_greedy(spark):
    """Target 2 fits prediction 1 best, but then target 1 and prediction 2 stay alone: the pairs of highest sum leave the best one out. Both forms agree on random blocks."""
    target, pred = np.ones((3, 60), np.uint8), np.ones((3, 60), np.uint8)
    target[:, 0:10] = target[:, 12:22] = 0
    pred[:, 6:18] = pred[:, 20:24] = 0  # 1-1: 4 of 18 columns, 2-1: 6 of 16, 2-2: 2 of 12
    rows = [("a", 3, 60, bytearray(target.tobytes()), bytearray(pred.tobytes()))]
    rng = np.random.default_rng(8)
    for n in range(6):
        t, p = np.ones((24, 30), np.uint8), np.ones((24, 30), np.uint8)
        for k in range(3):
            t[8 * k : 8 * k + int(rng.integers(2, 7)), int(rng.integers(0, 4)) : 30 - int(rng.integers(0, 4))] = 0
            p[int(rng.integers(0, 3)) : 24 - int(rng.integers(0, 3)), 10 * k : 10 * k + int(rng.integers(3, 9))] = 0
        rows.append((f"r{n}", 24, 30, bytearray(t.tobytes()), bytearray(p.tobytes())))
    pairs = spark.createDataFrame(rows, "stem string, height int, width int, target binary, pred binary")
    found = {(r.stem, r.gt, r.pred): (r.inter, r.gt_area, r.pred_area) for r in dense.mask_matches(pairs).collect()}
    assert {k[1:] for k in found if k[0] == "a"} == {(0, 6), (12, 20)}
    shared = dense.mask_overlaps(pairs).collect()
    flat = []
    for stem, h, w, t, p in rows:
        t, p = np.frombuffer(t, np.uint8).reshape(h, w), np.frombuffer(p, np.uint8).reshape(h, w)
        flat += [(stem, y, x, int(t[y, x]), int(p[y, x])) for y in range(h) for x in range(w)]
        by = {}
        for r in shared:
            if r.stem == stem:
                area = lambda m, c: dense.components(m == 0)[1][list(dense.components(m == 0)[2]).index(c)]
                by[r.gt, r.pred] = r.inter / (area(t, r.gt) + area(p, r.pred) - r.inter)
        gts, preds = sorted({g for g, _ in by}), sorted({q for _, q in by})
        best = max(sum(by.get((g, q), 0) for g, q in zip(gts, order, strict=False)) for order in itertools.permutations(preds, min(len(gts), len(preds))))
        mine = sum(by[g, q] for s, g, q in found if s == stem)
        assert abs(mine - best) < 1e-12
    px = spark.createDataFrame(flat, "stem string, y int, x int, target int, pred int")
    gt, pr = components.component_tables(px)
    other = components.match_components(components.overlaps(gt, pr), components.component_areas(gt), components.component_areas(pr)).collect()
    assert {(r.stem, r.gt, r.pred): (r.inter, r.gt_area, r.pred_area) for r in other} == found
