"""All registered queries of the library, and DuckDB SQL for those that SQL can express. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels as lab
from tidemark.functions import paths, vectors
from tidemark.functions.geometry import MODES, geometry, normalise
from tidemark.operators import audit, components, dense, experiments, graph, losses, metrics, morphology, neardup, provenance, splits
from tidemark.operators.imagejobs import resize_pixels
from tidemark.plans import fixtures as fx
from tidemark.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*[(F.round(F.col(f.name), 6) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, doubles: str = ""):
    """Register a query with its SQL; ``doubles`` names the columns that the SQL rounds."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        QUERIES[name] = lambda spark, d: rounded(fn(spark, d))
        if sql:
            fix = ", ".join(f"round({c}::DOUBLE, 6) + 0.0 as {c}" for c in doubles.split())
            SQL[name] = f"select * replace ({fix}) from ({sql}) q" if fix else sql
        return fn

    return add


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# --- pixels and classes -------------------------------------------------------------------------------------------

CM = ", ".join(f"count(*) filter (where target <> 4 and pred <> 255 and target = {t} and pred = {p}) as c_{t}{p}" for t, p in metrics.CELLS)
ROW = lambda t: "(" + " + ".join(f"c_{t}{p}" for p in range(3)) + ")"
COL = lambda p: "(" + " + ".join(f"c_{t}{p}" for t in range(3)) + ")"
DIV = lambda a, b: f"({a})::DOUBLE / greatest({b}, 1)"
PIXEL_SCORES = f"""select *, 2 * obstacle_precision * obstacle_recall / greatest(obstacle_precision + obstacle_recall, 1e-12) as obstacle_f1,
  (iou_obstacle + iou_water + iou_sky) / 3 as mean_iou from (select stem,
  {DIV('c_00 + c_11 + c_22', ROW(0) + ' + ' + ROW(1) + ' + ' + ROW(2))} as pixel_accuracy, {DIV('c_00', COL(0))} as obstacle_precision,
  {DIV('c_00', ROW(0))} as obstacle_recall, {DIV('c_10 + c_20', ROW(1) + ' + ' + ROW(2))} as obstacle_pixel_fpr,
  {', '.join(DIV(f'c_{k}{k}', f'{ROW(k)} + {COL(k)} - c_{k}{k}') + f' as iou_{n}' for k, n in enumerate(lab.CLASS_NAMES))}
  from (select stem, {CM} from px group by stem))"""


@query(with_(fx.LABELLED) + "select target, pred, count(*) as n from px where target <> 4 group by all")
def confusion_cells(spark, d):
    return metrics.cell_counts(fx.labelled(spark, d))


@query(with_(fx.LABELLED) + PIXEL_SCORES, "pixel_accuracy obstacle_precision obstacle_recall obstacle_pixel_fpr iou_obstacle iou_water iou_sky obstacle_f1 mean_iou")
def pixel_scores_by_image(spark, d):
    return metrics.pixel_scores(metrics.confusion(fx.labelled(spark, d), "stem"), "stem")


@query(
    with_(fx.LABELLED, f"m as (select {CM} from px)")
    + "select *, 2 * precision * recall / greatest(precision + recall, 1e-12) as f1 from (select class, tp, fp, fn, tp / greatest(tp + fp + fn, 1) as iou, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from ("
    + " union all ".join(f"select '{n}' as class, c_{k}{k} as tp, {COL(k)} - c_{k}{k} as fp, {ROW(k)} - c_{k}{k} as fn from m" for k, n in enumerate(lab.CLASS_NAMES))
    + "))",
    "iou precision recall f1",
)
def class_scores(spark, d):
    return metrics.class_scores(metrics.confusion(fx.labelled(spark, d)))


@query(with_(fx.LABELLED) + "select stem, count(*) filter (where target = 0) as obstacle, count(*) filter (where target = 1) as water, count(*) filter (where target = 2) as sky from px group by stem")
def class_histograms(spark, d):
    return metrics.histograms(fx.labelled(spark, d))


@query(with_(fx.LABELLED) + "select target as label, count(distinct stem) as stems from px where target not in (0, 1, 2) group by target")
def labels_outside_whitelist(spark, d):
    return audit.unknown_labels(fx.labelled(spark, d).withColumnRenamed("target", "label"), (0, 1, 2))


@query(with_(fx.LOGITS) + "select stem, y, x, list_position(s, list_max(s)) - 1 as student_class, list_position(t, list_max(t)) - 1 as teacher_class from lg")
def argmax_classes(spark, d):
    return fx.logits(spark, d).select("stem", "y", "x", vectors.argmax(F.col("student")).alias("student_class"), vectors.argmax(F.col("teacher")).alias("teacher_class"))


@query(
    with_(fx.PIXELS) + "select rgb[1] as red, rgb[2] as green, rgb[3] as blue, count(*) as n from (select case target when 0 then [255, 210, 0] when 1 then [0, 210, 255] when 2 then [55, 70, 150] else [128, 128, 128] end as rgb from px) group by all"
)
def palette_counts(spark, d):
    rgb = fx.pixels(spark, d).select(lab.colour(F.col("target")).alias("c"))
    return rgb.groupBy(*[F.get("c", k).alias(n) for k, n in enumerate(("red", "green", "blue"))]).agg(F.count(F.lit(1)).alias("n"))


@query(
    with_(fx.PIXELS) + "select stem, avg((target / 255.0 - 0.485) / 0.229) as mean_value, count(*) as n from px group by stem", "mean_value n"
)
def normalised_values(spark, d):
    return fx.pixels(spark, d).groupBy("stem").agg(F.avg(normalise(F.col("target"), 0.485, 0.229)).alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n"))


# --- neighbourhoods and components --------------------------------------------------------------------------------

FRAME = lambda e, r: f"max({e}) over (partition by stem, y order by x range between {r} preceding and {r} following)"
FRAME_Y = lambda e, r: f"max({e}) over (partition by stem, x order by y range between {r} preceding and {r} following)"


def _boundary_ctes() -> tuple[list[str], str]:
    ctes = ["b0 as (select *, (target = 0)::INT as tm, (pred = 0)::INT as pm from px)"]
    ctes.append("b1 as (select *, " + ", ".join(f"{FRAME(e, 1)} as {n}" for e, n in (("tm", "td"), ("1 - tm", "te"), ("pm", "pd"), ("1 - pm", "pe"))) + " from b0)")
    ctes.append("b2 as (select *, " + ", ".join(f"{FRAME_Y(n, 1)} as {n}2" for n in ("td", "te", "pd", "pe")) + " from b1)")
    ctes.append("b3 as (select stem, y, x, (td2 * te2 * (target <> 4)::INT) as tb, (pd2 * pe2 * (target <> 4)::INT) as pb from b2)")
    ctes.append("b4 as (select *, " + ", ".join(f"{FRAME(e, r)} as {e}{r}" for e in ("tb", "pb") for r in lab.TOLERANCES) + " from b3)")
    ctes.append("b5 as (select *, " + ", ".join(f"{FRAME_Y(f'{e}{r}', r)} as {e}n{r}" for e in ("tb", "pb") for r in lab.TOLERANCES) + " from b4)")
    body = " union all ".join(f"select stem, {r} as tolerance, sum(pb) as predicted, sum(pb * tbn{r}) as tp_precision, sum(tb) as target, sum(tb * pbn{r}) as tp_recall from b5 group by stem" for r in lab.TOLERANCES)
    return ctes, f"select stem, tolerance, predicted::BIGINT as predicted, tp_precision::BIGINT as tp_precision, target::BIGINT as target, tp_recall::BIGINT as tp_recall from ({body})"


def _boundary_sql() -> str:
    ctes, body = _boundary_ctes()
    return with_(fx.PIXELS, *ctes) + body


@query(_boundary_sql())
def boundary_matches(spark, d):
    return morphology.boundary_counts(fx.pixels(spark, d))


@query(_boundary_sql())
def boundary_matches_dense(spark, d):
    return dense.boundary_counts(dense.mask_pairs(fx.pixels(spark, d)))


@query(
    "select " + ", ".join(f"2 * p{r} * r{r} / greatest(p{r} + r{r}, 1e-12) as boundary_f1_tol{r}" for r in lab.TOLERANCES) + " from (select "
    + ", ".join(f"sum(tp_precision) filter (tolerance = {r}) / greatest(sum(predicted) filter (tolerance = {r}), 1) as p{r}, sum(tp_recall) filter (tolerance = {r}) / greatest(sum(target) filter (tolerance = {r}), 1) as r{r}" for r in lab.TOLERANCES)
    + f" from ({_boundary_sql()}))",
    " ".join(f"boundary_f1_tol{r}" for r in lab.TOLERANCES),
)
def boundary_f1(spark, d):
    return metrics.boundary_scores(dense.boundary_counts(dense.mask_pairs(fx.pixels(spark, d))))


RUNS = lambda name, cond: f"""{name} as (select stem, y, min(x) as x0, max(x) as x1 from (select stem, y, x, x - row_number() over (partition by stem, y order by x) as g from px where {cond}) group by stem, y, g)"""


@query(with_(fx.PIXELS, RUNS("r", "target = 0")) + "select stem, y, x0, x1 from r")
def obstacle_runs(spark, d):
    return morphology.runs(fx.pixels(spark, d), F.col("target") == 0)


def _component_ctes(side: str, cond: str) -> list[str]:
    """Components by a recursive reach over touching runs; named by their first run."""
    return [
        RUNS(f"{side}r", cond),
        f"{side}e as (select a.stem, a.y as y, a.x0 as x0, b.y as y2, b.x0 as x2 from {side}r a join {side}r b on a.stem = b.stem and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and a.x1 >= b.x0 - 1)",
        f"{side}w as (select stem, y, x0, y as fy, x0 as fx from {side}r union select w.stem, e.y2, e.x2, w.fy, w.fx from {side}w w join {side}e e on e.stem = w.stem and e.y = w.y and e.x0 = w.x0)",
        f"{side}c as (select r.stem, r.y, r.x0, r.x1, f.c as component from {side}r r join (select stem, y, x0, min(fy::BIGINT * 4294967296 + fx) as c from {side}w group by all) f using (stem, y, x0))",
    ]


def _recursive(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


@query(_recursive(fx.PIXELS, *_component_ctes("t", "target = 0")) + "select stem, component, sum(x1 - x0 + 1)::BIGINT as area from tc group by stem, component")
def component_areas(spark, d):
    masks = components.to_masks(fx.pixels(spark, d), F.col("target"))
    return components.component_areas(components.mask_components(masks))


@query(SQL["component_areas"])
def component_areas_runs(spark, d):
    """The same by joins of runs, for pixels that are no whole images."""
    return components.component_areas(components.pixel_components(fx.pixels(spark, d), F.col("target") == 0))


@query(SQL["component_areas"])
def component_areas_dense(spark, d):
    return component_areas(spark, d)


@query(
    _recursive(fx.PIXELS, *_component_ctes("t", "target = 0"))
    + "select case when area <= 64 then 'tiny' when area <= 256 then 'very_small' when area <= 1024 then 'small' else 'medium_plus' end as bin, count(*) as components, sum(area)::BIGINT as pixels from (select sum(x1 - x0 + 1) as area from tc group by stem, component) group by 1"
)
def component_bins(spark, d):
    areas = components.component_areas(components.mask_components(components.to_masks(fx.pixels(spark, d), F.col("target"))))
    return areas.groupBy(lab.area_bin(F.col("area")).alias("bin")).agg(F.count(F.lit(1)).alias("components"), F.sum("area").alias("pixels"))


@query(
    _recursive(fx.PIXELS, *_component_ctes("t", "target = 0"), *_component_ctes("p", "pred = 0 and target <> 4"))
    + "select a.stem, a.component as gt, b.component as pred, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1)::BIGINT as inter from tc a join pc b on a.stem = b.stem and a.y = b.y and a.x0 <= b.x1 and b.x0 <= a.x1 group by all"
)
def component_overlaps(spark, d):
    return dense.mask_overlaps(dense.mask_pairs(fx.pixels(spark, d)))


@query(SQL["component_overlaps"])
def component_overlaps_runs(spark, d):
    """The same by joins of runs."""
    return components.overlaps(*components.component_tables(fx.pixels(spark, d)))


#: Three horizontal bars as targets and three upright ones as predictions: every target overlaps every prediction, in other shares in each picture.
BARS = """bar as (select s_suppkey::INT as stem, y::INT as y, x::INT as x, case when y % 8 < 2 + (s_suppkey * (y // 8 + 3) + y // 8) % 5 and x >= (s_suppkey * (y // 8)) % 4 and x < 32 - (s_suppkey + y // 8) % 6 then y // 8 end as t,
  case when x < 30 and x % 10 < 4 + (s_suppkey * (x // 10 + 2)) % 5 and y >= (s_suppkey * (x // 10)) % 3 and y < 24 - (s_suppkey + 2 * (x // 10)) % 5 then x // 10 end as p from supplier, range(24) a(y), range(32) b(x) where s_suppkey is not null),
ta as (select stem, t, count(*) as a from bar where t is not null group by all), pa as (select stem, p, count(*) as a from bar where p is not null group by all),
iou as (select i.stem, i.t, i.p, n / (ta.a + pa.a - n) as v from (select stem, t, p, count(*) as n from bar where t is not null and p is not null group by all) i join ta using (stem, t) join pa using (stem, p)),
total as (select a.stem, a.v + b.v + c.v as total from iou a join iou b on b.stem = a.stem and b.t = 1 and b.p <> a.p join iou c on c.stem = a.stem and c.t = 2 and c.p not in (a.p, b.p) where a.t = 0)"""


def _bars(spark, d) -> DataFrame:
    grid = fx.pixels(spark, d).select("stem", "y", "x", F.expr("y div 8").alias("i"), F.expr("x div 10").alias("j"))
    target = "y % 8 < 2 + (stem * (i + 3) + i) % 5 and x >= (stem * i) % 4 and x < 32 - (stem + i) % 6"
    pred = "x < 30 and x % 10 < 4 + (stem * (j + 2)) % 5 and y >= (stem * j) % 3 and y < 24 - (stem + 2 * j) % 5"
    return grid.selectExpr("stem", "y", "x", f"case when {target} then 0 else 1 end as target", f"case when {pred} then 0 else 1 end as pred")


ASSIGNED = with_(BARS) + "select stem, 3::BIGINT as pairs, max(total) as total from total group by stem"


def _assigned(found: DataFrame) -> DataFrame:
    """Pairs and their summed IoU; each component stands in one pair."""
    sums = found.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gt").alias("g"), F.count_distinct("pred").alias("p"), F.sum("iou").alias("total"))
    return sums.select("stem", F.when((F.col("g") == F.col("n")) & (F.col("p") == F.col("n")), F.col("n")).alias("pairs"), "total")


@query(ASSIGNED, "total")
def component_assignment(spark, d):
    """The assignment of highest summed IoU where every component overlaps every other side's; SQL tries all six."""
    gt, pred = components.component_tables(_bars(spark, d))
    return _assigned(components.match_components(components.overlaps(gt, pred), components.component_areas(gt), components.component_areas(pred)))


@query(ASSIGNED, "total")
def component_assignment_dense(spark, d):
    return _assigned(dense.mask_matches(dense.mask_pairs(_bars(spark, d))))


BIN = "case when area <= 64 then 'tiny' when area <= 256 then 'very_small' when area <= 1024 then 'small' else 'medium_plus' end"


def _outcome_ctes() -> list[str]:
    """Components with their fates. In these pictures every block of overlapping components has one component on a side, so that its best pair is the assignment."""
    return [
        *_component_ctes("t", "target = 0"), *_component_ctes("p", "pred = 0 and target <> 4"),
        "ta as (select stem, component, sum(x1 - x0 + 1)::BIGINT as area from tc group by all)", "pa as (select stem, component, sum(x1 - x0 + 1)::BIGINT as area from pc group by all)",
        "ov as (select a.stem, a.component as gt, b.component as pred, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1)::BIGINT as inter from tc a join pc b on a.stem = b.stem and a.y = b.y and a.x0 <= b.x1 and b.x0 <= a.x1 group by all)",
        "om as (select o.*, ta.area as ga, inter / greatest(ta.area + pa.area - inter, 1) as iou, count(*) over (partition by o.stem, o.pred) as dp from ov o join ta on ta.stem = o.stem and ta.component = o.gt join pa on pa.stem = o.stem and pa.component = o.pred)",
        "mt as (select stem, gt, pred from (select *, row_number() over (partition by stem, case when dp = 1 then gt else -1 - pred end order by iou desc, gt, pred) as n from om) where n = 1 and inter / greatest(ga, 1) >= 0.5)",
        f"oc as (select stem, side, component, area, {BIN} as bin, accepted, side = 'pred' and not accepted and area >= 16 as false_positive from ("
        "select ta.*, 'target' as side, mt.gt is not null as accepted from ta left join mt on mt.stem = ta.stem and mt.gt = ta.component union all select pa.*, 'pred', mt.pred is not null from pa left join mt on mt.stem = pa.stem and mt.pred = pa.component))",
    ]


OUTCOMES = _recursive(fx.PIXELS, *_outcome_ctes()) + "select stem, side, component, area, bin, accepted, false_positive from oc"


@query(OUTCOMES)
def component_outcomes(spark, d):
    return components.component_outcomes(fx.pixels(spark, d))


@query(OUTCOMES)
def component_outcomes_dense(spark, d):
    found = dense.mask_outcomes(dense.mask_pairs(fx.pixels(spark, d)))
    return found.withColumn("bin", lab.area_bin(F.col("area")))


BIN_NAMES = [name for name, _, _ in lab.AREA_BINS]
COMPONENT_SCORES = (
    "select i.k, images, " + ", ".join(f"coalesce(n_{b}, 0)::DOUBLE as component_count_{b}, coalesce(r_{b}, 0) / greatest(coalesce(n_{b}, 0), 1) as component_recall_{b}" for b in BIN_NAMES)
    + ", (coalesce(r_tiny, 0) + coalesce(r_very_small, 0) + coalesce(r_small, 0)) / greatest(coalesce(n_tiny, 0) + coalesce(n_very_small, 0) + coalesce(n_small, 0), 1) as small_component_recall"
    + ", 100 * coalesce(fp, 0) / greatest(images, 1) as false_positive_components_per_100_images from (select k, count(*) as images from own group by k) i left join (select k, count(*) filter (where false_positive) as fp, "
    + ", ".join(f"count(*) filter (where side = 'target' and bin = '{b}') as n_{b}, count(*) filter (where side = 'target' and accepted and bin = '{b}') as r_{b}" for b in BIN_NAMES)
    + " from oc join own using (stem) group by k) c on c.k = i.k"
)
COMPONENT_DOUBLES = " ".join(f"component_count_{b} component_recall_{b}" for b in BIN_NAMES) + " small_component_recall false_positive_components_per_100_images"
OWN = "own as (select distinct stem, k from px)"


def keyed_pixels(source: str) -> list[str]:
    """The pixel table under the name px0, and px as the given selection from it, with a key k."""
    return [fx.PIXELS.replace("px as (", "px0 as ("), f"px as ({source})"]


@query(_recursive(*keyed_pixels("select *, 0 as k from px0"), *_outcome_ctes(), OWN) + f"select * exclude (k) from ({COMPONENT_SCORES})", COMPONENT_DOUBLES)
def component_scores(spark, d):
    px = fx.pixels(spark, d)
    return metrics.component_scores(dense.mask_outcomes(dense.mask_pairs(px)).withColumn("bin", lab.area_bin(F.col("area"))), px.select("stem").distinct())


@query(
    with_(fx.PIXELS) + "select stem, coalesce(avg(abs(p - t)), 0) as water_edge_mae_px, sqrt(coalesce(avg((p - t) * (p - t)), 0)) as water_edge_rmse_px from (select stem, x, min(y) filter (where target = 1) as t, min(y) filter (where pred = 1) as p from px group by stem, x) group by stem",
    "water_edge_mae_px water_edge_rmse_px",
)
def water_edge(spark, d):
    return metrics.water_edge(fx.pixels(spark, d), "stem")


def report_sql(source: str, key: str | None = None) -> tuple[str, str]:
    """SQL of the whole metric report, and its doubles: over a selection from px0 with a key k, which is left out or named."""
    ctes, body = _boundary_ctes()
    score = lambda r: f"2 * p{r} * r{r} / greatest(p{r} + r{r}, 1e-12) as boundary_f1_tol{r}"
    part = lambda a, b, r: f"sum({a}) filter (tolerance = {r}) / greatest(sum({b}) filter (tolerance = {r}), 1)"
    parts = [
        *keyed_pixels(source), OWN, *_outcome_ctes(), *ctes,
        f"ps as ({PIXEL_SCORES.replace('stem', 'k')})",
        f"bf as (select k, {', '.join(map(score, lab.TOLERANCES))} from (select k, " + ", ".join(f"{part('tp_precision', 'predicted', r)} as p{r}, {part('tp_recall', 'target', r)} as r{r}" for r in lab.TOLERANCES) + f" from ({body}) b join own using (stem) group by k))",
        f"cs as ({COMPONENT_SCORES})",
        "we as (select k, coalesce(avg(abs(p - t)), 0) as water_edge_mae_px, sqrt(coalesce(avg((p - t) * (p - t)), 0)) as water_edge_rmse_px from (select k, stem, x, min(y) filter (where target = 1) as t, min(y) filter (where pred = 1) as p from px group by all) group by k)",
    ]
    score_of = "0.4 * obstacle_f1 + 0.3 * small_component_recall + 0.2 * boundary_f1_tol3 + 0.1 * (1 - obstacle_pixel_fpr)"
    out = f"select * exclude (k){f', k as {key}' if key else ''}, boundary_f1_tol3 as boundary_f1, {score_of} as safety_score from ps join bf using (k) join cs using (k) join we using (k)"
    doubles = "pixel_accuracy mean_iou obstacle_precision obstacle_recall obstacle_f1 obstacle_pixel_fpr iou_obstacle iou_water iou_sky water_edge_mae_px water_edge_rmse_px boundary_f1 safety_score "
    return _recursive(*parts) + out, doubles + COMPONENT_DOUBLES + " " + " ".join(f"boundary_f1_tol{r}" for r in lab.TOLERANCES)


@query(*report_sql("select *, 0 as k from px0"))
def metric_report(spark, d):
    return dense.report_masks(dense.mask_pairs(fx.pixels(spark, d)))


@query(*report_sql("select *, 0 as k from px0"))
def metric_report_windows(spark, d):
    """The report by windows and joins over pixel rows, for pixels that are no whole images."""
    return metrics.report(fx.pixels(spark, d))


@query(*report_sql("select px0.*, s_nationkey as k from px0 join supplier on s_suppkey = stem", "nation"))
def metric_report_by_nation(spark, d):
    nation = fx.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("stem"), F.col("s_nationkey").alias("nation"))
    return dense.report_masks(dense.mask_pairs(fx.pixels(spark, d)).join(nation, "stem"), "nation")


@query(with_(fx.PIXELS) + f"select g.stem, g.y, g.x, px.target from (select s_suppkey::INT as stem, y::INT as y, x::INT as x from supplier, range(12) a(y), range(20) b(x)) g join px on px.stem = g.stem and px.y = least(floor((g.y + 0.5) * 24 / 12), 23) and px.x = least(floor((g.x + 0.5) * 32 / 20), 31)")
def nearest_resize(spark, d):
    px = fx.pixels(spark, d).select("stem", "y", "x", "target")
    sizes = px.select("stem").distinct().select("stem", F.lit(fx.HEIGHT).alias("height"), F.lit(fx.WIDTH).alias("width"))
    return resize_pixels(px, sizes, 12, 20)


# --- losses -------------------------------------------------------------------------------------------------------

LSE = lambda v, t="1.0": f"ln(list_sum(list_transform({v}, lambda z: exp(z / {t}))))"
CE = f"({LSE('s')} - s[target + 1])"
KL = lambda t: f"list_sum(list_transform([1, 2, 3], lambda k: exp(t[k] / {t} - {LSE('t', t)}) * ((t[k] / {t} - {LSE('t', t)}) - (s[k] / {t} - {LSE('s', t)}))))"


def _loss_sql() -> str:
    ctes = [
        f"l0 as (select *, (target <> 4)::INT as ok, (target = 0)::INT as o, case when target <> 4 then {CE} end as ce, case when target <> 4 then {KL('4.0')} end as kl from lg)",
        f"l1 as (select *, {FRAME('o', 3)} as d1, {FRAME('1 - o', 3)} as e1, least(sqrt(greatest(sum(ok) over (partition by stem), 1) / greatest(sum(o) over (partition by stem), 1)), 8.0) as iw from l0)",
        f"l2 as (select *, {FRAME_Y('d1', 3)} as d2, {FRAME_Y('e1', 3)} as e2 from l1)",
    ]
    return with_(fx.LOGITS, *ctes) + """select cross_entropy, boundary_band_ce, sparse_obstacle, kd, boundary_band_ce as segmentation, boundary_band_ce + 0.5 * kd + 0.25 * sparse_obstacle as total from (
  select sum(ce) / sum(ok) as cross_entropy, sum(ce * (1 + d2 * e2)) / sum(ok * (1 + d2 * e2)) as boundary_band_ce,
  sum(ce * case when target = 0 then iw else 1 end) / sum(ok) as sparse_obstacle, 16.0 * sum(kl) / sum(ok) as kd from l2)"""


@query(_loss_sql(), "cross_entropy boundary_band_ce sparse_obstacle kd segmentation total")
def loss_terms(spark, d):
    return losses.objective(fx.logits(spark, d), boundary_weight=1.0, sparse_weight=0.25, kd_weight=0.5)


@query(with_(fx.LOGITS) + f"select sum(ce) / count(ce) as cross_entropy from (select {CE} as ce from lg where target <> 4)", "cross_entropy")
def cross_entropy(spark, d):
    return losses.objective(fx.logits(spark, d)).select("cross_entropy")


@query(with_(fx.LOGITS) + f"select stem, max(exp(s[1] - {LSE('s')})) as top_obstacle, avg({KL('1.0')}) as mean_kl from lg group by stem", "top_obstacle mean_kl")
def softmax_kl(spark, d):
    s = F.col("student")
    return fx.logits(spark, d).groupBy("stem").agg(F.max(F.get(vectors.softmax(s), 0)).alias("top_obstacle"), F.avg(vectors.kl(F.col("teacher"), s, 1.0)).alias("mean_kl"))


@query(with_(fx.LOGITS) + "select max(list_max(list_transform([1, 2, 3], lambda k: abs(s[k] - t[k])))) as max_error, avg((list_position(s, list_max(s)) = list_position(t, list_max(t)))::INT) as agreement, max(list_max(list_transform([1, 2, 3], lambda k: abs(s[k] - t[k])))) <= 0.0001 and avg((list_position(s, list_max(s)) = list_position(t, list_max(t)))::INT) >= 0.9999 as passed from lg", "max_error agreement")
def logit_parity(spark, d):
    return experiments.parity(fx.logits(spark, d))


@query(
    with_(fx.PIXELS) + ", s as (select count(*) filter (where target = 0)::DOUBLE as obstacle, count(*) filter (where target = 1)::DOUBLE as water, count(*) filter (where target = 2)::DOUBLE as sky from px)"
    + " select class, 1 / sqrt(n) / m as weight from (select unnest(['obstacle', 'water', 'sky']) as class, unnest([obstacle, water, sky]) as n, (obstacle / sqrt(obstacle) + water / sqrt(water) + sky / sqrt(sky)) / (obstacle + water + sky) as m from s)",
    "weight",
)
def class_weights(spark, d):
    return losses.class_weights(metrics.histograms(fx.pixels(spark, d)))


def _region_sql() -> str:
    ctes = [
        "px as (select stem, y, x, target, pred from lg)", *_component_ctes("t", "target = 0"),
        "sm as (select c.stem, c.y, c.x0, c.x1 from tc c join (select stem, component from tc group by all having sum(x1 - x0 + 1) <= 1024) using (stem, component))",
        f"w0 as (select *, (target = 0)::INT as o, {FRAME('(target = 0)::INT', 3)} as d1, {FRAME('(target <> 0)::INT', 3)} as e1 from lg)",
        f"w1 as (select *, {FRAME_Y('d1', 3)} as d2, {FRAME_Y('e1', 3)} as e2 from w0)",
        f"w2 as (select w1.*, {KL('4.0')} as kl, (sm.stem is not null)::INT as small, least(greatest((list_max(list_transform(t, lambda z: exp(z))) / list_sum(list_transform(t, lambda z: exp(z))) - 0.5) / 0.5, 0), 1) as sure, "
        "(list_position(t, list_max(t)) <> list_position(s, list_max(s)))::INT as apart from w1 left join sm on sm.stem = w1.stem and sm.y = w1.y and w1.x between sm.x0 and sm.x1 where target <> 4)",
        "w3 as (select kl, least(greatest((1 + o + 2 * small + d2 * e2 + apart) * (0.25 + 0.75 * sure), 0.25), 6) as w from w2)",
    ]
    return _recursive(fx.LOGITS.replace("px as (", "px1 as (").replace("from px)", "from px1)"), *ctes) + "select sum(w * kl) / sum(w) as region_kd from w3"


@query(_region_sql(), "region_kd")
def region_weighted_kd(spark, d):
    px = fx.logits(spark, d)
    found = cut(components.pixel_components(px, F.col("target") == 0), "runs")
    small = found.join(components.component_areas(found).filter("area <= 1024").hint("merge"), ["stem", "component"]).select("stem", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return losses.weighted_kd(losses.region_weights(px, small))


# --- near duplicates, groups, splits ------------------------------------------------------------------------------


@query(with_(fx.HASHES) + "select stem, hi, lo from hashes")
def block_hashes(spark, d):
    return fx.hashes(spark, d).select("stem", F.shiftright("h", 32).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hi"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))


DIST = "(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))"
NEAR_PAIRS = f"select a.stem as src, b.stem as dst, {DIST}::INT as distance from near a join near b on a.stem < b.stem and {DIST} <= 6"


@query(with_(fx.NEAR) + NEAR_PAIRS)
def hamming_join(spark, d):
    return neardup.hamming_pairs(fx.near_hashes(spark, d), 6)


@query(
    "with recursive " + fx.NEAR + f""", ed as (select a.stem as src, b.stem as dst from near a join near b on a.stem <> b.stem and {DIST} <= 6),
    rc as (select stem, stem as node from near union select r.stem, e.dst from rc r join ed e on e.src = r.node)
    select node as stem, min(stem) as group_id from rc group by node"""
)
def hash_groups(spark, d):
    """Groups of near hashes, copies linked to one of them."""
    near = fx.near_hashes(spark, d)
    return graph.group_members(neardup.hamming_edges(near, 6), near)


@query(with_(fx.HASHES) + f"select a.stem as src, b.stem as dst, {DIST}::INT as distance from hashes a join hashes b on a.stem < b.stem and {DIST} <= 17")
def hamming_join_far(spark, d):
    return neardup.hamming_pairs(fx.hashes(spark, d), 17)


CLASSES = "cls as (select hi, lo, min(stem) as class_id from near group by hi, lo)"


@query(with_(fx.NEAR, CLASSES) + "select stem, class_id from near join cls using (hi, lo)")
def hash_classes(spark, d):
    return neardup.hash_classes(fx.near_hashes(spark, d)).select("stem", "class_id")


@query(with_(fx.NEAR, CLASSES) + f"select least(a.class_id, b.class_id) as a_class, greatest(a.class_id, b.class_id) as b_class, {DIST}::INT as distance from cls a join cls b on a.class_id < b.class_id and {DIST} <= 10")
def hash_class_pairs(spark, d):
    """Near classes of equal hashes within ten bits, which are probed for."""
    return neardup.class_pairs(fx.near_hashes(spark, d), 10)


COS = "list_cosine_similarity(a.v, b.v)"
VEC = "vec as (select vec_id as stem, embedding::DOUBLE[] as v from embeddings)"
PAIRS = f"pairs as (select a.stem as src, b.stem as dst, {COS} as cosine from vec a join vec b on a.stem < b.stem where {COS} >= 0.4)"


@query(with_(VEC, PAIRS) + "select src, dst, cosine from pairs", "cosine")
def cosine_join(spark, d):
    return neardup.cosine_pairs(fx.vectors(spark, d), 0.4)


@query(with_(VEC, PAIRS) + "select count(*) as pairs, true as enough from pairs")
def cosine_join_lsh_recall(spark, d):
    """The approximate join finds nine tenths of the exact one's pairs at least."""
    v = fx.vectors(spark, d)
    found = neardup.recall_of(neardup.cosine_pairs_lsh(v, 0.4), neardup.cosine_pairs(v, 0.4))
    return found.select("pairs", (F.col("recall") >= 0.9).alias("enough"))


EDGES = "both_ways as (select src, dst from pairs union all select dst, src from pairs)"
REACH = "reach as (select stem, stem as node from vec union select r.stem, e.dst from reach r join both_ways e on e.src = r.node)"
MEMBERS = "members as (select node as stem, min(stem) as group_id from reach group by node)"
GROUPED = _recursive(VEC, PAIRS, EDGES, REACH, MEMBERS)


def _members(spark, d) -> DataFrame:
    return cut(graph.group_members(graph.thinned(neardup.cosine_pairs(fx.vectors(spark, d), 0.4)), fx.vectors(spark, d)), "members")


@query(GROUPED + "select stem, group_id from members")
def duplicate_groups(spark, d):
    return _members(spark, d)


@query(GROUPED + "select group_id, count(*) as size, list_aggregate(list(stem order by stem), 'min') as first_member, sum(stem)::BIGINT as id_sum from members group by group_id")
def group_lists(spark, d):
    members = _members(spark, d)
    sums = members.groupBy("group_id").agg(F.sum("stem").alias("id_sum"))
    return graph.groups(members).join(sums, "group_id").select("group_id", "size", F.col("first").alias("first_member"), "id_sum")


EMB_SPLIT = "es as (select distinct vec_id as stem from embeddings),\n" + fx.split_sql("es").replace("'42:' || stem", "'42:' || cast(stem as varchar)")


def _emb_split(spark, d) -> DataFrame:
    return cut(splits.random_split(fx.vectors(spark, d)), "split")


@query(with_(fx.SPLIT) + "select stem, split from split")
def random_split(spark, d):
    return fx.split(spark, d)


@query(with_(fx.SPLIT) + "select split, count(*) as stems, min(stem) as first_stem from split group by split")
def split_sizes(spark, d):
    return fx.split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("stems"), F.min("stem").alias("first_stem"))


def _fold_ctes() -> list[str]:
    """Groups in order of size, one recursive step each, to the split where fill, class error and overflow are least; the counts of a size are dealt evenly over its groups by mix and digest."""
    ratios, mix = (0.7, 0.15, 0.15), ("obstacle", "water", "sky")
    error = lambda k, r: " + ".join(f"((s{k}{c} + o.m{c} - t.c{c} * {r}) / (t.c{c} * {r})) * ((s{k}{c} + o.m{c} - t.c{c} * {r}) / (t.c{c} * {r}))" for c in range(3))
    score = lambda k, r: f"(n{k} + o.size) / greatest({r} * t.total, 1) + 0.02 * (({error(k, r)}) / 3) + 5.0 * greatest(n{k} + o.size - {r} * t.total, 0) / greatest({r} * t.total, 1)"
    state = [f"n{k}" for k in range(3)] + [f"s{k}{c}" for k in range(3) for c in range(3)]
    chosen = "case when a0 <= a1 and a0 <= a2 then 0 when a1 <= a2 then 1 else 2 end"
    return [
        fx.MIX,
        f"gs as (select group_id, count(*) as size, {', '.join(f'coalesce(sum({m}), 0)::DOUBLE as m{c}' for c, m in enumerate(mix))}, sha256('42:' || cast(group_id as varchar)) as tie from members left join mix using (stem) group by group_id)",
        "gc as (select *, case when m0 + m1 + m2 > 0 then floor(m0 * 10 / (m0 + m1 + m2)) * 11 + floor(m1 * 10 / (m0 + m1 + m2)) else 0 end as cell from gs)",
        f"go as (select group_id, size, row_number() over (order by size desc, group_id) as n, row_number() over (partition by size order by cell, tie, group_id) - 1 as p, count(*) over (partition by size) as c, {', '.join(f'avg(m{c}) over (partition by size) as m{c}' for c in range(3))} from gc)",
        f"gt as (select sum(size)::DOUBLE as total, {', '.join(f'greatest(sum(m{c}), 1)::DOUBLE as c{c}' for c in range(3))} from gs)",
        f"gf as (select 0::BIGINT as n, null::BIGINT as size, -1 as k, {', '.join(f'0::DOUBLE as {x}' for x in state)} union all select n, size, k, {', '.join([f'n{j} + case when k = {j} then size else 0 end' for j in range(3)] + [f's{j}{c} + case when k = {j} then m{c} else 0 end' for j in range(3) for c in range(3)])} from ("
        f"select *, {chosen} as k from (select o.n, o.size, o.m0, o.m1, o.m2, {', '.join('f.' + x for x in state)}, {', '.join(f'round({score(k, r)}, 9) as a{k}' for k, r in enumerate(ratios))} from gf f join go o on o.n = f.n + 1, gt t)))",
        "gq as (select size, count(*) filter (where k = 0) as q0, count(*) filter (where k = 1) as q1 from gf where k >= 0 group by size)",
        "gd as (select group_id, (p + 1) * q0 // c > p * q0 // c as t, p - p * q0 // c as r, greatest(c - q0, 1) as d, q1 from go join gq using (size))",
        "gsplit as (select m.stem, case when t then 'train' when (r + 1) * q1 // d > r * q1 // d then 'val' else 'test' end as split from members m join gd using (group_id))",
    ]


GROUPED_SPLIT = GROUPED.rstrip() + ",\n" + ",\n".join(_fold_ctes()) + "\n"


@query(GROUPED_SPLIT + "select stem, split from gsplit")
def grouped_split(spark, d):
    return splits.grouped_split(_members(spark, d), fx.class_mix(spark, d))


@query(
    GROUPED_SPLIT + """select b.split, obstacle, water, sky, obstacle / greatest(obstacle + water + sky, 1) as obstacle_ratio, water / greatest(obstacle + water + sky, 1) as water_ratio, sky / greatest(obstacle + water + sky, 1) as sky_ratio,
    groups, min_size, max_size, mean_size, (select count(*) from (select group_id from members join gsplit using (stem) group by group_id having count(distinct split) > 1)) as impure_groups
    from (select split, sum(obstacle)::BIGINT as obstacle, sum(water)::BIGINT as water, sum(sky)::BIGINT as sky from mix join gsplit using (stem) group by split) b
    join (select split, count(*) as groups, min(size) as min_size, max(size) as max_size, avg(size) as mean_size from (select split, group_id, count(*) as size from members join gsplit using (stem) group by all) group by split) g on g.split = b.split""",
    "obstacle_ratio water_ratio sky_ratio mean_size",
)
def grouped_split_report(spark, d):
    members, mix = _members(spark, d), fx.class_mix(spark, d)
    split = cut(splits.grouped_split(members, mix), "split")
    impure = splits.impure_groups(members, split).agg(F.count(F.lit(1)).alias("impure_groups")).withColumn("k", F.lit(1))
    out = audit.class_balance(mix, split).join(audit.group_sizes(members, split), "split").withColumn("k", F.lit(1))
    return out.join(F.broadcast(impure), "k").drop("k")  # one row


@query(
    GROUPED.rstrip() + ",\n" + EMB_SPLIT + "\nselect group_id, count(distinct split) as splits from members join split using (stem) group by group_id having count(distinct split) > 1"
)
def impure_groups(spark, d):
    return splits.impure_groups(_members(spark, d), _emb_split(spark, d))


@query(
    GROUPED.rstrip() + ",\n" + EMB_SPLIT + "\nselect split, count(*) as groups, min(size) as min_size, max(size) as max_size, avg(size) as mean_size from (select split, group_id, count(*) as size from members join split using (stem) group by all) group by split",
    "mean_size",
)
def group_sizes(spark, d):
    return audit.group_sizes(_members(spark, d), _emb_split(spark, d))


@query(GROUPED.rstrip() + ",\n" + EMB_SPLIT + "\nselect group_id, count(*) as size, min(split) as split from members join split using (stem) group by group_id order by size desc, group_id limit 1")
def largest_group(spark, d):
    return audit.largest_group(_members(spark, d), _emb_split(spark, d))


@query(with_(VEC, PAIRS, EMB_SPLIT) + "select p.src, p.dst, p.cosine, a.split as left_split, b.split as right_split from pairs p join split a on a.stem = p.src join split b on b.stem = p.dst where a.split <> b.split", "cosine")
def leakage_pairs(spark, d):
    return neardup.across_splits(neardup.cosine_pairs(fx.vectors(spark, d), 0.4), _emb_split(spark, d)).select("src", "dst", "cosine", "left_split", "right_split")


@query(
    with_(VEC, EMB_SPLIT) + f"select a.stem as src, b.stem as dst, {COS} as cosine, sa.split as left_split, sb.split as right_split from vec a join vec b on a.stem < b.stem join split sa on sa.stem = a.stem join split sb on sb.stem = b.stem where sa.split <> sb.split order by cosine desc, src desc, dst desc limit 20",
    "cosine",
)
def top_leakage_pairs(spark, d):
    return neardup.top_across_splits(fx.vectors(spark, d), _emb_split(spark, d))


@query(
    with_(VEC, fx.HASHES, EMB_SPLIT) + f""", allp as (select {DIST} as dist, list_cosine_similarity(va.v, vb.v) as cosine from hashes a join hashes b on a.stem < b.stem join split sa on sa.stem = a.stem join split sb on sb.stem = b.stem and sa.split <> sb.split
  join vec va on va.stem = a.stem join vec vb on vb.stem = b.stem)
  select count(*) filter (where dist <= 17) as cross_split_phash_violations, coalesce(min(dist), 64)::INT as minimum_cross_split_phash_distance, count(*) filter (where cosine >= 0.4) as cross_split_embedding_violations, coalesce(max(cosine), -1) as maximum_cross_split_cosine from allp""",
    "maximum_cross_split_cosine",
)
def cross_split_extremes(spark, d):
    return neardup.cross_split_extremes(fx.hashes(spark, d), fx.vectors(spark, d), _emb_split(spark, d), 17, 0.4)


@query(
    _recursive(VEC, PAIRS, fx.HASHES, f"hp as (select a.stem as src, b.stem as dst from hashes a join hashes b on a.stem < b.stem and {DIST} <= 17)", "both_ways as (select src, dst from pairs union all select dst, src from pairs union all select src, dst from hp union all select dst, src from hp)", REACH, MEMBERS)
    + "select sum(n)::BIGINT as images, count(*) as groups, count(*) filter (where n > 1) as multi_image_groups, max(n) as largest_group, (select count(*) from hp) as phash_edges, (select count(*) from pairs) as embedding_edges from (select count(*) as n from members group by group_id)"
)
def dataset_summary(spark, d):
    edges = cut(neardup.union_edges(neardup.hamming_pairs(fx.hashes(spark, d), 17), neardup.cosine_pairs(fx.vectors(spark, d), 0.4)), "edges")
    return audit.dataset_summary(graph.group_members(graph.thinned(edges), fx.vectors(spark, d)), edges)


@query(with_(fx.MIX, EMB_SPLIT) + "select split, o as obstacle, w as water, s as sky, o / greatest(o + w + s, 1) as obstacle_ratio, w / greatest(o + w + s, 1) as water_ratio, s / greatest(o + w + s, 1) as sky_ratio from (select split, sum(obstacle)::BIGINT as o, sum(water)::BIGINT as w, sum(sky)::BIGINT as s from mix join split using (stem) group by split)", "obstacle_ratio water_ratio sky_ratio")
def class_balance(spark, d):
    return audit.class_balance(fx.class_mix(spark, d), _emb_split(spark, d))


@query(with_(fx.SPLIT) + "select stem, lang, coalesce(split, 'none') as split from stems left join split using (stem)")
def owner_lookup(spark, d):
    return audit.owners(fx.stems(spark, d).select("stem", "lang"), fx.split(spark, d)).select("stem", "lang", F.coalesce("split", F.lit("none")).alias("split"))


@query(with_(fx.SPLIT) + "select stem, lang from stems where stem in (select stem from split where split = 'val')")
def validation_rows(spark, d):
    return splits.in_split(fx.stems(spark, d).select("stem", "lang"), fx.split(spark, d), "val")


LISTED = "listed as (select stem, split from split where split <> 'test' union all select lpad(cast(page_id * 3 as varchar), 6, '0'), 'val' from pages)"


def _listed(spark, d) -> DataFrame:
    """Split lists with overlaps, doubles and stems that the corpus lacks."""
    extra = fx.table(spark, d, "pages").select(F.lpad((F.col("page_id") * 3).cast("string"), 6, "0").alias("stem"), F.lit("val").alias("split"))
    return fx.split(spark, d).filter("split <> 'test'").unionByName(extra)


@query(with_(fx.SPLIT, LISTED) + "select stem, list_aggregate(list(distinct split order by split), 'string_agg', ',') as splits from listed group by stem having count(distinct split) > 1")
def split_overlaps(spark, d):
    return audit.split_overlaps(_listed(spark, d)).select("stem", F.array_join("splits", ",").alias("splits"))


@query(with_(fx.SPLIT, LISTED) + "select stem from listed where split = 'train' intersect select stem from listed where split = 'val'")
def train_val_overlap(spark, d):
    return audit.pairwise_overlap(_listed(spark, d), "train", "val")


@query(with_(fx.SPLIT, LISTED) + "select split, stem, count(*) as times from listed group by all having count(*) > 1")
def duplicate_stems(spark, d):
    return splits.duplicate_stems(_listed(spark, d))


@query(with_(fx.SPLIT, LISTED) + "select stem, 'missing' as problem from (select stem from stems except select stem from listed) union all select stem, 'extra' from (select stem from listed except select stem from stems)")
def missing_and_extra(spark, d):
    return audit.missing_and_extra(fx.stems(spark, d), _listed(spark, d))


@query(f"select problem, count(*) as n, list_aggregate((list(stem order by stem))[1:10], 'string_agg', ',') as examples from ({SQL['missing_and_extra']}) group by problem")
def problem_samples(spark, d):
    return audit.problem_samples(missing_and_extra(spark, d)).select("problem", "n", F.array_join("examples", ",").alias("examples"))


@query(with_(fx.SPLIT) + "select split, (n_chars % 7 + 1) * 64 || 'x' || (n_chars % 5 + 1) * 48 as size, count(*) as n from stems join split using (stem) group by all")
def image_size_histogram(spark, d):
    sized = fx.stems(spark, d).select("stem", ((F.col("n_chars") % 7 + 1) * 64).alias("width"), ((F.col("n_chars") % 5 + 1) * 48).alias("height"))
    return audit.size_histogram(sized, fx.split(spark, d)).select("split", F.explode("image_sizes").alias("size", "n"))


def _balance_sql() -> str:
    ids = fx.split_sql("ids").replace("'42:' || stem", "'42:' || cast(stem as varchar)")
    ctes = [*_component_ctes("t", "target = 0"), "ids as (select distinct stem from px)", ids,
        "h as (select split, count(distinct stem) as images, count(*) filter (where target = 0) as obstacle, count(*) filter (where target = 1) as water, count(*) filter (where target = 2) as sky from px join split using (stem) group by split)",
        "g as (select split, count(*) as groups, min(size) as min_size, max(size) as max_size, avg(size) as mean_size from (select split, stem % 37 as group_id, count(*) as size from split group by all) group by split)",
        f"c as (select split, {', '.join(f'count(*) filter (where bin = {chr(39)}{b}{chr(39)}) as {b}' for b in BIN_NAMES)} from (select stem, {BIN} as bin from (select stem, component, sum(x1 - x0 + 1) as area from tc group by all)) join split using (stem) group by split)",
    ]
    share = ", ".join(f"{c} / greatest(obstacle + water + sky, 1) as {c}_ratio" for c in lab.CLASS_NAMES)
    return _recursive(fx.PIXELS, *ctes) + f"select split, images, groups, min_size, max_size, mean_size, obstacle, water, sky, {share}, {', '.join(BIN_NAMES)}, images as n_32x24 from h join g using (split) left join c using (split)"


@query(_balance_sql(), "mean_size obstacle_ratio water_ratio sky_ratio")
def balance_report(spark, d):
    px = fx.pixels(spark, d)
    ids = px.select("stem").distinct()
    split = cut(splits.random_split(ids), "split")
    found = components.component_areas(components.mask_components(components.to_masks(px, F.col("target"))))
    sizes = ids.select("stem", F.lit(fx.WIDTH).alias("width"), F.lit(fx.HEIGHT).alias("height"))
    report = audit.balance_report(metrics.histograms(px), ids.select("stem", (F.col("stem") % 37).alias("group_id")), sizes, found, split)
    return report.select("split", "images", "group_sizes.*", "class_pixels.*", "class_ratios.*", "component_count.*", F.col("image_sizes")["32x24"].alias("n_32x24"))


# --- provenance ---------------------------------------------------------------------------------------------------

PAIRED = "paired as (select lpad(cast(p.page_id as varchar), 6, '0') as stem, sha256(p.html) as image_sha256, sha256(t.text) as mask_sha256 from pages p join documents t on t.doc_id = p.page_id)"


def _paired(spark, d) -> DataFrame:
    p = fx.table(spark, d, "pages").select(F.col("page_id").alias("i"), F.sha2("html", 256).alias("image_sha256"))
    t = fx.table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("mask_sha256"))
    return p.join(t, "i").select(F.lpad(F.col("i").cast("string"), 6, "0").alias("stem"), "image_sha256", "mask_sha256")


@query("select page_id, sha256(html) as sha256 from pages")
def file_digests(spark, d):
    return provenance.file_digests(fx.table(spark, d, "pages").select("page_id", "html"), "html")


@query(with_(fx.SPLIT) + "select split, sha256(string_agg(stem, chr(10) order by stem) || chr(10)) as sha256 from split group by split")
def split_digests(spark, d):
    return provenance.split_digests(fx.split(spark, d).select("split", F.concat(F.lit("  "), "stem", F.lit("\r")).alias("line")))


@query(with_(PAIRED) + "select sha256(string_agg(stem || chr(0) || 'image' || chr(0) || image_sha256 || chr(0) || 'mask' || chr(0) || mask_sha256 || chr(10), '' order by stem)) as sha256 from paired")
def manifest_digest(spark, d):
    return provenance.manifest_digest(_paired(spark, d))


@query(
    with_(PAIRED) + """select sha256(string_agg(part || ':' || d, chr(10) order by part)) as merkle_sha256 from (select part, sha256(string_agg(line, '' order by stem)) as d from (
    select stem, ('0x' || sha256(stem)[1:8])::BIGINT % 64 as part, stem || chr(0) || 'image' || chr(0) || image_sha256 || chr(0) || 'mask' || chr(0) || mask_sha256 || chr(10) as line from paired) group by part)"""
)
def merkle_digest(spark, d):
    return provenance.merkle_digest(_paired(spark, d), 64)


@query(
    with_(PAIRED, "cur as (select stem as name, image_sha256 as sha256 from paired)", "reg as (select stem as name, case when stem like '%7' then 'x' else image_sha256 end as sha256 from paired where stem not like '%3' union all select 'gone', 'y')")
    + "select coalesce(cur.name, reg.name) as name, case when cur.sha256 is null then 'missing' when reg.sha256 is null then 'unregistered' when cur.sha256 = reg.sha256 then 'match' else 'mismatch' end as status from cur full outer join reg using (name)"
)
def registration_check(spark, d):
    cur = _paired(spark, d).select(F.col("stem").alias("name"), F.col("image_sha256").alias("sha256"))
    reg = cur.filter(~F.col("name").endswith("3")).withColumn("sha256", F.when(F.col("name").endswith("7"), "x").otherwise(F.col("sha256")))
    gone = spark.createDataFrame([("gone", "y")], "name string, sha256 string")
    return provenance.registration(cur, reg.unionByName(gone)).select("name", "status")


@query(with_(fx.STEMS) + "select stem, sha256(lang) as sha256, sha256('en') as expected from stems where lang is distinct from 'en'")
def artifact_gate(spark, d):
    files = fx.stems(spark, d).select(F.col("stem").alias("name"), F.sha2("lang", 256).alias("sha256"))
    expected = files.select("name", F.sha2(F.lit("en"), 256).alias("sha256"))
    return provenance.artifact_gate(files, expected).withColumnRenamed("name", "stem")


@query("select page_id, regexp_extract(url, '[^/]*$') as name, case when regexp_matches(regexp_extract(url, '[^/]*$'), '^.+\\.[^.]+$') then regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\\.[^.]+)$', 1) else '' end as ext from pages")
def path_parts(spark, d):
    url = F.col("url")
    return fx.table(spark, d, "pages").select("page_id", paths.file_name(url).alias("name"), paths.suffix(url).alias("ext"))


# --- runs ---------------------------------------------------------------------------------------------------------

PATIENCE, DELTA = 12, 0.01
FOLD = f"""fold as (select run_id, 0 as epoch, -1.0::DOUBLE as best, null::INT as best_epoch, 0 as stale, null::INT as stop_epoch from hist where epoch = 1
  union all select f.run_id, h.epoch, case when f.stop_epoch is null and h.safety_score > f.best + {DELTA} then h.safety_score else f.best end,
  case when f.stop_epoch is null and h.safety_score > f.best + {DELTA} then h.epoch else f.best_epoch end,
  case when f.stop_epoch is not null then f.stale when h.safety_score > f.best + {DELTA} then 0 else f.stale + 1 end,
  case when f.stop_epoch is not null then f.stop_epoch when not (h.safety_score > f.best + {DELTA}) and f.stale + 1 >= {PATIENCE} then h.epoch end
  from fold f join hist h on h.run_id = f.run_id and h.epoch = f.epoch + 1),
last as (select f.*, row_number() over (partition by run_id order by epoch desc) as n from fold f)"""
STOPPED = _recursive(fx.HISTORY, FOLD)


@query(STOPPED + "select run_id, best_epoch, best as best_score, stale, stop_epoch, epoch as epochs from last where n = 1", "best_score")
def early_stopping(spark, d):
    return experiments.stopping(fx.history(spark, d), PATIENCE, DELTA)


@query(STOPPED + "select h.run_id, h.epoch, h.safety_score from last l join hist h on h.run_id = l.run_id and h.epoch = l.best_epoch where l.n = 1", "safety_score")
def best_checkpoints(spark, d):
    return experiments.best_checkpoints(fx.history(spark, d), PATIENCE, DELTA)


REGISTRY = "reg as (select run_id as experiment_id, row_number() over (order by run_id) as registry_order from (select distinct run_id from hist))"


@query(
    STOPPED.rstrip() + ",\n" + REGISTRY + """
    select experiment_id, registry_order, epoch, safety_score, row_number() over (order by safety_score desc, registry_order) = 1 as winner from (select r.experiment_id, r.registry_order, h.epoch, h.safety_score from reg r left join last l on l.run_id = r.experiment_id and l.n = 1 left join hist h on h.run_id = l.run_id and h.epoch = l.best_epoch)""",
    "safety_score",
)
def screening_winner(spark, d):
    history = fx.history(spark, d)
    registry = experiments.placed(history.select(F.col("run_id").alias("experiment_id")).distinct(), "experiment_id", "registry_order")
    return experiments.screening(registry, experiments.best_checkpoints(history, PATIENCE, DELTA))


@query(with_(fx.HISTORY) + "select run_id, epoch, avg(safety_score) as train_loss from hist group by run_id, epoch", "train_loss")
def epoch_loss(spark, d):
    return experiments.epoch_loss(fx.history(spark, d).withColumnRenamed("safety_score", "loss"))


@query(with_(fx.HISTORY) + "select run_id, epoch, 0.0003 / 2 * (1 + cos(pi() * epoch / 100)) * 1000 as rate from hist", "rate")
def cosine_rates(spark, d):
    return fx.history(spark, d).select("run_id", "epoch", (experiments.cosine_rate(F.col("epoch"), 3e-4, 100) * 1000).alias("rate"))


@query("select event_type as run_id, count(value) as n, avg(value) as mean_ms, quantile_cont(value, 0.5) as p50_ms, quantile_cont(value, 0.95) as p95_ms, 1000 / avg(value) as fps from events group by event_type", "mean_ms p50_ms p95_ms fps")
def latency_statistics(spark, d):
    return experiments.latency(fx.table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("value").cast("double").alias("ms")))


@query(with_(fx.STEMS) + "select stem, (floor((row_number() over (order by stem) - 1) / 12) + 1)::BIGINT as sheet, ((row_number() over (order by stem) - 1) % 12 + 1)::BIGINT as slot from stems")
def contact_sheets(spark, d):
    return experiments.pages(fx.stems(spark, d).select("stem"), 12)


@query(with_(fx.STEMS) + "select stem, n - 1 as sample_index, v::INT as variant, 42 + 1000 * (n - 1) + v as variant_seed from (select stem, row_number() over (order by stem) as n from stems), range(3) r(v)")
def variant_seeds(spark, d):
    return experiments.variants(fx.stems(spark, d), 3)


DRAW = lambda text: f"(('0x' || sha256({text})[1:13])::BIGINT / 4503599627370496.0)"
OPS = ", ".join(f"('{o}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for o, v in experiments.PROFILES["domain"].items())


@query(
    with_(fx.STEMS) + f"""select stem, variant, variant_seed, op, {DRAW("'0:apply:' || variant_seed || ':' || op")} < probability as applied,
    case when op in ('brightness', 'contrast', 'saturation', 'hue') then case when op = 'hue' then 0 else 1 end + (2 * {DRAW("'0:value:' || variant_seed || ':' || op")} - 1) * lo else lo + {DRAW("'0:value:' || variant_seed || ':' || op")} * (hi - lo) end as value
    from (select stem, v::INT as variant, 42 + 1000 * (n - 1) + v as variant_seed from (select stem, row_number() over (order by stem) as n from stems), range(2) r(v)), (values {OPS}) p(op, probability, lo, hi)""",
    "value",
)
def augmentation_plan(spark, d):
    return experiments.augmentation_plan(experiments.variants(fx.stems(spark, d), 2), "domain")


PROFILE_ROWS = ", ".join(f"('{p}', '{o}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for p, ops in experiments.PROFILES.items() for o, v in ops.items())
CHOSEN = "chosen as (select stem, case when lang = 'en' then 'domain' when lang = 'fr' then 'baseline' else lang end as profile from stems)"


def _chosen(spark, d) -> DataFrame:
    return fx.stems(spark, d).select("stem", F.when(F.col("lang") == "en", "domain").when(F.col("lang") == "fr", "baseline").otherwise(F.col("lang")).alias("profile"))


@query(with_(fx.STEMS, CHOSEN) + f"select c.profile, op, probability, lo, hi, count(*) as stems from chosen c join (values {PROFILE_ROWS}) p(profile, op, probability, lo, hi) on p.profile = c.profile group by all", "probability lo hi")
def profile_lookup(spark, d):
    return experiments.with_profile(_chosen(spark, d)).groupBy("profile", "op", "probability", "lo", "hi").agg(F.count(F.lit(1)).alias("stems"))


@query(with_(fx.STEMS, CHOSEN) + "select distinct profile from chosen where profile not in ('baseline', 'domain')")
def unknown_profiles(spark, d):
    return experiments.unknown_profiles(_chosen(spark, d))


@query(with_(fx.SPLIT) + "select stem, n_chars as line_no from stems where stem in (select stem from split where split = 'train') order by line_no, stem limit 32")
def calibration_sample(spark, d):
    lines = fx.stems(spark, d).select("stem", F.struct("n_chars", "stem").alias("line_no"))
    return experiments.first_rows(lines, fx.split(spark, d), "train", 32).select("stem", F.col("line_no.n_chars").alias("line_no"))


@query(with_(fx.STEMS) + "select stem, n as place, (floor((n - 1) / 16) + 1)::BIGINT as batch from (select stem, row_number() over (order by sha256('42000129:' || stem)) as n, count(*) over () as t from stems) where floor((n - 1) / 16) + 1 <= t // 16")
def shuffled_batches(spark, d):
    return experiments.batches(fx.stems(spark, d), 16, 3)


@query(with_(fx.STEMS) + "select lang, stem, row_number() over (partition by lang order by sha256('42:' || stem)) as place from stems")
def seeded_order(spark, d):
    return splits.ranked_within(fx.stems(spark, d).select("lang", "stem"), "lang", splits.seeded(42, F.col("stem")), "place")


SIZED = "sized as (select stem, (n_chars % 700 + 60)::INT as height, (n_chars % 900 + 80)::INT as width from stems)"
INSIDE = "least(384 / height, 512 / width)"
COVER = "greatest(384 / height, 512 / width)"
SIDE = lambda side, s: f"greatest(1, round_even({side} * {s}, 0))::INT"


def _geometry_sql() -> str:
    a = f"select stem, 'stretch' as mode, 384 as rh, 512 as rw from sized union all select stem, 'letterbox', {SIDE('height', INSIDE)}, {SIDE('width', INSIDE)} from sized union all select stem, 'center_crop', {SIDE('height', COVER)}, {SIDE('width', COVER)} from sized"
    return with_(fx.STEMS, SIZED) + f"select stem, mode, rh, rw, case mode when 'letterbox' then floor((512 - rw) / 2)::INT when 'center_crop' then floor((rw - 512) / 2)::INT end as left_edge, case mode when 'letterbox' then floor((384 - rh) / 2)::INT when 'center_crop' then floor((rh - 384) / 2)::INT end as top_edge from ({a})"


@query(_geometry_sql())
def geometry_plans(spark, d):
    sized = fx.stems(spark, d).select("stem", (F.col("n_chars") % 700 + 60).cast("int").alias("height"), (F.col("n_chars") % 900 + 80).cast("int").alias("width"))
    plans = F.array(*[geometry(F.col("height"), F.col("width"), (384, 512), m) for m in MODES])
    rows = sized.select("stem", F.explode(plans).alias("g"))
    box = F.coalesce("g.padding", "g.crop")
    return rows.select("stem", "g.mode", F.col("g.resized_size.height").alias("rh"), F.col("g.resized_size.width").alias("rw"), box["left"].alias("left_edge"), box["top"].alias("top_edge"))


@query(with_(fx.STEMS) + "select stem, 0.4 * (n_chars % 11) / 10.0 + 0.3 * (n_chars % 7) / 6.0 + 0.2 * (n_chars % 5) / 4.0 + 0.1 * (1 - (n_chars % 3) / 2.0) as score from stems", "score")
def safety_scores(spark, d):
    part = lambda m: (F.col("n_chars") % m) / float(m - 1)
    return fx.stems(spark, d).select("stem", lab.safety_score(part(11), part(7), part(5), part(3)).alias("score"))


@query("select vec_id, sqrt(list_inner_product(v, v)) as length, list_inner_product(v, list_reverse(v)) as mirrored, pow(f, 1.2) * (1 - f) + f as fogged from (select vec_id, embedding::DOUBLE[] as v, least(greatest(abs(v[1]), 0.01), 0.5) as f from embeddings)", "length mirrored fogged")
def vector_functions(spark, d):
    v = F.col("embedding")
    first = vectors.clamp(F.abs(F.get(v, 0).cast("double")), 0.01, 0.5)
    fogged = vectors.blend(vectors.gamma(first, F.lit(1.2)), first)
    return fx.table(spark, d, "embeddings").select("vec_id", vectors.norm(v).alias("length"), vectors.dot(v, F.reverse(v)).alias("mirrored"), fogged.alias("fogged"))


@query("select lang, count(*) as n, sum(n_chars)::BIGINT as total from documents group by lang")
def json_round_trip(spark, d):
    coded = fx.table(spark, d, "documents").select(F.to_json(F.struct("lang", "n_chars")).alias("j"))
    read = coded.select(F.from_json("j", "lang string, n_chars bigint").alias("r")).select("r.*")
    return read.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))


@query(
    with_(fx.STEMS) + f"select avg(u) as mean_u, avg(g) as mean_g, stddev_samp(g) as std_g from (select {DRAW("'7:' || stem")} as u, sqrt(-2 * ln(greatest({DRAW("'7:u:' || stem")}, pow(2.0, -53)))) * cos(2 * pi() * {DRAW("'7:v:' || stem")}) as g from stems)",
    "mean_u mean_g std_g",
)
def seeded_draws(spark, d):
    s = fx.stems(spark, d).select("stem", vectors.uniform(7, F.col("stem")).alias("u"), vectors.gaussian(7, F.col("stem")).alias("g"))
    return s.agg(F.avg("u").alias("mean_u"), F.avg("g").alias("mean_g"), F.stddev_samp("g").alias("std_g"))


# --- protocol -----------------------------------------------------------------------------------------------------

RESULTS = "res as (select event_type as experiment_id, user_id % 3 as seed, avg(value) as score, count(*) as n from events group by all)"


def _results(spark, d) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("experiment_id"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("score"))


@query(with_(RESULTS) + "select experiment_id, count(*) as seeds, avg(score) as score_mean, stddev_samp(score) as score_std from res group by experiment_id", "score_mean score_std")
def over_seeds(spark, d):
    return experiments.over_seeds(_results(spark, d), "score")


def _poisson_sql(u: str) -> str:
    """A Poisson(1) draw from a uniform one by its distribution function."""
    total, term, steps = 0.0, 2.718281828459045**-1, []
    for k in range(12):
        total += term
        steps.append(f"({u} >= {total!r})::INT")
        term /= k + 1
    return " + ".join(steps)


@query(
    with_(fx.LABELLED) + f""", per as (select stem, count(*) filter (where target = pred and target <> 4)::DOUBLE as n, count(*) filter (where target <> 4)::DOUBLE as d from px group by stem),
    dr as (select n, d, r, {DRAW("'42:' || stem || ':' || r")} as u from per, range(1, 201) q(r)),
    rep as (select r, sum(n * w) / greatest(sum(d * w), 1) as v from (select n, d, r, {_poisson_sql('u')} as w from dr) group by r)
    select (select sum(n) / greatest(sum(d), 1) from per) as estimate, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from rep""",
    "estimate low high",
)
def bootstrap_interval(spark, d):
    px = fx.labelled(spark, d).groupBy("stem").agg(F.count_if((F.col("target") == F.col("pred")) & (F.col("target") != 4)).alias("right"), F.count_if(F.col("target") != 4).alias("all"))
    return experiments.bootstrap(px, "right", "all")


BEST = "best as (select run_id, max(safety_score) as safety_score, count(*)::DOUBLE as fp from hist group by run_id)"


def _best(spark, d) -> DataFrame:
    return fx.history(spark, d).groupBy("run_id").agg(F.max("safety_score").alias("safety_score"), F.count(F.lit(1)).cast("double").alias("fp"))


@query(with_(fx.HISTORY, BEST, "s as (select avg(safety_score) as s_score, avg(fp) as s_fp from best)") + "select run_id, safety_score, fp, s_score, s_fp, safety_score >= s_score + 0.005 and fp <= s_fp + 5 as accepted from best, s", "safety_score fp s_score s_fp")
def teacher_gate(spark, d):
    best = cut(_best(spark, d), "best")
    return experiments.teacher_gate(best, best.agg(F.avg("safety_score").alias("safety_score"), F.avg("fp").alias("fp")))


@query(with_(fx.HISTORY, BEST, "q as (select run_id, safety_score - 0.001 * fp as safety_score, fp * 1.08 as fp from best)") + "select q.run_id, q.safety_score, q.fp, b.safety_score as f_score, b.fp as f_fp, q.safety_score >= b.safety_score - 0.06 and q.fp - b.fp <= greatest(5.0, 0.1 * b.fp) as accepted from q join best b using (run_id)", "safety_score fp f_score f_fp")
def quantisation_gate(spark, d):
    best = cut(_best(spark, d), "best")
    small = best.select("run_id", (F.col("safety_score") - 0.001 * F.col("fp")).alias("safety_score"), (F.col("fp") * 1.08).alias("fp"))
    return experiments.non_inferior(small, best, drop=0.06)


@query(with_(fx.LABELLED) + "select count(*) as sequences, avg(r) as macro_recall from (select stem, count(*) filter (where target = 0 and pred = 0) / greatest(count(*) filter (where target = 0), 1) as r from px group by stem)", "macro_recall")
def macro_recall(spark, d):
    px = fx.labelled(spark, d)
    return experiments.macro_recall(px.select(F.col("stem").alias("sequence"), ((F.col("target") == 0) & (F.col("pred") == 0)).cast("int").alias("recalled"), (F.col("target") == 0).cast("int").alias("total")))


@query("select event_type as run_id, avg(value) filter (where user_id % 2 = 0) as internal, avg(value) filter (where user_id % 2 = 1) as external, avg(value) filter (where user_id % 2 = 0) - avg(value) filter (where user_id % 2 = 1) as gap from events group by event_type", "internal external gap")
def domain_gap(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.when(F.col("user_id") % 2 == 0, "internal").otherwise("external").alias("domain"), F.col("value").cast("double").alias("value"))
    return experiments.domain_gap(e, "value")


MODE_SQL = "case user_id % 3 when 0 then 'stretch' when 1 then 'letterbox' else 'center_crop' end"


@query(
    f"""with s as (select event_type as stem, {MODE_SQL} as mode, max(value) as value from events group by all)
    select stem, max(value) filter (where mode = 'stretch') as stretch, max(value) filter (where mode = 'letterbox') as letterbox, max(value) filter (where mode = 'center_crop') as center_crop,
    case when stem < 'm' then 1.0 end as official, stem < 'm' as official_mask_available from s group by stem""",
    "stretch letterbox center_crop official",
)
def mode_comparison(spark, d):
    mode = F.when(F.col("user_id") % 3 == 0, "stretch").when(F.col("user_id") % 3 == 1, "letterbox").otherwise("center_crop")
    s = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("stem"), mode.alias("mode")).agg(F.max("value").cast("double").alias("value"))
    return experiments.side_by_side(s, s.select("stem").distinct().filter("stem < 'm'").withColumn("value", F.lit(1.0)))


@query(with_(fx.SPLIT) + "select stem, split from split where split = 'test'")
def selection_guard(spark, d):
    return experiments.wrong_splits(fx.split(spark, d))


# --- streams ------------------------------------------------------------------------------------------------------


@query(with_(fx.LABELLED) + f"select stem, {CM} from px group by stem")
def streamed_confusion(spark, d):
    from tidemark.streaming.metrics import running_confusion
    from tidemark.streaming.runs import drained

    source = spark.readStream.schema(fx.table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parquet*")
    flag = F.col("l_returnflag")
    target = F.when(F.col("l_linenumber") == 7, 4).when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    px = source.select(F.col("l_suppkey").alias("stem"), target.alias("target"), (F.col("l_quantity").cast("int") % 3).alias("pred"))
    return drained(running_confusion(px, "stem"), "complete", ["stem"])


@query(STOPPED + "select run_id, best as best_score, best_epoch, stop_epoch is not null as stopped from last where n = 1", "best_score")
def streamed_stopping(spark, d):
    from tidemark.streaming.runs import drained
    from tidemark.streaming.stopping import stopping_stream

    history = cut(fx.history(spark, d).withColumn("part", F.pmod(F.xxhash64("run_id", "epoch"), F.lit(3))), "history")
    source = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 2).parquet(history._cut_path)
    states = stopping_stream(source.select("run_id", "epoch", "safety_score"), PATIENCE, DELTA)
    return drained(states, "update", ["run_id"], "epoch").select("run_id", "best_score", "best_epoch", "stopped")


#: Rows of a file of a stream's source.
ARRIVED = 500_000
GAPS = "hist as (select run_id, (row_number() over (partition by run_id order by epoch))::INT as epoch, epoch as real, safety_score from (" + fx.HISTORY.split("(", 1)[1].rsplit(")", 1)[0] + ") where (epoch + run_id::BIGINT) % 5 <> 3)"


@query(_recursive(GAPS, FOLD) + "select l.run_id, l.best as best_score, h.real as best_epoch, l.stop_epoch is not null as stopped from last l left join hist h on h.run_id = l.run_id and h.epoch = l.best_epoch where l.n = 1", "best_score")
def streamed_stopping_gaps(spark, d):
    """Every fifth epoch of a run never arrives: timers release what waits for it, and the fold passes over it."""
    from tidemark.streaming.runs import drained
    from tidemark.streaming.stopping import stopping_stream

    history = fx.history(spark, d).filter((F.col("epoch") + F.col("run_id").cast("long")) % 5 != 3).withColumn("part", F.pmod(F.xxhash64("run_id", "epoch"), F.lit(3)))
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * F.col("part"))  # parts arrive an hour after each other
    rows = cut(history.select("run_id", "epoch", "safety_score", seen.alias("seen"), "part"), "history")
    clock = spark.range(1).select(F.lit("clock").alias("run_id"), F.lit(1).alias("epoch"), F.lit(0.0).alias("safety_score"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("seen"))
    path = f"{rows._cut_path}-arrived"
    files = rows.count() // (3 * ARRIVED) + 1  # of a part, which is a batch
    for part in range(3):
        rows.filter(F.col("part") == part).drop("part").repartition(files).write.mode("append").parquet(path)
    clock.coalesce(1).write.mode("append").parquet(path)  # time goes on
    source = spark.readStream.schema(clock.schema).option("maxFilesPerTrigger", files).parquet(path)
    states = drained(stopping_stream(source, PATIENCE, DELTA, "seen", "10 seconds", wait=86_400), "update", ["run_id"], "epoch")
    return states.filter("run_id <> 'clock'").select("run_id", "best_score", "best_epoch", "stopped")


@query(with_(fx.HISTORY) + "select run_id, epoch, safety_score from hist", "safety_score")
def streamed_history(spark, d):
    """Epochs that a source delivers twice, kept once as long as the watermark remembers them; the sink takes each batch once."""
    from tidemark.sources.files import append_history, read_history
    from tidemark.streaming.metrics import once_per_image
    from tidemark.streaming.runs import kept_history

    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("epoch"))
    rows = cut(fx.history(spark, d).withColumn("seen", seen), "history")
    again = rows.withColumn("safety_score", F.col("safety_score") + 1)  # a second delivery that must not count
    path = f"{rows._cut_path}-twice"
    for part in (rows, again):
        part.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept_history(once_per_image(source, ["run_id", "epoch"], "seen", "30 days"), f"{path}-kept", f"{path}-state")
    append_history(again, f"{path}-kept", 0)  # a batch that runs again
    return read_history(spark, f"{path}-kept", rows.schema).drop("seen")


@query(with_(fx.LABELLED.replace("from lineitem", ", l_shipdate as day from lineitem")) + f"select (epoch(day::TIMESTAMP)::BIGINT // 2592000) * 2592000 as start, {CM} from px where day is not null group by 1")
def streamed_windows(spark, d):
    """Confusion sums of 30-day windows of event time, over a stream."""
    from tidemark.streaming.metrics import windowed_confusion
    from tidemark.streaming.runs import drained

    source = spark.readStream.schema(fx.table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parquet*")
    flag = F.col("l_returnflag")
    target = F.when(F.col("l_linenumber") == 7, 4).when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    px = source.select(F.col("l_shipdate").cast("timestamp").alias("day"), target.alias("target"), (F.col("l_quantity").cast("int") % 3).alias("pred"))
    sums = windowed_confusion(px.filter("day is not null"), "day", "30 days", "100 years")
    sums = sums.select(F.unix_timestamp("window.start").alias("start"), *[c for c in sums.columns if c != "window"])
    return drained(sums, "update", ["start"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate groups by embedding, a grouped split of them, and its audit: one row a split."""
    members, mix = _members(spark, d), fx.class_mix(spark, d)
    split = cut(splits.grouped_split(members, mix), "split")
    leaks = neardup.across_splits(neardup.cosine_pairs(fx.vectors(spark, d), 0.4), split).agg(F.count(F.lit(1)).alias("cross_split_violations"))
    out = audit.class_balance(mix, split).join(audit.group_sizes(members, split), "split")
    images = split.groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    out = out.join(images, "split").withColumn("k", F.lit(1)).join(leaks.withColumn("k", F.lit(1)), "k")
    return rounded(out.select("split", "images", "groups", F.col("max_size").alias("largest_group"), "obstacle_ratio", "water_ratio", "sky_ratio", "cross_split_violations"))
