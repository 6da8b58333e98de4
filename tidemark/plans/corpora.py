"""Small file corpora that tasks write to the shared folder from the driver's tables, and the queries that scan them back."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import jpeg
from tidemark.operators import dense, experiments, imagejobs, losses, scoring, splits
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import PIXEL_SCORES, query, report_sql, with_
from tidemark.session import cut, shared_dir
from tidemark.sources import files

#: Gray step between labels in an image's channels, so that they can be read back.
STEP = 60
SUPPLIERS = "sup as (select s_suppkey::INT as s, lpad(cast(s_suppkey as varchar), 6, '0') as stem from supplier where s_suppkey is not null)"
PX = fx.PIXELS + ", pn as (select lpad(cast(stem as varchar), 6, '0') as stem, y, x, target, pred from px)"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "supplier").filter("s_suppkey is not null").select(F.col("s_suppkey").cast("int").alias("s"))
    return s.withColumn("stem", F.lpad(F.col("s").cast("string"), 6, "0"))


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, d: str) -> str:
    """A folder of names as corpora have them: images of several suffixes in sequences, masks of both names, some IMU masks; contents are the names."""
    rows = _suppliers(spark, d).select(F.explode(F.filter(F.array(
        F.concat(F.lit("images/seq"), (F.col("s") % 4).cast("string"), F.lit("/"), F.col("stem"), F.get(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".bmp", ".gif")]), F.col("s") % 5)),
        F.when(F.col("s") % 10 == 0, F.concat(F.lit("images/seq"), (F.col("s") % 4).cast("string"), F.lit("/"), F.col("stem"), F.lit(".png"))),
        F.when(F.col("s") % 3 == 0, F.concat(F.lit("masks/"), F.col("stem"), F.lit("m.png"))),
        F.when(F.col("s") % 6 == 0, F.concat(F.lit("masks/"), F.col("stem"), F.lit("m.bmp"))),
        F.when(F.col("s") % 3 == 1, F.concat(F.lit("masks/"), F.col("stem"), F.lit(".tif"))),
        F.when(F.col("s") % 3 == 2, F.concat(F.lit("masks/"), F.col("stem"), F.lit(".jpg"))),
        F.when(F.col("s") % 4 == 0, F.concat(F.lit("imus/"), F.col("stem"), F.lit(".png"))),
    ), lambda x: x.isNotNull())).alias("path"))
    root = _folder(spark, "listing")
    files.write_files(rows.withColumn("content", F.encode("path", "utf-8")), root)
    return root


IMAGE = "stem || case s % 5 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.bmp' else '.gif' end"


@query(f"with {SUPPLIERS} select stem from sup where s % 5 <> 4")
def image_listing(spark, d):
    return files.image_stems(files.file_table(spark, listing(spark, d) + "/images"))


@query(f"with {SUPPLIERS} select stem, 2 as files from sup where s % 10 = 0")
def ambiguous_images(spark, d):
    return files.ambiguous_stems(files.file_table(spark, listing(spark, d) + "/images"))


def _pairs(spark, root) -> DataFrame:
    return files.pair_files(files.file_table(spark, root + "/images"), files.file_table(spark, root + "/masks"))


@query(f"with {SUPPLIERS} select stem, {IMAGE} as image, case s % 3 when 0 then stem || 'm.png' when 1 then stem || '.tif' end as mask from sup where s % 5 <> 4")
def mask_pairs(spark, d):
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return _pairs(spark, listing(spark, d)).select("stem", name("image_path").alias("image"), name("mask_path").alias("mask"))


@query(f"with {SUPPLIERS} select stem from sup where s % 5 <> 4 and s % 3 = 2")
def images_without_mask(spark, d):
    return files.missing_masks(_pairs(spark, listing(spark, d)))


@query(f"with {SUPPLIERS} select stem, s % 4 = 0 as has_imu from sup where s % 5 <> 4")
def imu_sources(spark, d):
    root = listing(spark, d)
    found = files.attach_imu(_pairs(spark, root), files.file_table(spark, root + "/imus"))
    return found.select("stem", F.col("imu_path").isNotNull().alias("has_imu"))


@query(f"with {SUPPLIERS} select stem from sup where s % 5 <> 4 and s % 4 <> 0")
def images_without_imu(spark, d):
    root = listing(spark, d)
    return files.without_imu(files.attach_imu(_pairs(spark, root), files.file_table(spark, root + "/imus")))


@query(f"with {SUPPLIERS} select 'seq' || (s % 4) || '/' || {IMAGE} as relative from sup where s % 5 <> 4 union all select 'seq' || (s % 4) || '/' || stem || '.png' from sup where s % 10 = 0")
def relative_listing(spark, d):
    root = listing(spark, d) + "/images"
    return files.relative_images(files.file_table(spark, root), root).select("relative")


@query(f"with {SUPPLIERS} select distinct 'r' || (s % 7) as root from sup where s % 7 in (select s % 7 from sup where s % 2 = 0) and s % 7 in (select s % 7 from sup where s % 3 = 0) and s % 7 < 5")
def dataset_roots(spark, d):
    """Roots of which some lack a folder: those above 4 have images only."""
    rows = _suppliers(spark, d).select(F.explode(F.filter(F.array(
        F.when(F.col("s") % 2 == 0, F.concat(F.lit("r"), (F.col("s") % 7).cast("string"), F.lit("/images/"), F.col("stem"), F.lit(".png"))),
        F.when((F.col("s") % 3 == 0) & (F.col("s") % 7 < 5), F.concat(F.lit("r"), (F.col("s") % 7).cast("string"), F.lit("/masks/"), F.col("stem"), F.lit(".png"))),
    ), lambda x: x.isNotNull())).alias("path"))
    root = _folder(spark, "roots")
    files.write_files(rows.withColumn("content", F.encode("path", "utf-8")), root)
    return files.dataset_roots(files.file_table(spark, root)).select(F.element_at(F.split("root", "/"), -1).alias("root"))


def _lists(spark, d) -> str:
    """``train.txt`` and ``val.txt`` with comments, blanks and suffixes; there is no list of the test split."""
    lines = _suppliers(spark, d).select(F.when(F.col("s") % 3 == 0, "val").otherwise("train").alias("split"), "s", F.concat("stem", F.when(F.col("s") % 2 == 0, ".jpg").otherwise("")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "line"))), lambda x: x["line"]), "\r\n")
    rows = lines.groupBy("split").agg(F.concat(F.lit("# list\n\n  "), text, F.lit("\n\n#end\n")).alias("text"))
    root = _folder(spark, "lists")
    files.write_files(rows.select(F.concat("split", F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content")), root)
    return root


@query(f"with {SUPPLIERS} select case when s % 3 = 0 then 'val' else 'train' end as split, stem from sup")
def split_list_entries(spark, d):
    return files.split_lists(spark, _lists(spark, d))


@query("select 'test' as split from (select count(*) from supplier)")
def missing_split_lists(spark, d):
    return files.missing_splits(files.split_lists(spark, _lists(spark, d)))


@query(with_(fx.SPLIT) + "select split, stem from split")
def written_splits(spark, d):
    root = _folder(spark, "written")
    files.write_splits(fx.split(spark, d), root)
    return spark.read.text(root).select("split", F.col("value").alias("stem"))


@query("select event_type as run_id, count(*) as n, avg(value) as mean_value, sqrt(avg(value)) as root from events group by event_type", "mean_value root")
def report_round_trip(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    path = _folder(spark, "report")
    files.write_report(e.select("run_id", F.struct("n", "mean_value", F.create_map(F.lit("root"), F.sqrt("mean_value")).alias("more")).alias("scores")), path)
    read = files.read_report(spark, path, "run_id string, scores struct<n: bigint, mean_value: double, more: map<string, double>>", lines=True)
    return read.select("run_id", "scores.n", "scores.mean_value", F.col("scores.more")["root"].alias("root"))


@query("select event_type as experiment_id, count(*) as epochs, avg(value) > 50 as distil from events group by event_type")
def experiment_registry(spark, d):
    """A registry document with one entry for each kind of event, read back as rows."""
    e = fx.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("epochs"), (F.avg("value") > 50).alias("distil"))
    path = _folder(spark, "registry")
    files.write_report(e.agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("epochs", "distil")))).alias("experiments")), path)
    return experiments.registry(files.read_report(spark, path, "experiments map<string, struct<epochs: bigint, distil: boolean>>", lines=True))


@query(with_(fx.HISTORY) + "select run_id, epoch, safety_score from hist", "safety_score")
def appended_history(spark, d):
    """Odd epochs with scores that are to be replaced, then all; each batch comes twice and counts once."""
    path, rows = _folder(spark, "history"), cut(fx.history(spark, d), "epochs")
    early = rows.filter(F.col("epoch") % 2 == 1).withColumn("safety_score", F.lit(-1.0))
    for number, part in ((0, early), (0, early.limit(0)), (1, rows), (1, early)):
        files.append_history(part, path, number)
    return files.read_history(spark, path, rows.schema)


@query(with_(fx.SPLIT) + "select split, stem, row_number() over (partition by split order by stem) as line_no from split")
def numbered_splits(spark, d):
    """Lists written in several sorted parts, and the line of each entry by their manifest."""
    root = _folder(spark, "written")
    files.write_splits(fx.split(spark, d), root, parts=8)
    return files.numbered_splits(spark, root)


@query("select event_type as run_id, count(*) as n, true as refused, true as replaced from events group by event_type")
def guarded_results(spark, d):
    """Results that are there are not overwritten unless asked for: the table is as it was after a refused write, and new after one that is asked for."""
    path = _folder(spark, "guarded")
    rows = cut(fx.table(spark, d, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.count(F.lit(1)).alias("n")), "guarded-rows")
    schema = "run_id string, n bigint"
    files.refuse_existing(spark, path, ("report", "best"))
    files.write_report(rows, f"{path}/report")
    refused = 0
    for attempt in (lambda: files.refuse_existing(spark, path, ("report", "best")), lambda: files.write_report(rows.limit(0), f"{path}/report"), lambda: files.write_splits(rows.select(F.col("run_id").alias("split"), F.col("run_id").alias("stem")), f"{path}/report")):
        try:
            attempt()
        except Exception as e:  # noqa: BLE001
            refused += "EXISTS" in str(e).upper() or isinstance(e, FileExistsError)
    before = cut(files.read_report(spark, f"{path}/report", schema, lines=True), "guarded-before")
    files.refuse_existing(spark, path, ("report", "best"), overwrite=True)
    files.write_report(rows.withColumn("n", -F.col("n")), f"{path}/report", "overwrite")
    after = files.read_report(spark, f"{path}/report", schema, lines=True).select("run_id", F.col("n").alias("m"))
    return before.join(after, "run_id").select("run_id", "n", F.lit(refused == 3).alias("refused"), (F.col("m") == -F.col("n")).alias("replaced"))


@query(with_(fx.HISTORY) + "select run_id, count(*) as epochs, 12 as patience, 42 as seed from hist group by run_id")
def run_configs(spark, d):
    runs = fx.history(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"))
    return experiments.run_config(runs, patience=12, seed=42).select("run_id", "epochs", "protocol.patience", "protocol.seed")


# --- decoded images -----------------------------------------------------------------------------------------------


def _png_rows(spark, d, kinds) -> DataFrame:
    """``path, content`` of an RGB image for each supplier (red the prediction, green the target, blue both), its mask (gray, or coloured for odd ones), and some IMU masks."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                t, p = (np.frombuffer(b, np.uint8).reshape(r.height, r.width) for b in (r.target, r.pred))
                out.append((f"images/{r.stem:06d}.png", imagejobs.encode_png(np.stack([p * STEP, t * STEP, (t + p) * 10], 2))))
                colour = np.stack([(t == k) * 255 for k in range(3)], 2).astype(np.uint8)
                out.append((f"masks/{r.stem:06d}m.png", imagejobs.encode_png(t[:, :, None] if r.stem % 2 == 0 else colour)))
                if r.stem % 4 == 0:
                    out.append((f"imus/{r.stem:06d}.png", imagejobs.encode_png((p == 2).astype(np.uint8)[:, :, None])))
            yield pd.DataFrame([r for r in out if r[0].partition("/")[0] in kinds], columns=["path", "content"])

    return dense.mask_pairs(fx.pixels(spark, d)).mapInPandas(run, "path string, content binary")


def pictures(spark: SparkSession, d: str, *kinds: str) -> str:
    """A folder of the pictures; ``kinds`` names the folders below it that the caller reads (none: all)."""
    root = _folder(spark, "pictures")
    files.write_files(_png_rows(spark, d, kinds or ("images", "masks", "imus")), root)
    return root


@query(with_(PX) + f"select stem, 24 as height, 32 as width, 3 as channels, sum(pred * {STEP})::BIGINT as red, sum(target * {STEP})::BIGINT as green, sum((target + pred) * 10)::BIGINT as blue from pn group by stem")
def decoded_images(spark, d):
    return imagejobs.channel_sums(files.images(spark, pictures(spark, d) + "/images"))


def _masks(spark, root) -> DataFrame:
    return imagejobs.named_like_images(imagejobs.decode_masks(files.images(spark, root + "/masks")))


@query(with_(PX) + "select stem, target as label, count(*) as n from pn group by all")
def decoded_masks(spark, d):
    px = scoring.pixel_rows(_masks(spark, pictures(spark, d)), "label")
    return px.groupBy("stem", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(PX) + "select stem, count(*) filter (where target = 0) as obstacle, sum(pred * 60)::BIGINT as red, case when stem::INT % 4 = 0 then count(*) filter (where pred = 2) end as imu_pixels from pn group by stem")
def sample_records(spark, d):
    """Whole samples: image, labels and the IMU mask where there is one, in one row each."""
    root = pictures(spark, d)
    found = imagejobs.samples(files.images(spark, root + "/images"), _masks(spark, root), imagejobs.decode_masks(files.images(spark, root + "/imus")))
    return imagejobs.sample_counts(found)


@query(with_(PX) + "select stem, 2 as files, 1 as hashes from (select distinct stem from pn)")
def image_hashes(spark, d):
    """Each picture and its copy in another folder have one perceptual hash."""
    a, b = (imagejobs.image_hashes(files.images(spark, r + "/images")) for r in (pictures(spark, d, "images"), pictures(spark, d, "images")))
    return a.unionByName(b).groupBy("stem").agg(F.count(F.lit(1)).cast("int").alias("files"), F.count_distinct("h").cast("int").alias("hashes"))


LANCZOS = "case when abs(t) < 3 then (case when t = 0 then 1.0 else sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) end)::DOUBLE else 0.0 end"
HASH_SQL = f"""
tap as (select k, i, (i - (k + 0.5) * 0.75 + 0.5)::DOUBLE as t from range(32) a(k), range(24) b(i) where i >= greatest(floor((k + 0.5) * 0.75 - 2.5), 0) and i < least(floor((k + 0.5) * 0.75 + 3.5), 24)),
wt as (select k, i, {LANCZOS} as w from tap), fixed as (select k, i, w / sum(w) over (partition by k) * 4194304 as f from wt),
gray as (select stem, y, x, (pred * 60 * 19595 + target * 60 * 38470 + (target + pred) * 10 * 7471 + 32768) >> 16 as g from pn),
small as (select stem, k as y, x, least(greatest(floor((sum((case when f < 0 then ceil(f - 0.5) else floor(f + 0.5) end) * g) + 2097152) / 4194304), 0), 255) as v from gray join fixed on i = y group by stem, k, x),
c as (select u, n, (case when u = 0 then sqrt(1 / 32.0::DOUBLE) else sqrt(2 / 32.0::DOUBLE) end) * cos(pi() * (n + 0.5::DOUBLE) * u / 32) as c from range(8) a(u), range(32) b(n)),
half as (select stem, y, u, sum(v * c) as h from small join c on n = x group by stem, y, u),
low as (select stem, r.u * 8 + half.u as spot, round(sum(h * c), 6) + 0.0 as d from half join c r on r.n = y group by stem, r.u, half.u),
cut as (select *, (select median(m.d) from low m where m.stem = low.stem and m.spot > 0) as middle from low)"""


@query(with_(PX, HASH_SQL) + "select stem, sum(case when d > middle and spot < 32 then 1::BIGINT << (31 - spot)::INT else 0 end)::BIGINT as hi, sum(case when d > middle and spot >= 32 then 1::BIGINT << (63 - spot)::INT else 0 end)::BIGINT as lo from cut group by stem")
def image_hash_values(spark, d):
    """The perceptual hash of each picture in two halves: gray, resampled in whole numbers, transformed, cut at the median."""
    h = imagejobs.image_hashes(files.images(spark, pictures(spark, d, "images") + "/images"))
    return h.select("stem", F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))


def _mean_model():
    return lambda x: x.mean((2, 3))


def _channel(v: str, k: int) -> str:
    return f"avg(({v} / 255.0 - {imagejobs.MEAN[k]}) / {imagejobs.STD[k]})"


@query(
    with_(PX) + "select stem, round(r / n, 4) as red, round(g / n, 4) as green, round(b / n, 4) as blue from (select *, sqrt(r * r + g * g + b * b) as n from (select stem, "
    + f"{_channel('pred * 60', 0)} as r, {_channel('target * 60', 1)} as g, {_channel('(target + pred) * 10', 2)} as b from pn group by stem))",
    "red green blue",
)
def image_embeddings(spark, d):
    """Unit vectors of a caller's model: here the channel means of the normalised input. Four places: the model works in single precision."""
    v = scoring.embed_images(files.images(spark, pictures(spark, d) + "/images"), _mean_model, (fx.HEIGHT, fx.WIDTH))
    return v.select("stem", *[F.round(F.get("embedding", k).cast("double"), 4).alias(n) for k, n in enumerate(("red", "green", "blue"))])


def _red_model():
    """Logits by how near the red channel is to each label's step; it reads the prediction back."""

    def model(x):
        red = (x[:, 0] * imagejobs.STD[0] + imagejobs.MEAN[0]) * 255.0
        return np.stack([-np.abs(red - k * STEP) for k in range(3)], 1)

    return model


def _scored(spark, d, target, mode) -> DataFrame:
    scored = scoring.score_masks(files.images(spark, pictures(spark, d) + "/images"), _red_model, target, mode)
    return scoring.pixel_rows(scored, "label").select("stem", "y", "x", F.col("label").cast("int").alias("label"))


@query(with_(PX) + "select stem, y, x, pred as label from pn")
def scored_masks(spark, d):
    return _scored(spark, d, (fx.HEIGHT, fx.WIDTH), "stretch")


@query(with_(PX) + "select stem, y, x, pred as label from pn")
def letterboxed_masks(spark, d):
    return _scored(spark, d, (fx.HEIGHT, 2 * fx.WIDTH), "letterbox")


@query(with_(PX) + "select stem, y, x, case when x between 8 and 23 then pred else 255 end as label from pn")
def cropped_masks(spark, d):
    """The model sees the middle 16 columns; the rest is unknown."""
    return _scored(spark, d, (fx.HEIGHT, fx.WIDTH // 2), "center_crop")


@query(with_(PX) + "select stem, 'letterbox' as mode, 24 as height, 32 as width, 16 as left_edge from (select distinct stem from pn)")
def geometry_rows(spark, d):
    g = scoring.geometry_manifest(files.images(spark, pictures(spark, d) + "/images"), (fx.HEIGHT, 2 * fx.WIDTH), "letterbox").select("stem", "geometry.*")
    return g.select("stem", "mode", F.col("resized_size.height").alias("height"), F.col("resized_size.width").alias("width"), F.col("padding.left").alias("left_edge"))


@query(with_(fx.PIXELS) + "select lpad(cast(g.stem as varchar), 6, '0') as stem, g.y, g.x, px.target as label from (select s_suppkey::INT as stem, y::INT as y, x::INT as x from supplier, range(12) a(y), range(20) b(x)) g join px on px.stem = g.stem and px.y = least(floor((g.y + 0.5) * 24 / 12), 23) and px.x = least(floor((g.x + 0.5) * 32 / 20), 31)")
def resized_masks(spark, d):
    small = imagejobs.resize_masks(_masks(spark, pictures(spark, d)), 12, 20)
    return scoring.pixel_rows(small, "label").select("stem", "y", "x", F.col("label").cast("int").alias("label"))


@query(with_(PX) + "select 'seq' || (stem::INT % 3) as sequence, target as label, count(*) as n from pn group by all")
def written_masks(spark, d):
    path = _folder(spark, "masks")
    files.write_masks(_masks(spark, pictures(spark, d)).withColumn("sequence", F.concat(F.lit("seq"), (F.col("stem").cast("int") % 3).cast("string"))), path)
    px = spark.read.parquet(path).withColumn("stem", F.struct("sequence", "stem"))
    return scoring.pixel_rows(px, "label").groupBy("stem.sequence", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(PX) + "select stem, y, 31 - x as x, target as label from pn union all select stem, y, x, target from pn")
def flipped_masks(spark, d):
    """Augmentation moves image and labels together: variant 0 flips, variant 1 does not."""
    root = pictures(spark, d)
    found = imagejobs.samples(files.images(spark, root + "/images"), _masks(spark, root))
    ops = found.select("stem", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("variant"))
    ops = ops.select("stem", "variant", F.col("variant").alias("variant_seed"), F.lit("horizontal_flip").alias("op"), (F.col("variant") == 0).alias("applied"), F.lit(0.0).alias("value"))
    done = imagejobs.apply_augmentation(found, ops).withColumn("stem", F.struct("stem", "variant"))
    return scoring.pixel_rows(done, "label").select("stem.stem", "y", "x", F.col("label").cast("int").alias("label"))


#: Ops with their values, one variant after another: jitter; flip, gamma and fog; hue; blur; nothing.
VARIANTS = (
    {"brightness": 1.1873, "contrast": 0.8311, "saturation": 0.9137},
    {"horizontal_flip": 0.0, "gamma": 1.2371, "fog": 0.1039},
    {"hue": 0.0371},
    {"gaussian_blur": 0.9173},
    {},
)
GRAY = "(0.2989 * {0}r + 0.587 * {0}g + 0.114 * {0}b)"
_clip = "least(greatest({}, 0.0), 1.0)".format
_each_channel = lambda f: ", ".join(f"{f(c)} as {c}" for c in "rgb")
BLUR = "(select w / sum(w) over () as w, o from (select o, exp(-o * o / (2 * 0.9173::DOUBLE * 0.9173)) as w from range(-3, 4) a(o)))"
AUGMENTED_SQL = f"""
src as (select stem, y, x, (pred * 60) / 255.0::DOUBLE as r, (target * 60) / 255.0::DOUBLE as g, ((target + pred) * 10) / 255.0::DOUBLE as b from pn),
bright as (select stem, y, x, {_each_channel(lambda c: _clip(f"{c} * 1.1873"))} from src),
mean as (select stem, avg({GRAY.format("")}) as m from bright group by stem),
contrast as (select stem, y, x, {_each_channel(lambda c: _clip(f"m + ({c} - m) * 0.8311"))} from bright join mean using (stem)),
v0 as (select stem, y, x, {_each_channel(lambda c: _clip(f"{GRAY.format('')} + ({c} - {GRAY.format('')}) * 0.9137"))} from contrast),
v1 as (select stem, y, 31 - x as x, {_each_channel(lambda c: f"pow({c}, 1.2371) * (1 - 0.1039) + 0.1039")} from src),
hsv as (select *, greatest(r, g, b) as top, least(r, g, b) as low, greatest(greatest(r, g, b) - least(r, g, b), 1e-12) as span from src),
hue as (select *, ((case when top <= low then 0.0 when top = r then (((g - b) / span % 6) + 6) % 6 when top = g then (b - r) / span + 2 else (r - g) / span + 4 end) / 6 + 0.0371) % 1.0 * 6 as h from hsv),
v2 as (select stem, y, x, {", ".join(f"top - (top - low) * least(greatest(least((h + {k}) % 6, 4 - (h + {k}) % 6), 0), 1) as {c}" for k, c in ((5, "r"), (3, "g"), (1, "b")))} from hue),
down as (select s.stem, p.y, s.x, {_each_channel(lambda c: f"sum(w * s.{c})")} from range(24) p(y), {BLUR} k, src s where s.y = least(greatest(p.y + k.o, 0), 23) group by s.stem, p.y, s.x),
v3 as (select s.stem, s.y, p.x, {_each_channel(lambda c: f"sum(w * s.{c})")} from range(32) p(x), {BLUR} k, down s where s.x = least(greatest(p.x + k.o, 0), 31) group by s.stem, s.y, p.x),
done as ({" union all ".join(f"select stem, {k} as variant, y, x, r, g, b from {n}" for k, n in enumerate(("v0", "v1", "v2", "v3", "src")))})"""


def _augmented(spark, samples: DataFrame, variants: tuple[dict, ...]) -> DataFrame:
    plan = [(n, name, True, value) for n, ops in enumerate(variants) for name, value in ops.items()]
    plan += [(n, "horizontal_flip", False, 0.0) for n, ops in enumerate(variants) if not ops]
    ops = spark.createDataFrame(plan, "variant int, op string, applied boolean, value double")
    planned = samples.select("stem").crossJoin(F.broadcast(ops)).withColumn("variant_seed", F.col("variant"))  # a few ops
    return imagejobs.apply_augmentation(samples, planned)


@query(with_(PX, AUGMENTED_SQL) + f"select stem, variant, y::INT as y, x::INT as x, {', '.join(f'round_even({c} * 255, 0)::INT as {n}' for c, n in zip('rgb', ('red', 'green', 'blue'), strict=True))} from done")
def augmented_pixels(spark, d):
    """Every pixel of the pictures after each augmentation that is a formula."""
    root = pictures(spark, d)
    done = _augmented(spark, imagejobs.samples(files.images(spark, root + "/images"), _masks(spark, root)), VARIANTS)
    return imagejobs.rgb_rows(done)


def _base_table(quality: int) -> str:
    table = jpeg.scaled(jpeg.LUMINANCE, quality).reshape(-1).tolist()
    return f"(select spot // 8 as u, spot % 8 as w, {table}[spot + 1] as t from range(64) r(spot))"


def _jpeg_sql(quality: int, n: int) -> str:
    return f"""
src{n} as (select stem, y, x, y // 8 as br, x // 8 as bc, y % 8 as i, x % 8 as j, target * 45 + pred * 9 + (x * 7 + y * 5 + x * y + stem::INT) % 40 - 128 as v from pn),
across{n} as (select stem, br, bc, i, k as w, sum(v * c) as h from src{n} join c8 on c8.n = j group by all),
coef{n} as (select stem, br, bc, k as u, w, sum(h * c) as d from across{n} join c8 on c8.n = i group by all),
quant{n} as (select stem, br, bc, u, w, sign(d) * floor(abs(d) / t + 0.500001) * t as q from coef{n} join {_base_table(quality)} using (u, w)),
back{n} as (select stem, br, bc, u, n as j, sum(q * c) as h from quant{n} join c8 on k = w group by all),
out{n} as (select stem, {quality} as quality, (br * 8 + n)::INT as y, (bc * 8 + j)::INT as x, least(greatest(floor(sum(h * c) + 128.500001), 0), 255)::INT as value from back{n} join c8 on k = u group by stem, br, bc, n, j)"""


@query(
    with_(PX, "c8 as (select k, n, (case when k = 0 then sqrt(1 / 8.0::DOUBLE) else 0.5 end) * cos(pi() * (2 * n + 1) * k / 16.0::DOUBLE) as c from range(8) a(k), range(8) b(n))", _jpeg_sql(55, 1), _jpeg_sql(95, 2))
    + "select * from out1 union all select * from out2"
)
def jpeg_pixels(spark, d):
    """Every pixel of a gray picture for each supplier after compression at two qualities: the augmentation's step on decoded images."""
    gray = fx.pixels(spark, d).withColumn("v", (F.col("target") * 45 + F.col("pred") * 9 + (F.col("x") * 7 + F.col("y") * 5 + F.col("x") * F.col("y") + F.col("stem")) % 40).cast("int"))
    samples = dense.gray_images(gray.select(F.lpad(F.col("stem").cast("string"), 6, "0").alias("stem"), "y", "x", "v"), "v").withColumn("labels", F.col("data"))
    done = _augmented(spark, samples, ({"jpeg": 55.0}, {"jpeg": 95.0}))
    rows = imagejobs.rgb_rows(done).select("stem", F.when(F.col("variant") == 0, 55).otherwise(95).alias("quality"), "y", "x", F.col("red").alias("value"), "green", "blue")
    return rows.filter("value = green and value = blue").drop("green", "blue")


def _picture_split(spark, d) -> DataFrame:
    return _suppliers(spark, d).select("stem", F.when(F.col("s") % 3 == 0, "val").otherwise("train").alias("split"))


@query(*report_sql("select *, 0 as k from px0 where stem % 3 = 0"))
def evaluated_split(spark, d):
    """A model scored over one split, end to end: decode, score, align, report."""
    root = pictures(spark, d, "images", "masks")
    return scoring.evaluate(files.images(spark, root + "/images"), _masks(spark, root), _picture_split(spark, d), "val", _red_model, (fx.HEIGHT, fx.WIDTH))


@query(with_(PX) + PIXEL_SCORES.replace("from px", "from pn"), "pixel_accuracy obstacle_precision obstacle_recall obstacle_pixel_fpr iou_obstacle iou_water iou_sky obstacle_f1 mean_iou")
def aligned_scores(spark, d):
    """Predicted and target masks aligned pixel by pixel."""
    from tidemark.operators import metrics

    root = pictures(spark, d)
    px = scoring.aligned(_masks(spark, root), scoring.score_masks(files.images(spark, root + "/images"), _red_model, (fx.HEIGHT, fx.WIDTH)))
    return metrics.pixel_scores(metrics.confusion(px, "stem"), "stem")


@query(with_(fx.LOGITS) + "select count(*) as pixels, sum(s[1] + t[2])::DOUBLE as total, max(least(greatest(s[3], 0.25), 0.75)) as highest from lg", "total highest")
def paired_logits(spark, d):
    """Student and teacher logits from two tables, joined by pixel."""
    from tidemark.functions.vectors import clamp

    lg = fx.logits(spark, d)
    both = losses.pair_logits(lg.select("stem", "y", "x", "student"), lg.select("stem", "y", "x", F.col("teacher").alias("student")))
    return both.agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.get("student", 0) + F.get("teacher", 1)).alias("total"), F.max(clamp(F.get("student", 2), 0.25, 0.75)).alias("highest"))


@query(with_(fx.SPLIT) + "select split, count(*) as stems from split group by split")
def checked_split(spark, d):
    """Ratios are checked when the plan is built; wrong ones never reach the data."""
    for wrong in ((0.7, 0.2, 0.2), (0.0, 0.5, 0.5), (1.2, -0.1, -0.1)):
        try:
            splits.check_ratios(wrong)
        except ValueError:
            continue
        raise AssertionError(f"ratios {wrong} passed")
    return fx.split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("stems"))
