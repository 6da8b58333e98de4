"""Scans and sinks: image corpora, split lists, reports, histories and masks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import file_name, relative_to, stem, suffix

# Known suffixes in order of precedence, and the names a mask may have.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
MASK_SUFFIXES = (".png", ".bmp", ".tif", ".tiff")


def file_table(spark: SparkSession, root: str, content: bool = False, recursive: bool = True) -> DataFrame:
    """``path, name, stem, ext, length[, content]`` of all files below a folder; content is only read where asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    path = F.col("path")
    return reader.load(root).select("path", file_name(path).alias("name"), stem(path).alias("stem"), suffix(path).alias("ext"), "length", *(["content"] if content else []))


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``rows(path, content)`` as files below a folder that all executors reach; tasks write, only their counts return.

    A task that runs again writes the same files again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made = set()
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "content").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def image_stems(files: DataFrame) -> DataFrame:
    """Sorted distinct stems of files with an image suffix, whatever its case."""
    return files.filter(F.lower("ext").isin(*IMAGE_SUFFIXES)).select("stem").distinct().orderBy("stem")


def ambiguous_stems(files: DataFrame) -> DataFrame:
    """Stems with several image files, for which precedence decides."""
    return files.filter(F.lower("ext").isin(*IMAGE_SUFFIXES)).groupBy("stem").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def _rank(ext: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(ext))


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``stem, image_path, mask_path`` of every image: masks named stem + m first, then stem; suffixes by precedence. No mask: null."""
    img = images.filter(F.lower("ext").isin(*IMAGE_SUFFIXES)).groupBy("stem").agg(F.min_by("path", F.struct(_rank(F.col("ext"), IMAGE_SUFFIXES), "path")).alias("image_path"))
    named = masks.filter(F.lower("ext").isin(*MASK_SUFFIXES)).select("path", "ext", F.inline(F.array(
        F.struct(F.when(F.col("stem").endswith("m"), F.expr("substring(stem, 1, length(stem) - 1)")).alias("owner"), F.lit(0).alias("way")),
        F.struct(F.col("stem").alias("owner"), F.lit(1).alias("way")),
    ))).filter("owner is not null")
    best = named.groupBy(F.col("owner").alias("stem")).agg(F.min_by("path", F.struct("way", _rank(F.col("ext"), MASK_SUFFIXES), "path")).alias("mask_path"))
    return img.join(best, "stem", "left")


def missing_masks(pairs: DataFrame) -> DataFrame:
    """Images without a mask (none, if all is well)."""
    return pairs.filter("mask_path is null").select("stem")


def attach_imu(samples: DataFrame, imus: DataFrame) -> DataFrame:
    """Samples with their IMU mask, where there is one; ``without_imu`` tells where it is required."""
    return samples.join(imus.select("stem", F.col("path").alias("imu_path")), "stem", "left")


def without_imu(samples: DataFrame) -> DataFrame:
    return samples.filter("imu_path is null").select("stem")


def images(spark: SparkSession, root: str) -> DataFrame:
    """``path, stem, height, width, channels, data`` decoded by Spark; colour is blue, green, red."""
    i = F.col("image")
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return read.select(i["origin"].alias("path"), stem(i["origin"]).alias("stem"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def relative_images(files: DataFrame, root: str) -> DataFrame:
    """Image files with their path below the root, sorted; a sequence's folder stays part of it."""
    found = files.filter(F.lower("ext").isin(*IMAGE_SUFFIXES))
    return found.withColumn("relative", relative_to(F.col("path"), root)).orderBy("relative")


def dataset_roots(files: DataFrame) -> DataFrame:
    """Folders that hold both ``images/`` and ``masks/``, smallest path first."""
    part = F.regexp_extract("path", r"^(.*)/(images|masks)/[^/]+$", 1)
    kind = F.regexp_extract("path", r"^(.*)/(images|masks)/[^/]+$", 2)
    seen = files.select(part.alias("root"), kind.alias("kind")).filter("kind <> ''").groupBy("root")
    return seen.agg(F.bool_or(F.col("kind") == "images").alias("i"), F.bool_or(F.col("kind") == "masks").alias("m")).filter("i and m").select("root").orderBy("root")


def split_lists(spark: SparkSession, root: str, raw: bool = False) -> DataFrame:
    """``split, stem`` of the text files below a folder, named by their split; blanks and # lines are left out.

    ``raw`` gives ``split, line`` with every line, as digests need them.
    """
    lines = spark.read.text(root).select(stem(F.col("_metadata.file_path")).alias("split"), F.col("value").alias("line"))
    if raw:
        return lines
    entry = F.trim(F.regexp_replace("line", r"[\r\t]", " "))
    return lines.filter((entry != "") & ~entry.startswith("#")).select("split", stem(entry).alias("stem"))


def missing_splits(lists: DataFrame, wanted: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Splits that have no list."""
    names = lists.sparkSession.createDataFrame([(w,) for w in wanted], "split string")
    return names.join(lists.select("split").distinct(), "split", "left_anti")


def write_splits(split: DataFrame, path: str, mode: str = "errorifexists", parts: int | None = None) -> None:
    """A sorted list for each split below ``split=<name>/``, in parts that follow each other by name: no task holds more than a range of it.

    ``parts`` fixes the number of ranges over all splits; otherwise it follows the session's and the rows'.
    """
    rows = split.select("split", "stem").distinct().repartitionByRange(*([parts] if parts else []), "split", "stem").sortWithinPartitions("split", "stem")
    rows.write.mode(mode).partitionBy("split").text(path)


def split_parts(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of written lists: ``split, part, lines, first_line`` (from 1) of each part in order."""
    read = spark.read.text(path).select("split", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"))
    parts = read.groupBy("split", "part").agg(F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("split").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("first_line", F.coalesce(before, F.lit(0)) + 1)


def numbered_splits(spark: SparkSession, path: str) -> DataFrame:
    """``split, stem, line_no`` of written lists: a line's number is that of its part's first line and its place in the part."""
    lines = spark.read.text(path).select("split", F.col("value").alias("stem"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"))
    place = F.row_number().over(Window.partitionBy("split", "part").orderBy("stem")) - 1  # parts are sorted
    return lines.withColumn("place", place).join(split_parts(spark, path), ["split", "part"]).select("split", "stem", (F.col("first_line") + F.col("place")).alias("line_no"))


def read_report(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents of a known schema: one to a file, or one to a line as ``write_report`` leaves them."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; what is there already is not overwritten unless ``mode`` says so."""
    report.write.mode(mode).json(path)


def _path(spark: SparkSession, path: str):
    """Hadoop's file system and path of a place."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def append_history(rows: DataFrame, path: str, batch: int) -> bool:
    """Add the rows of a numbered batch to a history once: false, and nothing changes, where that batch is there already.

    A batch is a folder that counts from when its marker is written, after its files: a job that fails in between leaves a folder that no reader sees and
    that the next try replaces.
    """
    system, marker = _path(rows.sparkSession, f"{path}/_batches/{batch}")
    if system.exists(marker):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    system.create(marker, True).close()
    return True


def read_history(spark: SparkSession, path: str, schema: T.StructType | str, keys: tuple[str, ...] = ("run_id", "epoch")) -> DataFrame:
    """One row for each run and epoch: that of the last batch which has it (the largest row, if a batch repeats one)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    system, folder = _path(spark, f"{path}/_batches")
    found = [f"{path}/batch={s.getPath().getName()}" for s in system.listStatus(folder)] if system.exists(folder) else []
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(*found)
    rest = [f.name for f in schema.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*[F.col(f.name) if f.name in keys else F.col(f"last.{f.name}").alias(f.name) for f in schema.fields])


def refuse_existing(spark: SparkSession, folder: str, names: tuple[str, ...], overwrite: bool = False) -> None:
    """Raise FileExistsError, with the names, where a run's folder holds any of its results and overwriting is not asked for."""
    found = [n for n in names if (p := _path(spark, f"{folder}/{n}"))[0].exists(p[1])]
    if found and not overwrite:
        raise FileExistsError(f"{folder} holds {', '.join(found)}: take another folder or ask for overwriting")


def write_masks(masks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Class-id masks, one folder for each sequence."""
    masks.write.mode(mode).partitionBy("sequence").parquet(path)
