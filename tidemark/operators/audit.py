"""Set checks and balance reports over split tables. Checks return the rows that violate them: none means pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import AREA_BINS, ratio


def split_overlaps(split: DataFrame) -> DataFrame:
    """``stem, splits``: stems that several splits list."""
    return split.groupBy("stem").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def pairwise_overlap(split: DataFrame, a: str, b: str) -> DataFrame:
    """Stems in both splits."""
    side = lambda n: split.filter(F.col("split") == n).select("stem")
    return side(a).intersect(side(b))


def split_union(split: DataFrame) -> DataFrame:
    return split.select("stem").distinct()


def missing_and_extra(corpus: DataFrame, split: DataFrame) -> DataFrame:
    """``stem, problem``: corpus stems that no split lists, and listed stems that the corpus lacks."""
    have, listed = corpus.select("stem").distinct(), split_union(split)
    missing = have.join(listed, "stem", "left_anti").select("stem", F.lit("missing").alias("problem"))
    return missing.unionByName(listed.join(have, "stem", "left_anti").select("stem", F.lit("extra").alias("problem")))


def problem_samples(problems: DataFrame, limit: int = 10) -> DataFrame:
    """For each problem its count and first ``limit`` stems: each task hands on its own first ones only."""
    counts = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    first = lambda *parts: Window.partitionBy(*parts, "problem").orderBy("stem")
    some = problems.withColumn("__s", F.pmod(F.xxhash64("stem"), F.lit(1024))).withColumn("__n", F.row_number().over(first("__s"))).filter(F.col("__n") <= limit)
    some = some.withColumn("__n", F.row_number().over(first())).filter(F.col("__n") <= limit)
    return counts.join(some.groupBy("problem").agg(F.array_sort(F.collect_list("stem")).alias("examples")), "problem")


def unknown_labels(labels: DataFrame, known: tuple[int, ...] = (0, 1, 2, 4)) -> DataFrame:
    """Distinct labels outside the whitelist, with the stems' number."""
    return labels.filter(~F.col("label").isin(*known)).groupBy("label").agg(F.count_distinct("stem").alias("stems"))


def owners(members: DataFrame, split: DataFrame) -> DataFrame:
    """Each group member with its split."""
    return members.join(split, "stem", "left")


def checksum_mismatches(current: DataFrame, registered: DataFrame, key: str = "name", value: str = "sha256") -> DataFrame:
    """Names whose digests differ, or that one side lacks."""
    a = current.select(key, F.col(value).alias("current"))
    b = registered.select(key, F.col(value).alias("registered"))
    return a.join(b, key, "full_outer").filter(~F.col("current").eqNullSafe(F.col("registered")))


def class_balance(histograms: DataFrame, split: DataFrame) -> DataFrame:
    """Class pixels and their shares of each split."""
    total = F.col("obstacle") + F.col("water") + F.col("sky")
    out = histograms.join(split, "stem").groupBy("split").agg(*[F.sum(c).alias(c) for c in ("obstacle", "water", "sky")])
    return out.withColumns({f"{c}_ratio": ratio(F.col(c), total) for c in ("obstacle", "water", "sky")})


def group_sizes(members: DataFrame, split: DataFrame) -> DataFrame:
    """Number of groups of each split, and their least, largest and mean size."""
    sizes = members.join(split, "stem").groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("split").agg(
        F.count(F.lit(1)).alias("groups"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size")
    )


def largest_group(members: DataFrame, split: DataFrame) -> DataFrame:
    """The largest group (smallest id on ties), its size and split."""
    sizes = members.join(split, "stem", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("split").alias("split"))
    return sizes.orderBy(F.desc("size"), "group_id").limit(1)


def size_histogram(images: DataFrame, split: DataFrame) -> DataFrame:
    """``split, image_sizes``: a map from WxH to its number of images."""
    from tidemark.functions.paths import size_key

    counted = images.join(split, "stem").groupBy("split", size_key(F.col("width"), F.col("height")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("image_sizes"))


def dataset_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Images, groups, groups of several images, largest group, and edges of each kind before doubles are removed."""
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    left = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("images"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("size") > 1).alias("multi_image_groups"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_group"),
    )
    right = edges.agg(F.count_if(F.col("kind") == "phash").alias("phash_edges"), F.count_if(F.col("kind") == "embedding").alias("embedding_edges"))
    return left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k").drop("k")


def component_counts(components: DataFrame, split: DataFrame) -> DataFrame:
    """Target components of each split by area bin; bins without any count 0."""
    from tidemark.functions.labels import area_bin

    out = components.join(split, "stem").withColumn("bin", area_bin(F.col("area"))).groupBy("split")
    return out.agg(*[F.count_if(F.col("bin") == name).alias(name) for name, _, _ in AREA_BINS])


def balance_report(histograms: DataFrame, members: DataFrame, images: DataFrame, components: DataFrame, split: DataFrame) -> DataFrame:
    """One nested row for each split: images, groups, class balance, component counts and image sizes."""
    per_image = split.join(histograms, "stem", "left").groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    out = per_image.join(group_sizes(members, split), "split", "left").join(class_balance(histograms, split), "split", "left")
    out = out.join(component_counts(components, split), "split", "left").join(size_histogram(images, split), "split", "left")
    pick = lambda *names: F.struct(*names)
    return out.select(
        "split", "images",
        pick("groups", "min_size", "max_size", "mean_size").alias("group_sizes"),
        pick("obstacle", "water", "sky").alias("class_pixels"),
        pick("obstacle_ratio", "water_ratio", "sky_ratio").alias("class_ratios"),
        pick(*[name for name, _, _ in AREA_BINS]).alias("component_count"),
        "image_sizes",
    )
