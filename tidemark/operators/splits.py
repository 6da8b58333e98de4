"""Deterministic random splits, and grouped, class-balanced ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import fresh_name
from tidemark.operators.ranges import places
from tidemark.session import cut

NAMES = ("train", "val", "test")
# Weights of class error and of overflow beside the fill of a split.
CLASS_ERROR_WEIGHT, OVERFLOW_WEIGHT = 0.02, 5.0
#: Scores that agree to so many digits are equal, and the first split wins.
SCORE_DIGITS = 9
#: Class shares are told apart in so many steps.
MIX_STEPS = 10


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("three positive ratios that sum to 1 are needed")


def seeded(seed: int, key: Column) -> Column:
    """An order that depends on the seed and the key alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ranked(rows: DataFrame, order: Column, out: str = "rank", buckets: int = 4096) -> DataFrame:
    """Adds each row's place (from 1) in an order of hexadecimal digests without one global window.

    Rows are counted by the digest's first digits; a row's place is the count of all lower buckets (at most ``buckets`` rows
    are summed in one window) plus its place in its own.
    """
    digits = max(1, min(3, len(f"{buckets:x}") - 1))
    o, b, n, before, i = (fresh_name(c, [*rows.columns, out]) for c in ("o", "b", "n", "before", "i"))
    keyed = rows.withColumns({o: order, b: F.substring(order, 1, digits)})
    sizes = keyed.groupBy(b).agg(F.count(F.lit(1)).alias(n))
    earlier = F.coalesce(F.sum(n).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(b).orderBy(o))
    joined = keyed.withColumn(i, inside).join(sizes.select(b, earlier.alias(before)), b)
    return joined.select(*rows.columns, (F.col(before) + F.col(i)).alias(out))


def ranked_within(rows: DataFrame, key: str, order: Column, out: str = "rank") -> DataFrame:
    """Each row's place (from 1) within its key, in an order of hexadecimal digests; a key of many rows is no single window.

    As ``ranked``: counts by the digest's first three digits, and places inside those.
    """
    o, b, n, before, i = (fresh_name(c, [*rows.columns, out]) for c in ("o", "b", "n", "before", "i"))
    keyed = rows.withColumns({o: order, b: F.substring(order, 1, 3)})
    sizes = keyed.groupBy(key, b).agg(F.count(F.lit(1)).alias(n))
    earlier = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(key, b).orderBy(o))
    joined = keyed.withColumn(i, inside).join(sizes.select(key, b, earlier.alias(before)), [key, b])
    return joined.select(*rows.columns, (F.col(before) + F.col(i)).alias(out))


def random_split(stems: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, id_col: str = "stem") -> DataFrame:
    """``stem, split`` with exact quotas: train and val get their share of the distinct stems rounded half to even, test the rest."""
    check_ratios(ratios)
    ids = stems.select(F.col(id_col).alias("stem")).filter("stem is not null").distinct()
    total = ids.count()
    train, val = round(total * ratios[0]), round(total * ratios[1])
    place = F.when(F.col("rank") <= train, NAMES[0]).when(F.col("rank") <= train + val, NAMES[1]).otherwise(NAMES[2])
    return ranked(ids, seeded(seed, F.col("stem"))).select("stem", place.alias("split"))


def group_summaries(members: DataFrame, histograms: DataFrame, seed: int = 42) -> DataFrame:
    """``group_id, size, obstacle, water, sky, tie``: sizes and class pixels of every group, with a seeded tie-break."""
    joined = members.join(histograms, "stem", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("obstacle", "water", "sky")]
    out = joined.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), *sums)
    return out.withColumn("tie", seeded(seed, F.col("group_id")))


class SplitFill:
    """Images and class pixels that each split holds so far, and the score of giving it more."""

    def __init__(self, total: int, classes: list[float], ratios: tuple[float, float, float]):
        self.total, self.ratios = total, ratios
        self.wanted = [[c * r for c in classes] for r in ratios]
        self.images, self.pixels = [0, 0, 0], [[0.0] * 3 for _ in range(3)]

    def score(self, k: int, x: int, size: int, mix: list[float]) -> float:
        """Score of split ``k`` once it has ``x`` more groups of one size and mix: fill, class error, overflow."""
        target, images = self.ratios[k] * self.total, self.images[k] + x * size
        error = sum(((p + x * m - w) / w) ** 2 for p, m, w in zip(self.pixels[k], mix, self.wanted[k], strict=True)) / 3
        return round((images + OVERFLOW_WEIGHT * max(images - target, 0.0)) / max(target, 1.0) + CLASS_ERROR_WEIGHT * error, SCORE_DIGITS)

    def place(self, n: int, size: int, mix: list[float]) -> list[int]:
        """How many of ``n`` groups of one size and mix each split gets, as if they came one by one, each to the split of the least score.

        A split's scores are convex in what it has got, so that it is served until its score passes the others': one by one is the same as taking
        the n smallest of all splits' scores (each as high as the first at least), and that level is found by bisection, whatever n.
        """

        def reach(k: int, level: float, equal: bool) -> int:
            """Groups that split ``k`` takes while its scores are below the level (or equal to it)."""
            inside = lambda x: (v := self.score(k, x, size, mix)) < level or (equal and v == level)
            if not n or not inside(1):
                return 0
            low, high = 1, n
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if inside(middle) else (low, middle - 1)
            return low

        def before(k: int, x: int) -> int:
            """Groups placed up to and with the x-th of split ``k``."""
            level = max(self.score(k, 1, size, mix), self.score(k, x, size, mix))
            return x + sum(reach(j, level, j < k) for j in range(3) if j != k)

        out = []
        for k in range(3):
            low, high = 0, n
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if before(k, middle) <= n else (low, middle - 1)
            out.append(low)
        for k, x in enumerate(out):
            self.images[k] += x * size
            self.pixels[k] = [p + x * m for p, m in zip(self.pixels[k], mix, strict=True)]
        return out


def mix_cell(*classes: Column) -> Column:
    """Number of a group's class mix: the shares of the first two classes in tenths (0 without pixels)."""
    total = sum(classes[1:], classes[0])
    tenth = lambda c: F.floor(c * MIX_STEPS / total)
    return F.when(total > 0, tenth(classes[0]) * (MIX_STEPS + 1) + tenth(classes[1])).otherwise(0).cast("long")


def _dealt(place: Column, n: Column, first: Column, second: Column) -> Column:
    """Split of the ``place``-th (from 0) of ``n`` rows of which ``first`` and ``second`` go to the first two splits, each evenly spread over the order."""
    wide = lambda c: c.cast("decimal(19,0)")
    exact = lambda p, x, m: F.call_function("div", wide(p) * wide(x), wide(F.greatest(m, F.lit(1)))).cast("long")
    train = exact(place + 1, first, n) > exact(place, first, n)
    later = place - exact(place, first, n)
    val = exact(later + 1, second, n - first) > exact(later, second, n - first)
    return F.when(train, NAMES[0]).when(val, NAMES[1]).otherwise(NAMES[2])


def grouped_split(members: DataFrame, histograms: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``stem, split`` that never parts a group: ``members(stem, group_id)``, ``histograms(stem, obstacle, water, sky)``.

    Groups of one size are placed together, largest size first, in one step (``SplitFill.place``) that counts what placing them one by one, at their mean
    mix, would give each split; a group of a size of its own is placed by its own mix. The counts of a size are then dealt evenly over its groups in an order of class mix and
    seeded digests, so that each split gets each mix in proportion. Only counts of sizes reach the driver: as sizes add up to the number of images N, there are
    at most as many as the root of 2 N.
    """
    check_ratios(ratios)
    spark = members.sparkSession
    names = ("obstacle", "water", "sky")
    summary = cut(group_summaries(members, histograms, seed).withColumn("mix", mix_cell(*map(F.col, names))), "groups")
    sizes = summary.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    if not sizes:
        return members.select("stem", F.lit(None).cast("string").alias("split"))
    sizes.sort(key=lambda r: -r["size"])
    classes = [float(max(sum(r[c] for r in sizes), 1)) for c in names]
    fill = SplitFill(sum(r["size"] * r["n"] for r in sizes), classes, ratios)
    quotas = [(r["size"], r["n"], *fill.place(r["n"], r["size"], [r[c] / r["n"] for c in names])[:2]) for r in sizes]
    table = spark.createDataFrame(quotas, "size long, n long, first long, second long")
    ranked_ = places(summary.select("group_id", "size", "mix", "tie"), ["size", "mix", "tie", "group_id"], "place", within=["size"], start=0)
    placed = ranked_.join(table, "size").select("group_id", _dealt(F.col("place"), F.col("n"), F.col("first"), F.col("second")).alias("split"))
    return members.join(placed, "group_id").select("stem", "split")


def impure_groups(members: DataFrame, split: DataFrame) -> DataFrame:
    """Groups whose members are in more than one split (none, if all is well)."""
    return members.join(split, "stem").groupBy("group_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def duplicate_stems(split: DataFrame) -> DataFrame:
    """Stems that a split lists more than once."""
    return split.groupBy("split", "stem").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def in_split(rows: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Rows whose stem is in the named split."""
    return rows.join(split.filter(F.col("split") == name).select("stem"), "stem", "left_semi")
