"""Run histories: early stopping, best checkpoints, screening, latency and acceptance gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import fresh_name
from tidemark.functions.vectors import uniform
from tidemark.operators.ranges import places
from tidemark.session import cut

# The augmentation profiles' probabilities and ranges.
PROFILES = {
    "baseline": {
        "horizontal_flip": (0.5, 0.0, 0.0),
        "brightness": (1.0, 0.20, 0.20), "contrast": (1.0, 0.20, 0.20), "saturation": (1.0, 0.15, 0.15), "hue": (1.0, 0.03, 0.03),
        "gamma": (0.0, 1.0, 1.0), "gaussian_blur": (0.0, 0.0, 0.0), "jpeg": (0.0, 100.0, 100.0), "fog": (0.0, 0.0, 0.0), "gaussian_noise": (0.0, 0.0, 0.0),
    },
    "domain": {
        "horizontal_flip": (0.5, 0.0, 0.0),
        "brightness": (1.0, 0.30, 0.30), "contrast": (1.0, 0.30, 0.30), "saturation": (1.0, 0.20, 0.20), "hue": (1.0, 0.04, 0.04),
        "gamma": (0.25, 0.75, 1.35), "gaussian_blur": (0.20, 0.10, 1.20), "jpeg": (0.20, 55.0, 95.0), "fog": (0.15, 0.04, 0.16), "gaussian_noise": (0.20, 0.0, 0.025),
    },
}
#: What the selected checkpoint's row keeps.
BEST_COLUMNS = ("epoch", "safety_score", "mean_iou", "obstacle_f1", "small_component_recall", "boundary_f1_tol3", "false_positive_components_per_100_images")


def profile_table(spark: SparkSession) -> DataFrame:
    """``profile, op, probability, lo, hi``; jitter ops have their half-width as both ends."""
    return spark.createDataFrame([(p, op, *v) for p, ops in PROFILES.items() for op, v in ops.items()], "profile string, op string, probability double, lo double, hi double")


def with_profile(rows: DataFrame, profile_col: str = "profile") -> DataFrame:
    """One row for each op of the row's profile."""
    return rows.join(profile_table(rows.sparkSession).withColumnRenamed("profile", profile_col), profile_col)


def unknown_profiles(rows: DataFrame, profile_col: str = "profile") -> DataFrame:
    known = profile_table(rows.sparkSession).select(F.col("profile").alias(profile_col)).distinct()
    return rows.select(profile_col).distinct().join(known, profile_col, "left_anti")


def registry(raw: DataFrame) -> DataFrame:
    """A registry read with a map column ``experiments`` as one row for each experiment."""
    return raw.select(F.explode("experiments").alias("experiment_id", "e")).select("experiment_id", "e.*")


def stopping(history: DataFrame, patience: int = 0, min_delta: float = 0.0, score: str = "safety_score") -> DataFrame:
    """``run_id, best_epoch, best_score, stale, stop_epoch, epochs``: the training loop's rule as a fold over epochs.

    A score replaces the best one only where it is above it by more than ``min_delta``; the first epoch that many times
    without one stops the run (patience 0: never) and later epochs are not looked at. Null scores never improve.
    """
    if patience < 0:
        raise ValueError("patience must not be negative")
    steps = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col(score).cast("double").alias("s"))))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("stale"), F.lit(None).cast("int").alias("stop"))

    def step(state: Column, row: Column) -> Column:
        better = F.coalesce(row["s"] > state["best"] + min_delta, F.lit(False))
        stale = F.when(better, 0).otherwise(state["stale"] + 1)
        stop = F.when((F.lit(patience) > 0) & (stale >= patience), row["epoch"])
        new = F.struct(F.when(better, row["s"]).otherwise(state["best"]).alias("best"), F.when(better, row["epoch"]).otherwise(state["at"]).alias("at"), stale.alias("stale"), stop.alias("stop"))
        return F.when(state["stop"].isNotNull(), state).otherwise(new)

    folded = history.groupBy("run_id").agg(steps.alias("h")).select("run_id", F.aggregate("h", start, step).alias("s"), F.size("h").alias("epochs"))
    return folded.select("run_id", F.col("s.at").alias("best_epoch"), F.when(F.col("s.at").isNotNull(), F.col("s.best")).alias("best_score"), F.col("s.stale").alias("stale"), F.col("s.stop").alias("stop_epoch"), "epochs")


def best_checkpoints(history: DataFrame, patience: int = 0, min_delta: float = 0.0) -> DataFrame:
    """The history row that the rule selects for each run, with the reported metrics only."""
    best = stopping(history, patience, min_delta).select("run_id", F.col("best_epoch").alias("epoch"))
    kept = [c for c in BEST_COLUMNS if c in history.columns]
    return history.join(best, ["run_id", "epoch"]).select("run_id", *kept)


def screening(registry_: DataFrame, best: DataFrame, order_col: str = "registry_order") -> DataFrame:
    """Experiments with their best checkpoints and the winner marked: highest score, the first in the registry on ties."""
    both = registry_.join(best.withColumnRenamed("run_id", "experiment_id"), "experiment_id", "left")
    top = both.filter("safety_score is not null").orderBy(F.desc("safety_score"), order_col).limit(1).select("experiment_id", F.lit(True).alias("winner"))
    return both.join(top, "experiment_id", "left").withColumn("winner", F.coalesce("winner", F.lit(False)))


def wrong_splits(used: DataFrame, allowed: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Rows that use a split which selection must not see."""
    return used.filter(~F.col("split").isin(*allowed))


def run_config(runs: DataFrame, **constants) -> DataFrame:
    """A run table with the protocol's constants as one struct column."""
    return runs.withColumn("protocol", F.struct(*[F.lit(v).alias(k) for k, v in sorted(constants.items())]))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Mean loss of each run's epochs."""
    return batches.groupBy("run_id", "epoch").agg(F.avg("loss").alias("train_loss"))


def cosine_rate(epoch: Column, base: float, epochs: int) -> Column:
    """Learning rate after ``epoch`` steps of cosine annealing to 0."""
    return F.lit(base) / 2 * (1 + F.cos(F.pi() * epoch / max(epochs, 1)))


def latency(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """``run_id, n, mean_ms, p50_ms, p95_ms, fps``; percentiles interpolate, or are sketched where the samples are many."""
    share = (lambda p: F.percentile_approx("ms", p, 10_000)) if approximate else (lambda p: F.percentile("ms", p))
    return samples.groupBy("run_id").agg(
        F.count("ms").alias("n"), F.avg("ms").alias("mean_ms"), share(0.5).alias("p50_ms"), share(0.95).alias("p95_ms"), (1000 / F.avg("ms")).alias("fps")
    )


def side_by_side(scores: DataFrame, official: DataFrame, modes: tuple[str, ...] = ("stretch", "letterbox", "center_crop")) -> DataFrame:
    """One row an image: a value for each geometry mode, and the official result where there is one."""
    wide = scores.groupBy("stem").pivot("mode", list(modes)).agg(F.first("value"))
    return wide.join(official.select("stem", F.col("value").alias("official")), "stem", "left").withColumn("official_mask_available", F.col("official").isNotNull())


def placed(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Adds each row's place (from 1) in an order, without one window over all rows."""
    return places(rows, [order], out)


def pages(rows: DataFrame, size: int, order: str = "stem") -> DataFrame:
    """Adds ``sheet`` and ``slot`` (from 1): rows in order, ``size`` to a sheet."""
    at = fresh_name("at", [*rows.columns, "sheet", "slot"])
    return places(rows, [order], at, start=0).withColumns({"sheet": F.floor(F.col(at) / size) + 1, "slot": F.col(at) % size + 1}).drop(at)


def first_rows(lines: DataFrame, split: DataFrame, name: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of a split, in file order: ``lines(stem, line_no)``."""
    return lines.join(split.filter(F.col("split") == name).select("stem"), "stem", "left_semi").orderBy("line_no").limit(limit)


def batches(stems: DataFrame, size: int, epoch: int, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """``stem, place, batch`` (from 1) of a shuffled epoch; an incomplete last batch is left out."""
    from tidemark.operators.splits import ranked, seeded

    rows = ranked(stems.select("stem"), seeded(seed * 1_000_003 + epoch, F.col("stem")), "place")
    rows = rows.withColumn("batch", F.floor((F.col("place") - 1) / size) + 1)
    return rows.filter(F.col("batch") <= stems.count() // size) if drop_last else rows


def variants(stems: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``stem, sample_index, variant, variant_seed``: ``seed + 1000 * sample_index + variant`` over the ordered stems."""
    placed = places(stems.select("stem"), ["stem"], "sample_index", start=0)
    out = placed.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.withColumn("variant_seed", F.lit(seed) + 1000 * F.col("sample_index") + F.col("variant"))


def augmentation_plan(variants_: DataFrame, profile: str) -> DataFrame:
    """``stem, variant, op, applied, value``: what each op does to each variant, from the variant's seed alone."""
    if profile not in PROFILES:
        raise ValueError(f"unknown augmentation profile: {profile}")
    ops = profile_table(variants_.sparkSession).filter(F.col("profile") == profile)
    rows = variants_.withColumn("profile", F.lit(profile)).join(ops, "profile")
    draw = lambda what: uniform(0, F.lit(what), F.col("variant_seed"), F.col("op"))
    jitter = F.col("op").isin("brightness", "contrast", "saturation", "hue")
    centre = F.when(F.col("op") == "hue", 0.0).otherwise(1.0)
    value = F.when(jitter, centre + (2 * draw("value") - 1) * F.col("lo")).otherwise(F.col("lo") + draw("value") * (F.col("hi") - F.col("lo")))
    return rows.select("stem", "variant", "variant_seed", "op", (draw("apply") < F.col("probability")).alias("applied"), value.alias("value"))


def over_seeds(results: DataFrame, *metrics: str) -> DataFrame:
    """Mean and sample deviation of metrics over an experiment's seeds."""
    return results.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("seeds"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def bootstrap(per_unit: DataFrame, num: str, den: str, unit: str = "stem", replicates: int = 200, seed: int = 42) -> DataFrame:
    """``estimate, low, high``: a ratio of sums with its 95 % interval; units (images or clips) weigh in by a Poisson draw a replicate.

    Draws depend on the seed, the unit and the replicate alone, so that no resampled table is made; a task adds up one vector of ``replicates`` weighted
    sums over its units, and those vectors are all that is shuffled.
    """
    per = cut(per_unit.groupBy(unit).agg(F.sum(num).cast("double").alias("n"), F.sum(den).cast("double").alias("d")), "units")
    total, steps = 0.0, []
    for k in range(12):  # Poisson(1) by its distribution function
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    draws = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: uniform(seed, F.col(unit), r))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((replicates, 2))
        for batch in batches:
            u = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, replicates)
            weights = np.searchsorted(steps, u, side="right").astype(float)
            sums += weights.T @ np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["r", "n", "d"])

    whole = per.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "d")], draws.alias("u")).mapInArrow(summed, "r bigint, n double, d double")
    sums = whole.groupBy("r").agg((F.sum("n") / F.greatest(F.sum("d"), F.lit(1.0))).alias("v"))
    point = per.agg((F.sum("n") / F.greatest(F.sum("d"), F.lit(1.0))).alias("estimate")).withColumn("k", F.lit(1))
    return point.join(sums.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high")).withColumn("k", F.lit(1)), "k").drop("k")


def teacher_gate(teacher: DataFrame, student: DataFrame, gain: float = 0.005, more_fp: float = 5.0) -> DataFrame:
    """Teachers that may teach: score at least the student's plus ``gain``, false positives at most ``more_fp`` above."""
    rows = student.select(F.col("safety_score").cast("double"), F.col("fp").cast("double")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the student is one row")
    out = teacher.withColumns({"s_score": F.lit(rows[0][0]), "s_fp": F.lit(rows[0][1])})
    return out.withColumn("accepted", (F.col("safety_score") >= F.col("s_score") + gain) & (F.col("fp") <= F.col("s_fp") + more_fp))


def non_inferior(quantised: DataFrame, full: DataFrame, drop: float = 0.02, fp: float = 5.0, fp_share: float = 0.1) -> DataFrame:
    """Quantised runs whose score drops at most ``drop`` and whose false positives rise at most ``max(fp, fp_share of the full run's)``."""
    f = full.select("run_id", F.col("safety_score").alias("f_score"), F.col("fp").alias("f_fp"))
    rise = F.greatest(F.lit(fp), fp_share * F.col("f_fp"))
    return quantised.join(f, "run_id").withColumn("accepted", (F.col("safety_score") >= F.col("f_score") - drop) & (F.col("fp") - F.col("f_fp") <= rise))


def parity(pairs: DataFrame, a: str = "student", b: str = "teacher", error: float = 1e-4, agree: float = 0.9999) -> DataFrame:
    """Largest logit difference, share of equal classes, and whether both meet the target."""
    from tidemark.functions.vectors import argmax

    far = F.array_max(F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    out = pairs.agg(F.max(far).alias("max_error"), F.avg((argmax(F.col(a)) == argmax(F.col(b))).cast("double")).alias("agreement"))
    return out.withColumn("passed", (F.col("max_error") <= error) & (F.col("agreement") >= agree))


def macro_recall(outcomes: DataFrame) -> DataFrame:
    """Mean over sequences of each sequence's recall: ``outcomes(sequence, recalled, total)``."""
    per = outcomes.groupBy("sequence").agg((F.sum("recalled") / F.greatest(F.sum("total"), F.lit(1))).alias("recall"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.avg("recall").alias("macro_recall"))


def domain_gap(results: DataFrame, metric: str) -> DataFrame:
    """In-domain and external value of a metric for each run, and their difference."""
    wide = results.groupBy("run_id").pivot("domain", ["internal", "external"]).agg(F.avg(metric))
    return wide.withColumn("gap", F.col("internal") - F.col("external"))
