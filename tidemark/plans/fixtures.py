"""Evaluation-shaped tables derived from the driver's tables: the same rows in Spark and, as ``SQL`` fragments, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import block_hash
from tidemark.operators.splits import random_split

HEIGHT, WIDTH = 24, 32
#: Images that a task makes the pixels of, and vectors that it hashes, about.
IMAGES, VECTORS = 250, 5000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("stem"), "embedding")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rows.repartition(-(-rows.count() // VECTORS) or 1).select("stem", block_hash(F.col("embedding")).alias("h"))


HASHES = """hashes as (select stem,
  list_sum(list_transform(range(1, 33), lambda i: case when v[i] > t then 1::BIGINT << (32 - i) else 0 end))::BIGINT as hi,
  list_sum(list_transform(range(1, 33), lambda i: case when v[i + 32] > t then 1::BIGINT << (32 - i) else 0 end))::BIGINT as lo
  from (select vec_id as stem, embedding as v, list_median(embedding[2:64]) as t from embeddings))"""


def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Four variants of each hash, with the lowest 0, 3, 6 and 9 bits flipped."""
    flips = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit((1 << (3 * v)) - 1).cast("bigint").alias("m")) for v in range(4)]))
    rows = hashes(spark, d).select("stem", "h", flips.alias("f"))
    return rows.select((F.col("stem") * 4 + F.col("f.v")).alias("stem"), F.col("h").bitwiseXOR(F.col("f.m")).alias("h"))


NEAR = HASHES + """,
near as (select stem * 4 + v as stem, hi, xor(lo, (1::BIGINT << (3 * v)) - 1) as lo from hashes, range(4) r(v))"""


def class_mix(spark: SparkSession, d: str) -> DataFrame:
    mix = lambda k: F.when(F.col("label") % 3 == k, 100).otherwise(0).cast("bigint")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("stem"), *[mix(k).alias(n) for k, n in enumerate(("obstacle", "water", "sky"))])


MIX = """mix as (select vec_id as stem, case when label % 3 = 0 then 100 else 0 end as obstacle, case when label % 3 = 1 then 100 else 0 end as water,
  case when label % 3 = 2 then 100 else 0 end as sky from embeddings)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Target and predicted label of many pixels without places."""
    flag = F.col("l_returnflag")
    target = F.when(F.col("l_linenumber") == 7, 4).when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stem"), target.alias("target"), (F.col("l_quantity").cast("int") % 3).alias("pred"))


LABELLED = """px as (select l_suppkey as stem, case when l_linenumber = 7 then 4 when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 1 else 2 end as target,
  cast(floor(l_quantity) as int) % 3 as pred from lineitem)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """A 24 x 32 image for each supplier: ``stem, y, x, target, pred``; small tables are dealt before they grow, so that a task makes some IMAGES."""
    grid = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("stem")).filter("stem is not null")
    grid = grid.repartition(-(-grid.count() // IMAGES) or 1, "stem")
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    return grid.selectExpr(
        "stem", "y", "x",
        "case when (y * 31 + x * 17 + stem) % 97 = 0 then 4 when (stem * 7 + (y div 6) * 3 + (x div 8) * 5) % 11 < 3 then 0 when y < 10 then 2 else 1 end as target",
        "case when (stem * 7 + (y div 6) * 3 + ((x + 1) div 8) * 5) % 11 < 3 and (x + y + stem) % 13 <> 0 then 0 when y < 11 then 2 else 1 end as pred",
    )


PIXELS = f"""grid as (select s_suppkey::INT as stem, y.y::INT as y, x.x::INT as x from supplier, range({HEIGHT}) y(y), range({WIDTH}) x(x)),
px as (select stem, y, x,
  case when (y * 31 + x * 17 + stem) % 97 = 0 then 4 when (stem * 7 + (y // 6) * 3 + (x // 8) * 5) % 11 < 3 then 0 when y < 10 then 2 else 1 end as target,
  case when (stem * 7 + (y // 6) * 3 + ((x + 1) // 8) * 5) % 11 < 3 and (x + y + stem) % 13 <> 0 then 0 when y < 11 then 2 else 1 end as pred from grid)"""


def logits(spark: SparkSession, d: str) -> DataFrame:
    value = lambda label: F.array(*[F.when(F.col(label) == k, 3.0).otherwise(0.0) + ((F.col("x") * k + F.col("y")) % 5) / 10 for k in range(3)])
    return pixels(spark, d).withColumns({"student": value("pred"), "teacher": value("target")})


def _logit_sql(label: str) -> str:
    return "[" + ", ".join(f"(case when {label} = {k} then 3.0 else 0.0 end + ((x * {k} + y) % 5) / 10.0)::DOUBLE" for k in range(3)) + "]"


LOGITS = PIXELS + f",\nlg as (select *, {_logit_sql('pred')} as s, {_logit_sql('target')} as t from px)"


def history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), epoch.alias("epoch"), (F.col("value") / 500).cast("double").alias("safety_score"))


HISTORY = """hist as (select cast(user_id as varchar) as run_id, row_number() over (partition by user_id order by ts, event_id)::INT as epoch,
  (value / 500)::DOUBLE as safety_score from events)"""


def stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("stem"), "text", "lang", "n_chars")


def split(spark: SparkSession, d: str) -> DataFrame:
    return random_split(stems(spark, d))


STEMS = "stems as (select lpad(cast(doc_id as varchar), 6, '0') as stem, text, lang, n_chars from documents)"


def split_sql(source: str, name: str = "split") -> str:
    return f"""{name} as (select stem, case when n <= round_even(0.7 * t, 0) then 'train' when n <= round_even(0.7 * t, 0) + round_even(0.15 * t, 0) then 'val' else 'test' end as split
  from (select stem, row_number() over (order by sha256('42:' || stem)) as n, count(*) over () as t from (select distinct stem from {source})))"""


SPLIT = STEMS + ",\n" + split_sql("stems")
