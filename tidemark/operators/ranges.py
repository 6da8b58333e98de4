"""Places of rows in an order, without one window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import fresh_name
from tidemark.session import cut


def places(rows: DataFrame, order: Sequence[str | Column], out: str = "place", within: Sequence[str] = (), start: int = 1) -> DataFrame:
    """Adds each row's place (from ``start``, gapless) in an order, for each value of ``within`` if given.

    Rows go to ranges of the order, equal rows too, so that neither a large key nor many equal rows meet in one task; a place is the
    count of the key's rows in earlier ranges plus the place inside the range. Null keys are a key; equal rows get places in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    tie, part, inside, before, key = (fresh_name(n, [*rows.columns, out]) for n in ("tie", "part", "inside", "before", "of"))
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).withColumn(part, F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    earlier = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*within, part).agg(F.count(F.lit(1)).alias(inside))
    counts = counts.select(*[F.col(w).alias(f"{key}{n}") for n, w in enumerate(within)], F.col(part).alias(key), F.coalesce(F.sum(inside).over(earlier), F.lit(0)).alias(before))
    own = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(*within, part).orderBy(*order, tie)))
    same = F.col(part) == F.col(key)
    for n, w in enumerate(within):
        left, right = F.col(w), F.col(f"{key}{n}")
        same &= left.eqNullSafe(right) if rows.schema[w].nullable else left == right
    joined = own.join(counts, same)
    return joined.select(*rows.columns, (F.col(before) + F.col(inside) + (start - 1)).cast("long").alias(out))
