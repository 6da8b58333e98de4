"""Blocks for similarity joins: no task gets more than a bounded part of a hot key's pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.forest import Forest  # noqa: F401  (its users import it from here)
from tidemark.session import cut, ship


def tiled(rows: DataFrame, key: str, salt: Column, most: int) -> DataFrame:
    """Adds ``tile, ta, tb``: rows of a key with over ``most`` rows are dealt to tiles, and each row goes to every pair of tiles that holds its own.

    All pairs of a key's rows meet in exactly one (key, ta, tb), of at most about twice ``most`` rows; a pair of
    different tiles compares across them only. Keys of ordinary size keep one tile and one copy.
    """
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most), "hot-keys")
    if hot.isEmpty():
        return rows.withColumns({"tile": F.lit(0), "ta": F.lit(0), "tb": F.lit(0)})
    tiles = F.coalesce(F.ceil(F.col("__n") / most), F.lit(1)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__t", tiles)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(salt), F.col("__t")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.expr("sequence(0, __t - 1)")))
    return dealt.withColumns({"ta": F.least("tile", "__o"), "tb": F.greatest("tile", "__o")}).drop("__n", "__t", "__o")


def map_groups(rows: DataFrame, key: list[str], schema: str, kernel: Callable[[dict[str, np.ndarray]], dict], least: int = 200_000) -> DataFrame:
    """Deal rows by ``key``, sort, and run ``kernel`` over runs of whole groups (many small groups at a time).

    ``kernel`` gets the columns as arrays, with ``__group`` numbering the groups in order, and returns columns.
    Unlike a grouped pandas call it costs nothing for each group.
    """
    ship(rows.sparkSession)
    spark_schema = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(spark_schema)
    fields = rows.columns

    def work(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        columns = {n: table.column(n).to_numpy() if not pa.types.is_list(table.schema.field(n).type) else table.column(n) for n in fields}
        out = kernel({**columns, "__group": group})
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for n in key:
            v = table.column(n).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, full = 0, least
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= full:
                table = pa.Table.from_batches(held)
                group = numbered(table)
                ends = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if ends:
                    yield work(table.slice(0, ends), group[:ends])
                    table = table.slice(ends)
                held, size = table.to_batches(), table.num_rows
                full = size + least
        if size:
            table = pa.Table.from_batches(held)
            yield work(table, numbered(table))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, spark_schema)
