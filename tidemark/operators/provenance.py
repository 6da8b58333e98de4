"""Content digests of files, split lists and whole datasets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.columns import fresh_name
from tidemark.session import ship


def file_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``sha256`` of the content; files are hashed where they are read."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def hash_blocks(blocks: DataFrame, key: str, order: list[str], text: str, between: bytes = b"") -> DataFrame:
    """``key, sha256`` over a key's blocks of text in their order, with ``between`` between two blocks.

    A task reads its sorted blocks batch by batch and keeps one hash state: memory does not grow with a key's text.
    """
    ship(blocks.sparkSession)
    out = T.StructType([T.StructField(key, blocks.schema[key].dataType), T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=arrow.field(k).type) for k in range(2)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            for owner, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or owner != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = owner, hashlib.sha256()
                else:
                    state.update(between)
                state.update(block.encode())
            if done:
                yield flush()
        if state is not None:
            done.append((now, state.hexdigest()))
            yield flush()

    return blocks.repartition(key).sortWithinPartitions(key, *order).select(key, text).mapInArrow(run, out)


def ordered_blocks(rows: DataFrame, key: str, order: list[str], text: str, size: int = 1 << 20) -> DataFrame:
    """``key, part, seq, block`` (with underscores where the key has such a name): the texts of each key, in order, joined to blocks of about ``size`` characters.

    Rows are sorted in ranges of (key, order), many tasks to a large key; blocks are made as the rows stream by.
    """
    ship(rows.sparkSession)
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), *[T.StructField(fresh_name(n, [key]), k()) for n, k in (("part", T.IntegerType), ("seq", T.LongType), ("block", T.StringType))]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, held, chars = TaskContext.get().partitionId(), 0, None, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=arrow.field(k).type) for k, v in enumerate((now, part, seq, "".join(held)))], schema=arrow)

        for batch in batches:
            for owner, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (owner != now or chars >= size):
                    yield block()
                    seq, held, chars = seq + 1, [], 0
                now = owner
                held.append(line)
                chars += len(line)
        if held:
            yield block()

    there = rows.filter(F.col(text).isNotNull())
    return there.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, text).mapInArrow(run, out)


def ordered_digests(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """``key, sha256`` of each key's texts joined in order; no value, task or group holds a key's text whole."""
    blocks = ordered_blocks(rows, key, order, text)
    _, part, seq, block = blocks.columns
    return hash_blocks(blocks, key, [part, seq], block)


def split_digests(lines: DataFrame, ordered: str | None = None) -> DataFrame:
    """``split, sha256`` of each list's entries: stripped, blank ones left out, joined by newlines, with one at the end.

    ``ordered`` names a column with the file's order; without it entries are taken in sorted order, as they are written. A split may hold any share of
    all stems: its sorted parts stream through one hash state.
    """
    entry = F.trim(F.regexp_replace("line", r"[\r\n\t]", " "))
    order = fresh_name("order", ["split", "entry", "line_end"])
    rows = lines.select("split", entry.alias("entry"), (F.col(ordered) if ordered else entry).alias(order)).filter("entry <> ''")
    return ordered_digests(rows.withColumn("line_end", F.concat("entry", F.lit("\n"))), "split", [order, "entry"], "line_end")


def _manifest_line():
    return F.concat("stem", F.lit("\0image\0"), "image_sha256", F.lit("\0mask\0"), "mask_sha256", F.lit("\n"))


def manifest_digest(pairs: DataFrame) -> DataFrame:
    """``sha256`` over one line for each ``(stem, image_sha256, mask_sha256)`` in order of stem, in one pass of bounded memory over sorted parts.

    A sequential digest is one task's work at the end (it only reads blocks and hashes them). ``merkle_digest`` has no such task and is the one to
    register for new datasets; this one equals digests that were registered line by line.
    """
    lines = pairs.select(F.lit(0).alias("all"), "stem", _manifest_line().alias("line"))
    one = ordered_digests(lines, "all", ["stem", "line"], "line").select("sha256")
    empty = pairs.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("none"))
    return empty.join(one, F.lit(True), "left").select(F.coalesce("sha256", "none").alias("sha256"))


def merkle_digest(pairs: DataFrame, buckets: int = 4096) -> DataFrame:
    """Another digest of the same lines that no task sees whole: of the digests of ``buckets`` parts, by a hash of the stem; parts stream through their hash."""
    part = F.conv(F.substring(F.sha2("stem", 256), 1, 8), 16, 10).cast("bigint") % buckets
    lines = pairs.select(part.alias("part"), "stem", _manifest_line().alias("line"))
    parts = ordered_digests(lines, "part", ["stem", "line"], "line").withColumnRenamed("sha256", "d")
    tops = F.array_sort(F.collect_list(F.struct("part", "d")))
    return parts.agg(F.sha2(F.array_join(F.transform(tops, lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["d"])), "\n"), 256).alias("merkle_sha256"))


def registration(current: DataFrame, registered: DataFrame | None) -> DataFrame:
    """``name, current, registered, status``: match, mismatch, missing (registered only) or unregistered.

    Registration is optional: without a registered table all names are unregistered.
    """
    if registered is None:
        return current.select("name", F.col("sha256").alias("current"), F.lit(None).cast("string").alias("registered"), F.lit("unregistered").alias("status"))
    both = current.select("name", F.col("sha256").alias("current")).join(registered.select("name", F.col("sha256").alias("registered")), "name", "full_outer")
    status = F.when(F.col("current").isNull(), "missing").when(F.col("registered").isNull(), "unregistered").when(F.col("current") == F.col("registered"), "match").otherwise("mismatch")
    return both.withColumn("status", status)


def artifact_gate(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Model files whose digest is not the expected one: ``name, sha256, expected``."""
    return files.join(expected.withColumnRenamed("sha256", "expected"), "name").filter(~F.col("sha256").eqNullSafe(F.col("expected")))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``line_no`` (from 1) within each file, for lists small enough for one window a file."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("split").orderBy("at")))
