"""Shared pieces of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Distinct words that a worker remembers before it forgets them all; bounds the memory of a memo.
MEMO_ENTRIES = 300_000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added while a column of that name (in any case) is there."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[list, list[str]], dict[str, object]]],
    rows: int = 512,
) -> DataFrame:
    """Run a kernel over ``(id, text)`` in slices of ``rows`` rows; null texts come as empty strings.

    ``make`` is called once a task and returns ``kernel(ids, texts) -> {column: values}``.
    """
    ship(docs.sparkSession)
    spark_schema = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    names = spark_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = kernel(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
        give_back()

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).mapInArrow(run, spark_schema)
