"""Path and text-line expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last dot and what follows, as written; empty without one (a leading dot is no suffix)."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def relative_to(path: Column, base: str) -> Column:
    """The path below ``base`` (with or without a scheme); a path outside it is left as it is."""
    bare, root = F.regexp_replace(path, r"^file:/+", "/"), base.removeprefix("file://").rstrip("/") + "/"
    return F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 30)).otherwise(path)


def size_key(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
