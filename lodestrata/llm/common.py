"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import bounded, slices
from ..sources.store import discard, shared_dir, stored, swept

__all__ = ["bounded", "discard", "free_name", "held_out", "shared_dir", "slices", "stored", "swept", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(frame: DataFrame, name: str) -> str:
    """name, or the name with underscores before it, such that frame has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: str = "text") -> F.Column:
    """The text as bytes, empty for null: Python then needs no decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the decimal id has the remainder 2 by 7; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))
