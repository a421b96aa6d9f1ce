"""Merging partial results of workers: sums, flags, bags, sets and first-wins maps, each combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import numbered


def merge_counters(parts: DataFrame) -> DataFrame:
    """Per transform: rows, summed n, and whether any part set its flag."""
    return parts.groupBy("transform").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("total"), F.bool_or("flag").alias("any_flag"))


def merge_bags(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_sets(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Set union of the rows over some columns."""
    return parts.select(*columns).distinct()


def first_wins(parts: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values that arrived first for each key, by ascending ``order`` (null is last); ties go to the smallest values."""
    rank = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), *values)
    return parts.groupBy(*keys).agg(F.min(rank).alias("x")).select(*keys, *[F.col("x")[v].alias(v) for v in values])


def last_wins(parts: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values that arrived last for each key."""
    return parts.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("x")).select(*keys, *[F.col("x")[v].alias(v) for v in values])


def dedup_edits(edits: DataFrame) -> DataFrame:
    """Distinct edits by file, start, lines replaced and text."""
    return edits.select("file_id", "start_line", "lines_replaced", "replacement_text").distinct()


def min_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The least value of each key."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def chunk_size(n_rows: int, per_chunk: int, workers: int) -> int:
    """The greatest size of at most ``per_chunk`` that fills as many whole chunks as there are workers; 1 if none does."""
    return max(1, min(per_chunk, n_rows // max(1, workers)))


def chunk_groups(df: DataFrame, key: str, per_chunk: int, workers: int) -> DataFrame:
    """(key, chunk): consecutive rows of the list in order of key, chunks numbered from 0; the last may be smaller. Null keys come first."""
    n = df.count()
    return numbered(df.select(key), [F.col(key)], "number", 0).select(key, F.floor(F.col("number") / chunk_size(n, per_chunk, workers)).alias("chunk"))
