"""Hot keys: candidates from every input split, and salts.

Plain joins need none of this: adaptive execution splits a long partition of a join. Salts are for windows and groups, which it can't split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import written

#: Distinct keys that a split's summary holds; a key is undercounted by at most one in so many rows of its split.
SUMMARY = 1 << 20
#: Hot keys up to this number are broadcast, some 30 MB; beyond it they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _summaries(batches: Iterator[pa.RecordBatch], most: int = SUMMARY) -> Iterator[pa.RecordBatch]:
    """Of one split: each key that it holds twice or more with a count (at most ``most`` keys), and one row of null and the split's rows.

    Beyond ``most`` keys the least of the counts that stay is taken off all and keys at zero go, so a key loses less than rows / most.
    """
    total, have = 0, None

    def fold(table: pa.Table) -> pa.Table:
        out = table.group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])
        if out.num_rows > most:
            n = out["n"].to_numpy()
            less = pa.array(n - np.partition(n, len(n) - most - 1)[len(n) - most - 1])
            out = pa.table({"k": out["k"], "n": less}).filter(pc.greater(less, 0))
        return out

    for b in batches:
        total += b.num_rows
        keys = b.column(0).drop_null()
        part = pa.table({"k": keys, "n": pa.array(np.ones(len(keys), np.int64))})
        have = part if have is None else pa.concat_tables([have, part])
        if have.num_rows > 2 * most:
            have = fold(have)
    if have is None:
        return
    have = fold(have)
    have = have.filter(pc.greater(have["n"], 1)).combine_chunks()
    kind = have.schema.field("k").type
    for b in have.to_batches():
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["k", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([total], pa.int64())], names=["k", "n"])


def hot_keys(df: DataFrame, key: str, rows_per_split: int) -> DataFrame:
    """(key, salts) of every non-null key with more rows than one task should hold; written, with the attribute ``few``.

    Every split sums up its keys and passes on those it holds at least twice, so nearly distinct keys cost no second shuffle. A
    key's sum falls short of its rows by at most one a split and one in SUMMARY rows. The threshold is ``rows_per_split``, or
    twice that shortfall where it is more (some 2 to 4 million rows at a million splits), so that every key above the threshold comes out and
    none below half of it; it doesn't grow with the share of a key. ``few`` says whether the keys may be broadcast. An empty input gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    parts = written(df.select(F.col(key).alias("k")).mapInArrow(_summaries, f"k {kind}, n long"), "summaries", {
        "rows": F.sum(F.when(F.col("k").isNull(), F.col("n"))), "splits": F.count_if(F.col("k").isNull())
    })
    rows, splits = parts.observed["rows"] or 0, parts.observed["splits"] or 0
    short = splits + rows // SUMMARY
    least = max(rows_per_split, 2 * short)
    if rows <= least:
        out = df.sparkSession.createDataFrame([], f"{key} {kind}, salts long")
        out.few = True
        return out
    sums = parts.where(F.col("k").isNotNull()).groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least - short)
    out = written(sums.select(F.col("k").alias(key), F.ceil((F.col("n") + short) / rows_per_split).cast("long").alias("salts")), "hot", {"n": F.count(F.lit(1))})
    out.few = out.observed["n"] <= BROADCAST_KEYS
    return out


def hinted(hot: DataFrame) -> DataFrame:
    """The hot keys as a side of a join: broadcast if they are few, else by a merge join, whose long partitions adaptive execution splits."""
    return F.broadcast(hot) if getattr(hot, "few", False) else hot.hint("merge")


def salt_of(salts: Column, *by: Column) -> Column:
    """A salt that depends on the row alone, so a task that runs again gives the same one."""
    return F.when(salts.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), salts)).cast("int")


def with_salt(df: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """df with a column ``salt``: 0 for ordinary keys, one of the key's salts for a hot key."""
    return df.join(hinted(hot), key, "left").withColumn("salt", salt_of(F.col("salts"), *[F.col(c) for c in by])).drop("salts")


def all_salts(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """df with a row for each salt of its key: the other side of a salted merge."""
    return df.join(hinted(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.coalesce("salts", F.lit(1)) - 1).cast("int")))).drop("salts")
