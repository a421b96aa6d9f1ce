"""Running values along an order within a key, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.shared import written


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df cut into ranges of an order, as ``_range``, and written, so that a task that runs again finds the same rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """df with a running ``sum`` or ``max`` of each value over its key's rows up to this one, or before it.

    All rows are cut into ranges along key and order, so a key with very many rows spreads over as many ranges as it fills, however close its rows stand. Totals of a
    key in a range are made with partial sums, and what earlier ranges of the key hold is carried on: only to the first key of a range, as any other
    begins in it, so what is broadcast has a row for each range at most. A null key is a key of its own.
    """
    cut = _ranged(df, [F.col(key), *order])
    whole = {"sum": F.sum, "max": F.max}
    per = cut.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(*[whole[k](c).alias(f"_{n}") for n, (k, c) in values.items()])
    earlier = W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select("_key", "_at", F.count(F.lit(1)).over(earlier).alias("_before"), *[whole[k](F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n, (k, _) in values.items()])
    carried = F.broadcast(carried.where("_before > 0").drop("_before"))
    own = W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    both = cut.join(carried, cut[key].eqNullSafe(carried["_key"]) & (cut["_range"] == carried["_at"]), "left")
    out = {}
    for n, (k, c) in values.items():
        here = whole[k](c).over(own)
        out[n] = F.greatest(here, F.col(f"_{n}")) if k == "max" else F.coalesce(here, F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0))
    return both.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """df with consecutive numbers from ``first`` along an order over all rows. Rows that are equal in it are numbered in any way.

    The table is cut into ranges of the order and written, so a task that runs again finds the same rows; each range is numbered by itself, and the
    few counts of ranges are carried along. No task orders more than its range.
    """
    cut = _ranged(df, order)
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = F.broadcast(cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", before.alias("_before")))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return cut.join(carried, "_range").withColumn(name, (own + F.col("_before") + (first - 1)).cast("long")).drop("_range", "_before")


#: Ids that one list holds at most, as a power of two.
PART_BITS = 20


def listed(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, part, n, values): the distinct ids of each key as sorted lists, one for each stretch of 2**PART_BITS ids, so that no list outgrows a row and a hot key has many tasks.

    Ids below that are all in part 0. A null id is in no list.
    """
    part = F.shiftright(F.col(value).cast("long"), PART_BITS).alias("part")
    lists = df.where(F.col(value).isNotNull()).groupBy(key, part).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return lists.select(key, "part", F.size("values").alias("n"), "values")
