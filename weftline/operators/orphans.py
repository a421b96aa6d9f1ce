"""References to records that do not exist: a linear merge of references with the lives of their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.skew import all_salts, hot_keys, with_salt

#: Kinds of rows in the merged stream, in the order in which they stand at one instant. HEAD says that the key has a life at all.
HEAD, END, START, REF = -1, 0, 1, 2
#: References of one key that one task merges.
ROWS_PER_SPLIT = 100_000
#: Shares that references without a key are spread over; they meet no life.
NULL_SHARES = 1 << 16


def lives(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Life events (ref_id, at, kind): each distinct life gives a START and, unless it is open, an END; each key with a life a HEAD without time.

    A life is [start, end). Rows without key or start, and lives that end no later than they start, are never
    live and give nothing.
    """
    d = parents.select(F.col(key).cast("long").alias("ref_id"), F.col(start).alias("s"), F.col(end).alias("e")).where(
        F.col("ref_id").isNotNull() & F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s")))
    )
    none = F.lit(None).cast(d.schema["s"].dataType)
    events = F.array(*[F.struct(at.alias("at"), F.lit(kind).alias("kind")) for at, kind in ((none, HEAD), (F.col("s"), START), (F.col("e"), END))])
    # A life is one row here, so that two lives that begin or end at one instant both count.
    each = d.distinct().select("ref_id", F.explode(events).alias("x")).select("ref_id", "x.at", "x.kind")
    return each.where(F.col("at").isNotNull() | (F.col("kind") == HEAD))


def orphans(references: DataFrame, parents: DataFrame, key: str = "id", start: str = "added_at", end: str = "removed_at", rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Rows of ``references`` (ref_table, file_id, ref_id, seen_at) whose ref_id no parent row makes live at seen_at, with a ``status``.

    References and parents' life events are partitioned by key, sorted by time, and merged in one pass that
    carries the number of open lives. A key with more than ``rows_per_split`` references is split by salt, and
    its few events go to each salt. status: ``missing`` (the key has no life at all), ``late`` (its first life
    begins after seen_at), ``deleted`` (it lived before seen_at and no longer does). A null ref_id is missing;
    a null seen_at lies in no life, so it is ``late`` if the key has a life at any time and else ``missing``.
    """
    refs = references.select("ref_table", F.col("file_id").cast("long").alias("file_id"), F.col("ref_id").cast("long").alias("ref_id"), "seen_at")
    hot = hot_keys(refs, "ref_id", rows_per_split)
    spread = F.when(F.col("ref_id").isNull(), F.pmod(F.xxhash64("ref_table", "file_id", "seen_at"), F.lit(NULL_SHARES)).cast("int")).otherwise(F.col("salt"))
    left = with_salt(refs, hot, "ref_id", "file_id", "seen_at").select(
        "ref_id", spread.alias("salt"), F.col("seen_at").alias("at"), F.lit(REF).alias("kind"), "ref_table", "file_id"
    )
    right = all_salts(lives(parents, key, start, end), hot, "ref_id").select("ref_id", "salt", "at", "kind", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("file_id"))
    merged = left.unionByName(right)
    so_far = W.partitionBy("ref_id", "salt").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = {n: F.count(F.when(F.col("kind") == k, 1)).over(so_far) for n, k in (("heads", HEAD), ("started", START), ("ended", END))}
    return (
        merged.withColumns(counts)
        .where((F.col("kind") == REF) & (F.col("at").isNull() | (F.col("started") <= F.col("ended"))))
        .select("ref_table", "file_id", "ref_id", F.col("at").alias("seen_at"), F.when(F.col("heads") == 0, "missing").when(F.col("started") > 0, "deleted").otherwise("late").alias("status"))
    )


def period_of(at: str) -> Column:
    """The month of a timestamp, yyyy-MM."""
    return F.date_format(F.col(at), "yyyy-MM")


def orphan_report(found: DataFrame) -> DataFrame:
    """Per ref_table, period and status: rows, distinct keys (a null key counts as one), first and last sight."""
    pairs = found.withColumn("period", period_of("seen_at")).groupBy("ref_table", "period", "status", "ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("a"), F.max("seen_at").alias("b")
    )
    return pairs.groupBy("ref_table", "period", "status").agg(
        F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen")
    )
