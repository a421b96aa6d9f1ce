"""Change detection between a stored and a current snapshot of units (id, ts, args) and relations (file_id, dep_id, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_units(now: DataFrame, old: DataFrame) -> DataFrame:
    """Ids that the store lacks."""
    return now.select("id").join(old.select("id"), "id", "left_anti")


def _both(now: DataFrame, old: DataFrame) -> DataFrame:
    return now.select("id").join(old.select("id"), "id", "left_semi")


def dep_ts_mismatch(now: DataFrame, old: DataFrame, rel_now: DataFrame, rel_old: DataFrame) -> DataFrame:
    """Units in both snapshots with a stored dependency that has no equal (dependency, timestamp) now."""
    gone = rel_old.join(rel_now, ["file_id", "dep_id", "ts"], "left_anti").select(F.col("file_id").alias("id")).distinct()
    return _both(now, old).join(gone, "id", "left_semi")


def _digests(rel: DataFrame, name: str) -> DataFrame:
    """Per unit: count and digests of the sets of dependencies and of (dependency, timestamp) pairs, combined before the shuffle."""
    ids = F.xxhash64(F.lit(3), "dep_id"), F.xxhash64("dep_id", F.lit(5))
    pairs = F.xxhash64(F.lit(3), "dep_id", "ts"), F.xxhash64("ts", "dep_id", F.lit(5))
    parts = [F.count(F.lit(1)), *[F.bit_xor(x) for x in (*ids, *pairs)]]
    return rel.groupBy(F.col("file_id").alias("id")).agg(*[p.alias(f"{name}{i}") for i, p in enumerate(parts)])


def _compared(now: DataFrame, old: DataFrame, rel_now: DataFrame, rel_old: DataFrame) -> DataFrame:
    o = old.select("id", F.col("ts").alias("o_ts"), F.col("args").alias("o_args"), F.lit(True).alias("known"))
    d = now.join(o, "id", "left").join(_digests(rel_now, "a"), "id", "left").join(_digests(rel_old, "b"), "id", "left")
    return d.fillna(0, [f"{x}{i}" for x in "ab" for i in range(5)])


def _differs(*which: int) -> Column:
    out = F.lit(False)
    for i in which:
        out = out | (F.col(f"a{i}") != F.col(f"b{i}"))
    return out


def dep_set_changed(now: DataFrame, old: DataFrame, rel_now: DataFrame, rel_old: DataFrame) -> DataFrame:
    """Units in both snapshots whose set of dependency ids differs."""
    return _compared(now, old, rel_now, rel_old).where(F.col("known") & _differs(0, 1, 2)).select("id")


def change_reason(now: DataFrame, old: DataFrame, rel_now: DataFrame, rel_old: DataFrame) -> DataFrame:
    """(id, reason) of every unit to process again; the first that holds of new, args, timestamp, dep_count, dep_set, dep_timestamp."""
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(~F.col("args").eqNullSafe(F.col("o_args")), "args")
        .when(~F.col("ts").eqNullSafe(F.col("o_ts")), "timestamp")
        .when(_differs(0), "dep_count")
        .when(_differs(1, 2), "dep_set")
        .when(_differs(3, 4), "dep_timestamp")
    )
    return _compared(now, old, rel_now, rel_old).select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def skip_unchanged(now: DataFrame, old: DataFrame, rel_old: DataFrame, current: DataFrame) -> DataFrame:
    """Ids that must be scanned: all but units with the same timestamp and arguments whose stored dependencies all have their stored timestamp.

    current: (dep_id, ts_now), the dependencies that exist; a stored one that doesn't is not regarded.
    """
    moved = rel_old.join(current, "dep_id").where(~F.col("ts").eqNullSafe(F.col("ts_now"))).select(F.col("file_id").alias("id")).distinct()
    o = old.select("id", F.col("ts").alias("o_ts"), F.col("args").alias("o_args"))
    same = now.join(o, "id").where(F.col("ts").eqNullSafe(F.col("o_ts")) & F.col("args").eqNullSafe(F.col("o_args"))).join(moved, "id", "left_anti")
    return now.select("id").join(same.select("id"), "id", "left_anti")


def apply_snapshot(now: DataFrame, old: DataFrame, rel_now: DataFrame, rel_old: DataFrame) -> DataFrame:
    """The relations (file_id, dep_id, ts) that the store holds after a run.

    A new unit, or one whose own timestamp changed, gets its current relations. Another keeps its stored ones with timestamps
    brought up to date, so a dependency added or removed in a header alone stays unseen. Units that the run didn't reach keep theirs.
    """
    o = old.select("id", F.col("ts").alias("o_ts"), F.lit(True).alias("known"))
    rebuilt = now.join(o, "id", "left").where(F.col("known").isNull() | ~F.col("ts").eqNullSafe(F.col("o_ts"))).select(F.col("id").alias("file_id"))
    fresh = rel_now.join(rebuilt, "file_id", "left_semi")
    kept = rel_old.join(rebuilt, "file_id", "left_anti").join(rel_now.withColumnRenamed("ts", "new_ts"), ["file_id", "dep_id"], "left")
    return fresh.select("file_id", "dep_id", "ts").unionByName(kept.select("file_id", "dep_id", F.coalesce("new_ts", "ts").alias("ts")))


def apply_units(now: DataFrame, old: DataFrame) -> DataFrame:
    """The units that the store holds after a run: current rows replace stored ones."""
    return now.unionByName(old.join(now.select("id"), "id", "left_anti"))


def flatten_sources(changed: DataFrame, rel_now: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of changed units and of their dependencies, as a bag."""
    ids = changed.select("id").unionByName(rel_now.join(changed.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("dep_id").alias("id")))
    return ids.join(files.select("id", "path"), "id").select("path")


def all_files_distinct(units: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct paths of all units and dependencies."""
    ids = units.select("id").unionByName(relations.select(F.col("dep_id").alias("id"))).distinct()
    return ids.join(files.select("id", "path"), "id").select("path").distinct()
