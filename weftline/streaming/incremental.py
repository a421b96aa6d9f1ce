"""Processing only new or changed records: a high watermark over runs, with atomic commits.

A run's id is its commit sequence number; it only grows. A batch reads the last manifest, fixes its upper limit
(the greatest run listed at that moment), reads only rows of runs above the watermark and up to the limit,
writes what changed, which is also the change of the state, into a folder of its own, and then publishes it together with
the new watermark by renaming one manifest file. A batch that dies before the rename leaves nothing that a reader
sees, and the next batch begins at the old watermark; two batches at once cannot both publish the same version. The rename must be
exclusive, as on HDFS and local disks; on an object store the log needs a file system layer that gives this.

Contract: all rows of a run are there once its status says that it has ended. Rows that reach an ended run after its batch aren't
processed; the manifest keeps the number of rows of each ended run, and ``late`` reports runs that have others now.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.shared import hadoop_path, last_json, publish_json, remove

VALUES = ["timestamp", "args_a", "args_b", "n_deps", "deps_a", "deps_b"]
ROWS = "run_id int, id long, " + ", ".join(f"{c} long" for c in VALUES) + ", part string"
CHANGES = "run_id int, id long"
#: So many folders of one level are merged into one of the next, so a job of n batches reads some 8 log8(n) folders.
FAN = 8
# Parts of a folder: the newest succeeded row of each unit in it, and the other changes.
_NEWEST, _OTHER = "newest", "other"


def _raw_states(units: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows per (run_id, id) with values, ``n_unit`` rows of units and ``n_rel`` rows of relations; without unit rows if only relations name the id."""
    at = F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(-(2**63)))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    u = units.where(F.col("run_id").isNotNull() & F.col("id").isNotNull()).select(
        F.col("run_id").cast("int").alias("run_id"), F.col("id").cast("long").alias("id"), at.alias("at"), F.col("timestamp").cast("long").alias("timestamp"),
        *[F.when(F.col("cmd_args").isNotNull(), F.xxhash64(F.lit(k), "cmd_args")).alias(f"args_{x}") for k, x in ((1, "a"), (2, "b"))],
        F.lit(1).cast("long").alias("n_unit"), *[zero.alias(c) for c in ("n_rel", "n_deps", "deps_a", "deps_b")],
    )
    per_dep = (
        relations.where(F.col("run_id").isNotNull() & F.col("file_id").isNotNull())
        .groupBy(F.col("run_id").cast("int").alias("run_id"), F.col("file_id").cast("long").alias("id"), "dep_id")
        .agg(F.max_by(F.col("dependency_timestamp").cast("long"), at).alias("dep_at"), F.count(F.lit(1)).alias("n_rel"))
    )
    known = F.coalesce("dep_at", F.lit(-1).cast("long")), F.col("dep_at").isNull()
    r = per_dep.select(
        "run_id", "id", *[none.alias(c) for c in ("at", "timestamp", "args_a", "args_b")], zero.alias("n_unit"), "n_rel", F.lit(1).cast("long").alias("n_deps"),
        *[F.xxhash64(F.lit(k), "dep_id", *known).alias(f"deps_{x}") for k, x in ((1, "a"), (2, "b"))],
    )
    sums = [F.sum(c).alias(c) for c in ("n_unit", "n_rel", "n_deps")]
    return u.unionByName(r).groupBy("run_id", "id").agg(*[F.max_by(c, "at").alias(c) for c in ("timestamp", "args_a", "args_b")], *sums, *[F.bit_xor(c).alias(c) for c in ("deps_a", "deps_b")])


def unit_states(units: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per (run_id, id): timestamp, two 64-bit digests of cmd_args, and count and two 64-bit digests of the dependency set.

    Of several rows with one key the greatest seen_at counts (null is the earliest); rows that share it are equal by contract, and else one of them counts.
    The first aggregation of relations is by (run, unit, dependency), so a hot unit or dependency spreads over all tasks; the second, of units and
    dependencies together, combines partial digests before its shuffle. All columns have a fixed width, so both hash in place. Rows without run_id or id belong to no unit.
    """
    return _raw_states(units, relations).where(F.col("n_unit") > 0).select("run_id", "id", *VALUES)


def changed_units(states: DataFrame, succeeded: DataFrame) -> DataFrame:
    """states with ``ok`` (the run succeeded) and ``must``: no earlier succeeded run wrote the unit, or what the latest such run wrote differs.

    A unit has at most one row per run and folder of the state, so a window per unit is small.
    """
    before = W.partitionBy("id").orderBy("run_id").rowsBetween(W.unboundedPreceding, -1)
    s = states.join(F.broadcast(succeeded.select("run_id", F.lit(True).alias("ok"))), "run_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    base = F.last(F.when(F.col("ok"), F.struct("run_id", *VALUES)), ignorenulls=True).over(before)
    same = F.lit(True)
    for c in VALUES:
        same = same & F.col(c).eqNullSafe(F.col(f"base.{c}"))
    return s.withColumn("base", base).withColumn("must", F.col("base").isNull() | ~same)


class RunLog:
    """The versions of one incremental job in a folder: manifests, and folders of changed rows, which hold the state as well."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def manifest(self) -> dict:
        """The last published manifest; version 0 if there is none."""
        none = {"version": 0, "watermark": None, "upper": None, "first": None, "folders": [], "open": None, "rows": {}}
        return last_json(self.spark, f"{self.base}/commits")[1] or none

    def publish(self, manifest: dict) -> None:
        """Makes a manifest visible in one step; fails if its version is there already."""
        publish_json(self.spark, f"{self.base}/commits", manifest["version"], manifest)

    def _read(self, paths: list[str], part: str | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        # A column ``part`` names the folder below, so that reading one part lists and reads no other.
        parts = [_NEWEST, _OTHER] if part is None else [part]
        found = [f"{p}/part={x}" for p in paths for x in parts]
        found = [f for f in found if (x := hadoop_path(self.spark, f)) and x[0].exists(x[1])]
        values = ROWS.rsplit(",", 1)[0]
        return self.spark.read.schema(values).parquet(*found) if found else self.spark.createDataFrame([], values)

    def _merged(self, folders: list[list]) -> list[list]:
        """The folders ([path, level]), where FAN of one level have become one of the next."""
        while len(folders) >= FAN and len({level for _, level in folders[-FAN:]}) == 1:
            last, level = folders[-FAN:], folders[-1][1]
            paths = [p for p, _ in last]
            newest = self._read(paths, _NEWEST).withColumn("last", F.row_number().over(W.partitionBy("id").orderBy(F.desc("run_id"))) == 1)
            rows = newest.withColumn("part", F.when(F.col("last"), _NEWEST).otherwise(_OTHER)).drop("last").unionByName(self._read(paths, _OTHER).withColumn("part", F.lit(_OTHER)))
            path = f"{self.base}/data/merged-{uuid.uuid4().hex}"
            rows.write.partitionBy("part").parquet(path)
            folders = [*folders[:-FAN], [path, level + 1]]
        return folders

    def process(self, units: DataFrame, relations: DataFrame, runs: DataFrame, upper: int | None = None, fail_before_publish: bool = False) -> dict:
        """One batch over the runs above the watermark, up to ``upper`` if it is given; returns the manifest that holds afterwards.

        The watermark rises to the last run below which every run has ended. Changes of runs above it (a run is
        still open, its rows may yet grow) are published as ``open`` and replaced by the next batch. Only succeeded runs
        become the base of later comparisons. Run ids that ``runs`` doesn't list count as open. The list of runs is small:
        a run covers the whole tree, so their number doesn't grow with the data. Of the state only rows of units in the batch are shuffled, and only
        rows that changed are written, as a unit that didn't change has the values it had.
        """
        last = self.manifest()
        low = last["watermark"]
        rows = sorted((r[0], r[1]) for r in set(runs.select("run_id", "status").where(F.col("run_id").isNotNull()).collect()))
        new = [r for r in rows if (low is None or r[0] > low) and (upper is None or r[0] <= upper)]
        if not new:
            return last
        limit = new[-1][0]
        closed = low
        for run, status in new:
            if status not in ("succeeded", "failed"):
                break
            closed = run
        succeeded = self.spark.createDataFrame([(r,) for r, s in rows if s == "succeeded"], "run_id int")
        bound = (F.col("run_id") <= limit) if low is None else (F.col("run_id") > low) & (F.col("run_id") <= limit)
        at = f"{self.base}/data/{last['version'] + 1:012d}-{uuid.uuid4().hex}"
        first = rows[0][0] if last["first"] is None else last["first"]
        seen = Observation()
        count = lambda c, r: F.coalesce(F.sum(F.when(F.col("run_id") == r, F.col(c))), F.lit(0)).alias(f"{c}{r}")
        raw = _raw_states(units.where(bound), relations.where(bound)).observe(seen, F.count(F.lit(1)).alias("all"), *[count(c, r) for r, _ in new for c in ("n_unit", "n_rel")])
        raw.where(F.col("n_unit") > 0).select("run_id", "id", *VALUES).write.parquet(f"{at}/now")
        now = self.spark.read.schema(ROWS.rsplit(",", 1)[0]).parquet(f"{at}/now")
        old = self._read([p for p, _ in last["folders"]], _NEWEST)
        before = old.join(now.select("id").distinct(), "id", "left_semi").select(now.columns) if last["folders"] else None
        judged = changed_units(now if before is None else now.unionByName(before), succeeded)
        ended = F.lit(False) if closed is None else F.col("run_id") <= closed
        fresh = F.lit(True) if low is None else F.col("run_id") > low
        base = F.when(F.col("ok") & ended, F.col("run_id"))
        rows_out = judged.where(fresh & F.col("must")).withColumn("top", F.max(base).over(W.partitionBy("id")))
        part = F.when(base == F.col("top"), _NEWEST).otherwise(_OTHER)
        rows_out.select("run_id", "id", *VALUES, F.when(ended, "closed").otherwise("open").alias("kind"), part.alias("part")).write.partitionBy("kind", "part").parquet(f"{at}/rows")
        remove(self.spark, f"{at}/now")
        if fail_before_publish:
            raise RuntimeError("stopped before the commit")
        sizes = {str(r): [seen.get[f"n_unit{r}"], seen.get[f"n_rel{r}"]] for r, _ in new if closed is not None and r <= closed}
        folders = last["folders"] if closed == low else self._merged([*last["folders"], [f"{at}/rows/kind=closed", 0]])
        after = {"version": last["version"] + 1, "first": first, "watermark": closed, "upper": limit, "folders": folders, "open": f"{at}/rows/kind=open", "rows": {**last["rows"], **sizes}}
        self.publish(after)
        return after

    def changes(self) -> DataFrame:
        """(run_id, id) of every change published so far; every unit of the first run is new and isn't listed."""
        m = self.manifest()
        found = self._read([*[p for p, _ in m["folders"]], *([m["open"]] if m["open"] else [])])
        return found.where(F.col("run_id") > (m["first"] or 0)).select("run_id", "id")

    def late(self, units: DataFrame, relations: DataFrame) -> DataFrame:
        """(run_id, n_recorded, n_now): ended runs that no longer have as many rows as when they were processed."""
        m = self.manifest()
        then = self.spark.createDataFrame([(int(r), sum(n)) for r, n in m["rows"].items()], "run_id int, n_recorded long")
        keys = units.select("run_id", "id").unionByName(relations.select("run_id", F.col("file_id").alias("id"))).where("run_id IS NOT NULL AND id IS NOT NULL")
        have = keys.groupBy(F.col("run_id").cast("int").alias("run_id")).agg(F.count(F.lit(1)).alias("n_now"))
        return then.join(have, "run_id", "left").select("run_id", "n_recorded", F.coalesce("n_now", F.lit(0)).alias("n_now")).where("n_recorded <> n_now")

    def vacuum(self) -> None:
        """Removes data folders that the last manifest doesn't name; no batch and no reader of an older manifest may be at work."""
        m = self.manifest()
        keep = [p for p, _ in m["folders"]] + ([m["open"]] if m["open"] else [])
        fs, p = hadoop_path(self.spark, f"{self.base}/data")
        for x in fs.listStatus(p) if fs.exists(p) else []:
            if not any(k.startswith(f"{self.base}/data/{x.getPath().getName()}") for k in keep):
                fs.delete(x.getPath(), True)
