"""The relational store: seven tables as versioned Parquet folders, with keys kept by the operators that write."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.ordered import numbered
from weftline.shared import last_json, publish_json, remove

#: The tables' schemas and natural keys.
SCHEMAS = {
    "files": "id long, number_of_lines int, path string",
    "compilation_unit": "id long, timestamp long, cmd_args string",
    "relations": "file_id long, dep_id long, dependency_timestamp long",
    "transformations": "id long, name string",
    "replacements": "id long, file_id long, start_line int, lines_replaced int, lines_in_replacement int, comes_from_start_line int, "
    "comes_from_end_line int, comes_from_file_id long, transformation_id long, unhandled int, replacement_text string",
    "lines": "id long, file_id long, line int, original_line int",
    "lines_replacements": "line_id long, replacement_id long",
}
KEYS = {
    "files": ["path"],
    "compilation_unit": ["id"],
    "relations": ["file_id", "dep_id"],
    "transformations": ["name"],
    "replacements": ["id"],
    "lines": ["file_id", "line"],
    "lines_replacements": ["line_id", "replacement_id"],
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key; a new row replaces the stored one, and of several new rows the last by ``order`` wins."""
    columns = old.columns
    last = new.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("at"), F.struct(*columns).alias("row"))).alias("x")).select("x.row.*")
    return old.join(last.select(*keys), keys, "left_anti").select(columns).unionByName(last)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stored rows, and new rows whose key isn't stored; of several new rows the first by ``order``."""
    columns = old.columns
    first = new.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at"), F.struct(*columns).alias("row"))).alias("x")).select("x.row.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(columns))


def insert_checked(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with the new rows that break no key, the rows refused). A key that several new rows share is refused for all but one."""
    n = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*new.columns)))
    clash = n.join(old.select(*keys).withColumn("_old", F.lit(True)), keys, "left")
    fits = F.col("_old").isNull() & (F.col("_n") == 1)
    return old.unionByName(clash.where(fits).select(old.columns)), clash.where(~fits).select(old.columns)


def update_by_key(old: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table with ``value`` from changes (keys and value, unique by key) where they have the key; others do nothing."""
    c = changes.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    out = old.join(c, keys, "left")
    return out.withColumn(value, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value))).select(old.columns)


def delete_by_key(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without rows whose key is in ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").select(old.columns)


def mark_handled(edits: DataFrame, done: DataFrame) -> DataFrame:
    """Edits with ``unhandled`` off where their id is in ``done`` (id)."""
    d = done.select("id").distinct().withColumn("_done", F.lit(True))
    return edits.join(d, "id", "left").withColumn("unhandled", F.col("unhandled") & F.col("_done").isNull()).drop("_done").select(edits.columns)


def edit_add(edits: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The added edits with their ids, which follow the greatest stored one without a gap, in order of ``order`` and then of the other columns.

    Edits are never merged with equal ones, so each has an id of its own.
    """
    top = edits.agg(F.max("id")).first()[0] or 0
    return numbered(new, [F.col(c) for c in [*order, *[c for c in new.columns if c not in order]]], "id", top + 1)


def add_relations(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Relations with those added that new (path, dep_path, ts) names, unless the pair is stored; a path that no file has gets the id -1.

    The stored pair wins, and of several new ones the earliest timestamp. Of several files with one path the greatest id counts.
    """
    ids = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("id").alias("id"))
    one = new.join(ids.withColumnRenamed("id", "file_id"), "path", "left")
    both = one.join(ids.select(F.col("path").alias("dep_path"), F.col("id").alias("dep_id")), "dep_path", "left")
    unknown = F.lit(-1).cast("long")
    return insert_ignore(old, both.select(F.coalesce("file_id", unknown).alias("file_id"), F.coalesce("dep_id", unknown).alias("dep_id"), "ts"), ["file_id", "dep_id"], "ts")


def upsert_lines_with_bridge(lines: DataFrame, bridge: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, bridge) after new rows (id, file_id, line, original_line, replacement_id) replaced those of equal (file_id, line) and were tied to their edits.

    Rows of the bridge whose line was replaced go, as the line has another id then.
    """
    after = upsert(lines, new, ["file_id", "line"], "id")
    tied = new.select(F.col("id").alias("line_id"), "replacement_id").join(after.select(F.col("id").alias("line_id")), "line_id", "left_semi")
    kept = bridge.join(after.select(F.col("id").alias("line_id")), "line_id", "left_semi")
    return after, kept.unionByName(tied).distinct()


def renumber_lines(lines: DataFrame, moved: DataFrame) -> DataFrame:
    """The line table with other line numbers for the ids in moved (id, line); a row that stood at a number that another takes over goes.

    Of several rows that move to one place that with the greatest id stays.
    """
    m = moved.groupBy("id").agg(F.max("line").alias("_to"))
    out = lines.join(m, "id", "left").withColumn("_moved", F.col("_to").isNotNull()).withColumn("line", F.coalesce("_to", "line"))
    rank = F.row_number().over(W.partitionBy("file_id", "line").orderBy(F.desc("_moved"), F.desc("id")))
    return out.withColumn("_rank", rank).where("_rank = 1").select(lines.columns)


def tried(write: Callable[[], object], ignored: tuple[type[BaseException], ...] = ()) -> bool:
    """Whether a write succeeded; an error of an ignored kind counts as success, any other is raised."""
    try:
        write()
    except ignored:
        pass
    return True


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row holds."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


class Store:
    """Tables under one folder. Every write makes a new version of a table; one exclusive rename of a pointer shows all tables of a transaction at once.

    A transaction reads the versions that held when it began, and fails at its end if another has published since. The rename must be exclusive, as on HDFS
    and local disks.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.pending: dict[str, str] | None = None
        self.began: tuple[int, dict[str, str]] = (0, {})

    def _pointer(self) -> tuple[int, dict[str, str]]:
        n, found = last_json(self.spark, f"{self.base}/pointers")
        return n, found or {}

    def create(self) -> None:
        """Makes the tables that are absent."""
        with self:
            for name, schema in SCHEMAS.items():
                if name not in self.began[1]:
                    self.write(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        """The table's current version; within a transaction its own, or the one that held when it began."""
        path = self._pointer()[1].get(name) if self.pending is None else self.pending.get(name) or self.began[1].get(name)
        schema = SCHEMAS.get(name)
        if not path:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)

    def write(self, name: str, df: DataFrame) -> None:
        """Writes a new version; outside a transaction it is one of its own."""
        if self.pending is None:
            with self:
                self.write(name, df)
            return
        path = f"{self.base}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.pending[name] = path

    def drop(self) -> None:
        """Removes all tables and their history."""
        remove(self.spark, self.base)

    def truncate(self) -> None:
        """Empties all tables in one step."""
        with self:
            for name, schema in SCHEMAS.items():
                self.write(name, self.spark.createDataFrame([], schema))

    def dump(self) -> list[str]:
        """The store as ordered text lines; for tests of small stores."""
        return [f"{n}|" + "|".join(map(str, r)) for n in SCHEMAS for r in sorted(self.read(n).collect(), key=str)]

    def sql(self, text: str, **args: object) -> DataFrame:
        """Runs SQL text over the tables as views, with named parameters."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    def __enter__(self) -> Store:
        """Begins a transaction; one within another is an error."""
        if self.pending is not None:
            raise RuntimeError("a transaction is open already")
        self.began, self.pending = self._pointer(), {}
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        """Publishes the transaction's tables together, or none of them if it failed or another transaction came first."""
        new, self.pending = self.pending, None
        if kind is not None or not new:
            return
        number, tables = self.began
        try:
            publish_json(self.spark, f"{self.base}/pointers", number + 1, {**tables, **new})
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise RuntimeError("another transaction published first") from None
            raise
