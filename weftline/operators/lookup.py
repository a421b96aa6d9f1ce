"""Bulk lookups: many probes answered by one join, with a sentinel where nothing is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import listed


def lookup(probes: DataFrame, store: DataFrame, on: list[str], value: str, missing: object) -> DataFrame:
    """Each distinct probe with ``value`` from the store, or ``missing``. Of several stored values the greatest is given.

    Null keys match nothing; a stored null counts as missing.
    """
    best = store.groupBy(*on).agg(F.max(value).alias(value))
    return probes.select(*on).distinct().join(best, on, "left").select(*on, F.coalesce(value, F.lit(missing)).alias(value))


def exists(probes: DataFrame, store: DataFrame, on: list[str], name: str = "found") -> DataFrame:
    """Each distinct probe with a flag: whether the store has its key."""
    known = store.select(*on).distinct().withColumn(name, F.lit(True))
    return probes.select(*on).distinct().join(known, on, "left").select(*on, F.coalesce(name, F.lit(False)).alias(name))


def dependency_list(relations: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, ts) of every dependency that has a file."""
    return relations.join(files.select(F.col("id").alias("dep_id"), "path"), "dep_id").select("file_id", "path", "ts")


def compilation_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, ts, args) of every unit that has a file."""
    return units.join(files.select("id", "path"), "id").select("id", "path", "ts", "args")


def load_dependencies(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, part, n_deps, deps): every unit with its sorted dependency ids, in parts by ``listed``; units without any keep an empty list in part 0."""
    d = listed(relations.select(F.col("file_id").alias("id"), "dep_id"), "id", "dep_id")
    none = F.lit(0)
    return units.select("id").join(d, "id", "left").select(
        "id", F.coalesce("part", none.cast("long")).alias("part"), F.coalesce("n", none).alias("n_deps"), F.coalesce(F.array_join("values", ","), F.lit("")).alias("deps")
    )


def deps_keep_empty(units: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dep_path): one row per dependency; a unit without any has one row with the empty path."""
    d = dependency_list(relations, files).select(F.col("file_id").alias("id"), F.col("path").alias("dep_path"))
    return units.select("id").join(d, "id", "left").select("id", F.coalesce("dep_path", F.lit("")).alias("dep_path"))


def edit_detail(edits: DataFrame, files: DataFrame, transformations: DataFrame) -> DataFrame:
    """Each edit with the paths of its target and its origin and its transform's name; the empty text where unknown."""
    target = files.select(F.col("id").alias("file_id"), F.col("path").alias("target"))
    origin = files.select(F.col("id").alias("comes_from_file_id"), F.col("path").alias("origin"))
    names = transformations.select(F.col("id").alias("transformation_id"), "name")
    e = edits.join(target, "file_id", "left").join(origin, "comes_from_file_id", "left").join(names, "transformation_id", "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("target", "origin", "name")]
    return e.select(
        "id", *text, "start_line", "lines_replaced", "lines_in_replacement", "comes_from_start_line", "comes_from_end_line", "unhandled", "replacement_text"
    )


EDIT_KEY = ["file_id", "start_line", "lines_replaced", "lines_in_replacement", "replacement_text"]


def edit_find(edits: DataFrame) -> DataFrame:
    """The greatest id of each distinct edit, equal by its five key columns."""
    return edits.groupBy(*EDIT_KEY).agg(F.max("id").alias("id"))


def edits_upto_line(probes: DataFrame, edits: DataFrame, by_transform: bool = False) -> DataFrame:
    """(file_id, line[, transformation_id], id): edits that start at or above the probed line, the range inside the equal file."""
    on = ["file_id", "transformation_id"] if by_transform else ["file_id"]
    return probes.join(edits.select("id", "file_id", "transformation_id", "start_line") if by_transform else edits.select("id", "file_id", "start_line"), on).where(
        F.col("start_line") <= F.col("line")
    ).select(*on, "line", "id")


def edits_unhandled(edits: DataFrame) -> DataFrame:
    """(id, file_id) of edits that still have to be applied; a missing flag means that."""
    return edits.where(F.coalesce("unhandled", F.lit(True))).select("id", "file_id")


def transforms_of_line(lines: DataFrame, bridge: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, line, transformation_id): the distinct transforms whose edits touched each line."""
    return edits_of_line(lines, bridge, edits).select("file_id", "line", "transformation_id").distinct()


def edits_of_line(lines: DataFrame, bridge: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, line, replacement_id, transformation_id, replacement_text) through the bridge of lines and edits."""
    e = edits.select(F.col("id").alias("replacement_id"), "transformation_id", "replacement_text")
    return lines.select(F.col("id").alias("line_id"), "file_id", "line").join(bridge, "line_id").join(e, "replacement_id").select("file_id", "line", "replacement_id", "transformation_id", "replacement_text")


def transform_ids(names: DataFrame, transformations: DataFrame) -> DataFrame:
    """(id, name): the dimension with a new id for each name it lacks, in order of name. Null names are left out.

    The dimension holds the registered transforms, so the one ordering over new names is small.
    """
    from pyspark.sql import Window as W

    new = names.select("name").where(F.col("name").isNotNull()).distinct().join(transformations.select("name"), "name", "left_anti")
    top = transformations.agg(F.max("id")).first()[0] or 0
    numbered = new.select((F.row_number().over(W.orderBy("name")) + top).cast("long").alias("id"), "name")
    return transformations.select("id", "name").unionByName(numbered)
