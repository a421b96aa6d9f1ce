"""Compilation databases, source selection and sinks for edits, texts and timings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import moved_or_fail
from weftline.operators.ordered import listed
from weftline.shared import hadoop_path

COMMANDS = "directory string, command string, file string"


def _database(spark: SparkSession, folder: str) -> str | None:
    path = folder if folder.endswith(".json") else f"{folder.rstrip('/')}/compile_commands.json"
    fs, p = hadoop_path(spark, path)
    return path if fs.exists(p) else None


def _read_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMANDS).json(path, multiLine=True)


def read_commands(spark: SparkSession, folder: str | None = None, sources: list[str] | None = None) -> DataFrame:
    """(directory, command, file) of a compilation database.

    With ``folder`` (or the database's own path) it must be there. Else it is looked for in the folder of the first source and every folder above, and taken if
    it has a command for that source, as another is probably unrelated. If none is found each source gets the fixed
    command ``-std=c++11`` in the current directory. Without folder and sources it is an error.
    """
    if folder is not None:
        found = _database(spark, folder)
        if found is None:
            raise FileNotFoundError(f"no compilation database in {folder}")
        return _read_database(spark, found)
    if not sources:
        raise ValueError("could not determine sources to transform")
    at = sources[0]
    while "/" in at.rstrip("/"):
        at = at.rstrip("/").rsplit("/", 1)[0]
        found = _database(spark, at) if at and not at.endswith(":") else None
        if found:
            commands = _read_database(spark, found)
            if not commands.where(F.col("file") == sources[0]).isEmpty():
                return commands
            break
    rows = [(".", "-std=c++11", s) for s in dict.fromkeys(sources)]
    return spark.createDataFrame(rows, COMMANDS)


def commands_by_file(commands: DataFrame) -> DataFrame:
    """(file, part, n_commands, ids): the commands of each file, in parts by ``listed``."""
    return listed(commands, "file", "id").select("file", "part", F.col("n").alias("n_commands"), F.array_join("values", ",").alias("ids"))


def commands_of(asked: DataFrame, commands: DataFrame) -> DataFrame:
    """(file, part, n_commands, ids) of each asked file (file); one without commands has an empty list."""
    found = asked.select("file").distinct().join(commands_by_file(commands), "file", "left")
    return found.select("file", F.coalesce("part", F.lit(0).cast("long")).alias("part"), F.coalesce("n_commands", F.lit(0)).alias("n_commands"), F.coalesce("ids", F.lit("")).alias("ids"))


def commands_for_file(files: DataFrame, commands: DataFrame) -> DataFrame:
    """(path, id) of each command (id, args) that has the path as an argument, once however often."""
    args = commands.select("id", F.explode(F.array_distinct("args")).alias("path"))
    return args.join(files.select("path").distinct(), "path").select("path", "id")


def partial_database(commands: DataFrame, group: DataFrame) -> DataFrame:
    """The commands of a group of files (path)."""
    return commands.join(group.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def distinct_commands(commands: DataFrame) -> DataFrame:
    """Commands equal in directory, command and file once."""
    return commands.select("directory", "command", "file").distinct()


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path has one of a few prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def include_exclude(paths: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, included, excluded): included is under an included prefix and not under an excluded one."""
    out = starts_with_any(F.col("path"), exclude)
    return paths.select("path", (starts_with_any(F.col("path"), include) & ~out).alias("included"), out.alias("excluded"))


def select_sources(positional: DataFrame | None, database: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Given sources (path) that aren't excluded; where none are given, the database's files that are included. Distinct.

    Without given sources an empty list of inclusions is an error, and so is a selection of nothing.
    """
    if positional is not None and not positional.isEmpty():
        found = positional.where(~starts_with_any(F.col("path"), exclude)).select("path").distinct()
    elif not include:
        raise ValueError("give the files of the compilation database to transform as included")
    else:
        found = include_exclude(database.select("path").distinct(), include, exclude).where("included").select("path")
    if found.isEmpty():
        raise ValueError("could not determine sources to transform")
    return found


def source_files(paths: DataFrame) -> DataFrame:
    """Rows whose path has the extension of a translation unit."""
    return paths.where(F.col("path").rlike(r"\.(cpp|c|cxx|cc)\z"))


def modifiable(main: Column, path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a file may be edited: a unit's main file always, another if its path is included and not excluded, one without a path never."""
    inside = starts_with_any(path, include) & ~starts_with_any(path, exclude)
    return F.when(main, True).when(path.isNull(), False).otherwise(inside)


def is_modifiable(relations: DataFrame, files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(file_id, dep_id, modifiable) of each relation."""
    r = relations.join(files.select(F.col("id").alias("dep_id"), "path"), "dep_id", "left")
    return r.select("file_id", "dep_id", modifiable(F.col("dep_id") == F.col("file_id"), F.col("path"), include, exclude).alias("modifiable"))


def edit_guard(edits: DataFrame, files: DataFrame, units: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(id, valid): whether an edit starts in a file, takes no negative number of lines, comes from the file it is put in, and may be put there."""
    f = files.select(F.col("id").alias("file_id"), "path")
    c = units.select(F.col("id").alias("file_id"), F.lit(True).alias("main"))
    e = edits.join(f, "file_id", "left").join(c, "file_id", "left")
    whole = (F.col("start_line") >= 1) & (F.col("lines_replaced") >= 0) & (F.col("comes_from_file_id") == F.col("file_id"))
    return e.select("id", (whole & modifiable(F.coalesce("main", F.lit(False)), F.col("path"), include, exclude)).alias("valid"))


def staged(texts: DataFrame, source_root: str, dest: str) -> DataFrame:
    """Texts (path, text) at their new paths; one outside the root is an error, and so is a destination that is the root or below it."""
    if not dest.endswith("/"):
        raise ValueError(f"not a folder: {dest}")
    if dest.startswith(source_root):
        raise ValueError("the destination is the source")
    return texts.withColumn("path", moved_or_fail(F.col("path"), source_root, dest))


def write_edits(edits: DataFrame, path: str) -> None:
    """Edits as JSON lines instead of applying them; refuses a folder that is there."""
    edits.write.mode("error").json(path)


def write_texts(texts: DataFrame, folder: str) -> int:
    """Each text (path, text) as a file of its own below a folder, written to a file beside it and renamed; the number of files.

    An existing file is replaced and not written into, so others that are hard links to it keep their content. Written by the tasks; a task that runs again writes the
    same files again.
    """
    base = folder.rstrip("/")
    local = base.removeprefix("file://")
    if "://" in local:
        raise ValueError("files are written to a mounted folder")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = os.path.normpath(f"{local}/{path}")
                if not to.startswith(f"{local}/"):
                    raise ValueError(f"a path that leaves the folder: {path}")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf8", newline="") as f:
                    f.write(text or "")
                os.replace(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return texts.select("path", "text").where(F.col("path").isNotNull()).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_timings(spark: SparkSession, timings: dict[str, float], path: str = "./migrate_perf") -> None:
    """Seconds by source as JSON lines."""
    spark.createDataFrame(sorted(timings.items()), "source string, seconds double").coalesce(1).write.mode("overwrite").json(path)
