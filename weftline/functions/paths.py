"""Scalar functions on paths. A path that ends in a slash is a folder; whether a file system has it isn't asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import trim_ws
from weftline.operators.ordered import numbered


def is_directory(path: Column) -> Column:
    """Whether the path ends in a slash of either kind, or in a dot that stands for a folder."""
    return path.rlike(r"(^|[/\\])\.{0,2}\z")


def is_absolute(path: Column) -> Column:
    """Whether the path begins at a root or a drive."""
    return path.rlike(r"^([/\\]|[A-Za-z]:)")


def parse(path: Column) -> dict[str, Column]:
    """Trimmed path with ``./`` before a relative one, and its kind."""
    p = trim_ws(path)
    absolute = is_absolute(p)
    return {"parsed": F.when(absolute | p.startswith("./"), p).otherwise(F.concat(F.lit("./"), p)), "is_dir": is_directory(p), "is_abs": absolute}


def normalize(path: Column) -> Column:
    """Forward slashes, no ``.`` steps, ``..`` resolved as far as there is a step to leave, no doubled slashes; a folder ends in a slash.

    A relative path that climbs above its beginning starts with ``./``; nothing left is ``.``.
    """
    p = F.replace(trim_ws(path), F.lit("\\"), F.lit("/"))
    folder = is_directory(p)
    steps = F.filter(F.split(F.regexp_replace(p, r"/\z", ""), "/"), lambda t: t != ".")

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        back = (F.size(done) > 0) & (last != "..")
        climb = F.when(F.size(done) == 0, F.array(F.lit("."), F.lit(".."))).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(t != "..", F.concat(done, F.array(t))).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(climb)

    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    joined = F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/"))
    tidy = F.regexp_replace(F.when(folder, F.concat(joined, F.lit("/"))).otherwise(joined), "/+", "/")
    return tidy


def last_dir(path: Column) -> Column:
    """The folder that holds a file; a folder itself."""
    return F.regexp_replace(path, r"/[^/]+\z", "/")


def one_step_up(path: Column) -> Column:
    """The folder that holds a file or folder."""
    return F.regexp_replace(path, r"/[^/]+/?\z", "/")


def make_absolute(path: Column, root: str) -> Column:
    """A relative path, with or without ``./``, under a root folder; absolute paths as they are."""
    return F.when(is_absolute(path), path).otherwise(F.concat(F.lit(root), F.regexp_replace(path, r"^\./", "")))


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """A path below a folder moved to another folder; others as they are."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def common_prefix(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The longest common prefix of each group's paths, character by character: that of its least and greatest path."""
    m = df.where(F.col(path).isNotNull()).groupBy(*by).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    where = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr("a", i, F.lit(1)) != F.substr("b", i, F.lit(1)))
    size = F.when(F.size(where) > 0, F.element_at(where, 1) - 1).otherwise(n)
    return m.select(*by, F.substr("a", F.lit(1), size).alias("prefix"))


def path_order(df: DataFrame) -> DataFrame:
    """(path, place) of distinct paths within a folder: folders after files, relative before absolute, then by text.

    All paths are numbered along folder and order, and a folder's first number is taken off, so a folder that holds most paths is many tasks' work.
    """
    p = F.col("path")
    d = df.select("path").distinct().select("path", last_dir(p).alias("folder"), is_directory(p).alias("is_dir"), is_absolute(p).alias("is_abs"))
    n = numbered(d, [F.col(c) for c in ("folder", "is_dir", "is_abs", "path")], "number")
    first = n.groupBy("folder").agg(F.min("number").alias("first"))
    return n.join(first, n["folder"].eqNullSafe(first["folder"])).select("path", (F.col("number") - F.col("first") + 1).cast("int").alias("place"))


def matching_prefixes(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix, moved) of each path for the longest prefix (prefix, replacement) that it has; paths without one come with nulls.

    Each path is cut behind each of its slashes, and the beginnings are joined by equality, so neither side is held whole. Prefixes must end in a slash.
    """
    bad = F.raise_error(F.concat(F.lit("not a folder: "), F.coalesce("prefix", F.lit("null")))).cast("string")
    pre = prefixes.select(F.when(F.col("prefix").endswith("/"), F.col("prefix")).otherwise(bad).alias("prefix"), "replacement").groupBy("prefix").agg(F.max("replacement").alias("replacement"))
    d = paths.select("path").distinct()
    at = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substr("path", i, F.lit(1)) == "/")
    begins = d.where(F.length("path") > 0).select("path", F.explode(F.transform(at, lambda i: F.substr("path", F.lit(1), i))).alias("prefix"))
    best = begins.join(pre, "prefix").groupBy("path").agg(F.max_by(F.struct("prefix", "replacement"), F.length("prefix")).alias("x"))
    out = d.join(best, "path", "left").select("path", F.col("x.prefix").alias("prefix"), F.col("x.replacement").alias("replacement"))
    return out.select("path", "prefix", F.concat("replacement", F.substr("path", F.length("prefix") + 1)).alias("moved"))


def moved_or_fail(path: Column, old: str, new: str) -> Column:
    """A path below a folder moved to another folder; any other path is an error, as is a folder that doesn't end in a slash."""
    if not old.endswith("/"):
        raise ValueError(f"not a folder: {old}")
    fail = F.raise_error(F.concat(F.lit(f"not below {old}: "), F.coalesce(path, F.lit("null")))).cast("string")
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(fail)


def unique_sources(df: DataFrame) -> DataFrame:
    """Distinct normalized paths."""
    return df.select(normalize(F.col("path")).alias("path")).distinct()
