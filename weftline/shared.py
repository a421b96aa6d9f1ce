"""Scratch tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and everything runs on this
machine, as in tests, a folder of this machine is made and set; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        known = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path object) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish_json(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Makes a numbered file visible in one step, whole or not at all; fails if the number is taken."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:012d}.json")
    fs = to.getFileSystem(conf)
    fs.mkdirs(to.getParent())
    part = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(bytearray(json.dumps(content), "utf8"))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(part, to, how)


def last_json(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number, content) of the file that was published with the greatest number; (0, None) if there is none."""
    fs, p = hadoop_path(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = [int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "."]
    if not done:
        return 0, None
    stream = fs.open(hadoop_path(spark, f"{folder}/{max(done):012d}.json")[1])
    try:
        return max(done), json.loads(bytes(stream.readAllBytes()).decode("utf8"))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed with its scope, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_scratch)
    _made[path] = spark
    return path


def remove_scratch(paths: list[str] | None = None) -> None:
    """Removes these scratch tables, or all made so far; results that still read one become unreadable."""
    for path in list(_made) if paths is None else paths:
        spark = _made.pop(path, None)
        try:
            if spark is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone
            pass


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes at its end the scratch tables that were made inside. Results must be stored before."""
    before = set(_made)
    try:
        yield
    finally:
        remove_scratch([p for p in _made if p not in before])


def written(df: DataFrame, name: str, observed: dict[str, Column] | None = None) -> DataFrame:
    """df computed once, written to the shared folder and read again. This cuts lineage and survives lost executors.

    ``observed`` are aggregates taken while writing; they come as the attribute ``observed``, without another job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation() if observed else None
    (df.observe(seen, *[c.alias(k) for k, c in observed.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if seen:
        out.observed = seen.get
    return out


def release(*frames: DataFrame | None) -> None:
    """Removes tables that ``written`` made, once nothing reads them any more."""
    remove_scratch([f.scratch for f in frames if f is not None and getattr(f, "scratch", None)])
