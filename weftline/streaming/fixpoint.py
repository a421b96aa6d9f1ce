"""The dataflow driver: transforms in order of priority, each run until its own queue is empty."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import written

Rule = Callable[..., tuple[DataFrame, DataFrame]]


@dataclass
class Transform:
    """A named rule with its priority and the lowest compiler versions that do without it.

    The rule gets the queued paths (path) and gives edits and new queue entries (transform, path). A transform without versions is always needed. A finder that comes first gets all
    files and queues what the others need. A rule that works on texts takes the state that the driver was given as a second argument.
    """

    name: str
    priority: int
    rule: Rule
    versions: dict[str, str] = field(default_factory=dict)
    finder: bool = False


class Registry:
    """Transforms by name."""

    def __init__(self) -> None:
        self.by_name: dict[str, Transform] = {}

    def add(self, t: Transform) -> None:
        self.by_name[t.name] = t

    def selected(self, names: list[str] | None = None, targets: dict[str, str] | None = None) -> list[Transform]:
        """The named ones, or all, with the highest priority first; equal priorities in order of name.

        ``targets`` are the lowest versions by compiler that the result must suit; transforms that none of them needs are left out, named or not. A name
        that isn't registered is an error.
        """
        unknown = sorted(set(names or ()) - self.by_name.keys())
        if unknown:
            raise ValueError(f"unknown transforms: {', '.join(unknown)}")
        mine = [t for t in self.by_name.values() if not names or t.name in names]
        return sorted((t for t in mine if not targets or not supports(t.versions, targets)), key=lambda t: (-t.priority, t.name))


def parsed_version(text: str | None) -> tuple[int, int] | None:
    """(major, minor) of ``major`` or ``major.minor``; None for anything else."""
    m = re.fullmatch(r"(\d{1,9})(?:\.(\d{1,9}))?", text or "")
    return (int(m[1]), int(m[2] or 0)) if m else None


def supports(needed: dict[str, str], targets: dict[str, str]) -> bool:
    """Whether every target compiler does without a transform that asks for these versions; a compiler that it doesn't name never does, nor does an unreadable version."""
    if not needed:
        return False
    pairs = [(parsed_version(v), parsed_version(needed.get(c))) for c, v in targets.items()]
    return all(have is not None and need is not None and have >= need for have, need in pairs)


def version_of(text: Column) -> Column:
    """struct(major, minor) of ``major`` or ``major.minor``; null for anything else."""
    ok = text.rlike(r"^\d{1,9}(\.\d{1,9})?$")
    part = F.split(text, r"\.")
    return F.when(ok, F.struct(part[0].cast("int").alias("major"), F.coalesce(F.get(part, 1).cast("int"), F.lit(0)).alias("minor")))


def version_filter(required: DataFrame, given: DataFrame, null_supports: bool = True) -> DataFrame:
    """(transform, supported): whether the lowest given version (compiler, version) of every compiler reaches what the transform asks (transform, compiler, version).

    A version that can't be read is unknown; ``null_supports`` says whether an unknown or absent one passes.
    """
    low = given.select("compiler", version_of(F.col("version")).alias("v")).groupBy("compiler").agg(F.min("v").alias("have"))
    r = required.select("transform", "compiler", version_of(F.col("version")).alias("need")).join(F.broadcast(low), "compiler", "left")
    return r.groupBy("transform").agg(F.bool_and(F.coalesce(F.col("have") >= F.col("need"), F.lit(null_supports))).alias("supported"))


def transform_order(transforms: DataFrame) -> DataFrame:
    """(name, priority, place): highest priority first; the table of transforms is small."""
    from pyspark.sql import Window as W

    return transforms.select("name", "priority", F.row_number().over(W.orderBy(F.desc("priority"), "name")).alias("place"))


def seed_queue(transforms: DataFrame, paths: DataFrame, finder: str | None = None) -> DataFrame:
    """(transform, path): all paths for the finder alone if there is one, else for each of the few transforms."""
    names = [finder] if finder else [r[0] for r in transforms.select("name").distinct().orderBy("name").collect()]
    return paths.select("path").distinct().select(F.explode(F.array(*[F.lit(n) for n in names])).alias("transform"), "path")


def digest(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two aggregates that tell bags of rows apart: the number of rows and the sum of their hashes."""
    return F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))


def run_to_fixpoint(
    registry: Registry, queue: DataFrame, names: list[str] | None = None, targets: dict[str, str] | None = None, after: Callable[[str, DataFrame], None] | None = None, state: object = None
) -> tuple[DataFrame | None, list[tuple[str, int, int]]]:
    """(all edits, log of (transform, pass, paths)). Each pass takes the transform's queue, runs the rule, and takes what the rule asks of itself.

    Entries for a transform that has run already are kept and not run again. A pass writes its edits and what it asked for, by transform, to the
    shared folder, and no other queue, so lineage doesn't grow and a lost executor costs one pass at most. ``after(transform, edits)`` applies a pass's
    edits where the rule reads texts. A pass with the queue and the edits of an earlier one of its transform would go on for ever and is an error.
    """
    chosen = registry.selected(names, targets)
    order = [t.name for t in chosen]
    counts = {f"n{k}": F.count_if(F.col("transform") == n) for k, n in enumerate(order)}

    def stored(entries: DataFrame) -> DataFrame:
        """Distinct entries for chosen transforms, and how many each has."""
        mine = entries.select("transform", "path").where(F.col("transform").isin(order)).distinct()
        return written(mine, "queue", counts or {"n": F.count(F.lit(1))})

    edits, log = [], []
    pieces = [stored(queue)]
    for k, t in enumerate(chosen):
        waiting = [p for p in pieces if p.observed[f"n{k}"]]
        seen: set[tuple] = set()
        n = 0
        while waiting:
            n += 1
            mine = reduce(DataFrame.unionByName, [p.where(F.col("transform") == t.name).select("path") for p in waiting])
            queued = sum(p.observed[f"n{k}"] for p in waiting)
            if len(waiting) > 1:
                mine = written(mine.distinct(), "mine", {"n": F.count(F.lit(1))})
                queued = mine.observed["n"]
            log.append((t.name, n, queued))
            made, asked = t.rule(mine) if state is None else t.rule(mine, state)
            size, sums = digest(made, made.columns)
            made = written(made, "edits", {"n": size, "h": sums})
            asked = stored(asked)
            own = asked.where(F.col("transform") == t.name).select("path")
            if asked.observed[f"n{k}"]:
                left = own.agg(*[c.alias(x) for c, x in zip(digest(own, ["path"]), "nh", strict=True)]).first()
                now = (made.observed["n"], made.observed["h"], left["n"], left["h"])
                if now in seen:
                    raise RuntimeError(f"{t.name} comes back to a pass that it has made")
                seen.add(now)
            if made.observed["n"]:
                edits.append(made)
                if after:
                    after(t.name, made)
            if not edits:
                edits.append(made)
            pieces.append(asked)
            waiting = [asked] if asked.observed[f"n{k}"] else []
    return reduce(DataFrame.unionByName, edits) if edits else None, log


def check_summary(results: DataFrame) -> DataFrame:
    """(n_passed, n_failed) over (path, passed); a null counts as failed."""
    ok = F.coalesce("passed", F.lit(False))
    return results.agg(F.count_if(ok).alias("n_passed"), F.count_if(~ok).alias("n_failed"))


def failed_paths(results: DataFrame) -> DataFrame:
    """(path, n_failed) of the paths of which a command failed, over (path, passed) with a row per command; a path without commands has a null and failed."""
    bad = ~F.coalesce("passed", F.lit(False))
    return results.groupBy("path").agg(F.count_if(bad).alias("n_failed")).where("n_failed > 0")
