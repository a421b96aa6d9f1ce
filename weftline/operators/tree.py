"""Tree-pattern queries over nodes (id, parent, kind, name): each step is a semi or an anti join.

A pattern is a function from the node table to the ids it matches; patterns nest, so a matcher can be used inside another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import release, written

Pattern = Callable[[DataFrame], DataFrame]


def kind(name: str, where: str = "true") -> Pattern:
    """Nodes of a kind, with a predicate on their attributes in SQL."""
    return lambda nodes: nodes.where(F.col("kind") == name).where(where).select("id")


def all_of(*patterns: Pattern) -> Pattern:
    """Nodes that every pattern matches."""
    return lambda nodes: reduce(lambda a, b: a.join(b, "id", "left_semi"), [p(nodes) for p in patterns])


def any_of(*patterns: Pattern) -> Pattern:
    """Nodes that at least one pattern matches, once each."""
    return lambda nodes: reduce(DataFrame.unionByName, [p(nodes) for p in patterns]).distinct()


def unless(pattern: Pattern, base: Pattern) -> Pattern:
    """Nodes of ``base`` that the pattern doesn't match."""
    return lambda nodes: base(nodes).join(pattern(nodes), "id", "left_anti")


def has_child(inner: Pattern) -> Pattern:
    """Nodes with a child that the pattern matches."""

    def match(nodes: DataFrame) -> DataFrame:
        parents = nodes.join(inner(nodes), "id", "left_semi").select(F.col("parent").alias("id")).where("id IS NOT NULL")
        return nodes.select("id").join(parents, "id", "left_semi")

    return match


def has_parent(inner: Pattern) -> Pattern:
    """Nodes whose parent the pattern matches."""
    return lambda nodes: nodes.join(inner(nodes).withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")


def parents_only(nodes: DataFrame) -> DataFrame:
    """The nodes that some node names as its parent: what every way towards the root runs over. Leaves, most of a tree, are left out."""
    return nodes.join(nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct(), "id", "left_semi")


def lifted(up: DataFrame, combine: Callable[[str], dict[str, Column]] | None = None, each: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(id, jump, carried columns) by pointer doubling: after round k each row's jump is its 2**k-th ancestor, and at the end null.

    ``combine(far)`` gives the carried columns over the way from a row to its jump and on from there, ``far`` being the prefix of the columns found at the
    jump. ``each`` sees the table of every round that has jumps. So a tree of depth d takes log2(d) joins of its inner nodes, and a cycle shows as a row that still
    has a jump after as many rounds as any tree of this size can need. A jump to an id that isn't there ends the way.
    """
    columns = [c for c in up.columns if c not in ("id", "jump")]
    at = up
    for n in range(64):
        last, at = at, written(at, "lifted", {"rows": F.count(F.lit(1)), "open": F.count("jump")})
        release(last)
        if not at.observed["open"]:
            return at
        if each:
            each(at)
        if n > at.observed["rows"].bit_length():
            raise ValueError("the parents form a cycle")
        far = at.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.lit(True).alias("found"), *[F.col(c).alias(f"far_{c}") for c in columns])
        new = combine("far_") if combine else {}
        at = at.join(far, "jump", "left").select("id", F.col("next").alias("jump"), *[F.when(F.col("found"), new[c]).otherwise(F.col(c)).alias(c) for c in columns])
    raise ValueError("the parents form a cycle")


def has_descendant(inner: Pattern) -> Pattern:
    """Nodes above a node that the pattern matches, each once: the ancestors within 2**k steps, doubled until the root."""

    def match(nodes: DataFrame) -> DataFrame:
        reached = nodes.join(inner(nodes), "id", "left_semi").where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        found = [written(reached, "reached")]

        def double(at: DataFrame) -> None:
            further = at.where("jump IS NOT NULL").join(found[0], "id", "left_semi").select(F.col("jump").alias("id"))
            last, found[0] = found[0], written(found[0].unionByName(further).distinct(), "reached")
            release(last)

        release(lifted(parents_only(nodes).select("id", F.col("parent").alias("jump")), each=double))
        return nodes.select("id").join(found[0], "id", "left_semi")

    return match


def has_ancestor(inner: Pattern) -> Pattern:
    """Nodes below a node that the pattern matches: the inner nodes' flags are carried down by doubling."""

    def match(nodes: DataFrame) -> DataFrame:
        hit = inner(nodes).select("id", F.lit(True).alias("hit")).distinct()
        up = parents_only(nodes).select("id", F.col("parent").alias("jump")).join(hit, "id", "left").select("id", "jump", F.coalesce("hit", F.lit(False)).alias("hit"))
        below = lifted(up, lambda far: {"hit": F.col("hit") | F.col(f"{far}hit")}).where("hit").select(F.col("id").alias("parent"))
        return nodes.join(below, "parent", "left_semi").select("id")

    return match


def bind_pair(nodes: DataFrame, outer: Pattern, inner: Pattern) -> DataFrame:
    """(id, child) of parents and children that match."""
    child = nodes.join(inner(nodes), "id", "left_semi").select(F.col("id").alias("child"), F.col("parent").alias("id"))
    return child.join(outer(nodes), "id", "left_semi").select("id", "child")


def _above(nodes: DataFrame, start: Pattern, carried: dict[str, Column], combine: Callable[[str], dict[str, Column]], keep: list[str]) -> DataFrame:
    """Each start node (``keep``) with what is carried from its parent up to the root, as up_*; null where it has no parent."""
    way = lifted(parents_only(nodes).select("id", F.col("parent").alias("jump"), *[c.alias(k) for k, c in carried.items()]), combine)
    up = way.select(F.col("id").alias("parent"), *[F.col(k).alias(f"up_{k}") for k in carried])
    return nodes.join(start(nodes), "id", "left_semi").select(*keep, "parent").join(up, "parent", "left")


def qualified_name(nodes: DataFrame, start: Pattern, skip: list[str], sep: str = "::") -> DataFrame:
    """(id, qualified): names from the root to each start node, without enclosing nodes whose kind is in ``skip`` or whose name is empty or null."""
    own = F.when(F.col("kind").isin(skip) | (F.coalesce(F.col("name"), F.lit("")) == ""), F.lit("")).otherwise(F.concat("name", F.lit(sep)))
    d = _above(nodes, start, {"names": own}, lambda far: {"names": F.concat(f"{far}names", "names")}, ["id", "name"])
    return d.select("id", F.concat(F.coalesce("up_names", F.lit("")), F.coalesce("name", F.lit(""))).alias("qualified"))


def nearest_ancestor(nodes: DataFrame, start: Pattern, kind_name: str) -> DataFrame:
    """(id, ancestor, depth) of the closest enclosing node of a kind; nodes without one don't come out."""
    hit = F.col("kind") == kind_name
    carried = {"ancestor": F.when(hit, F.col("id")), "depth": F.lit(1), "steps": F.lit(1)}

    def combine(far: str) -> dict[str, Column]:
        here = F.col("ancestor").isNotNull()
        further = F.col("steps") + F.col(f"{far}depth")
        return {"ancestor": F.coalesce("ancestor", f"{far}ancestor"), "depth": F.when(here, F.col("depth")).otherwise(further), "steps": F.col("steps") + F.col(f"{far}steps")}

    d = _above(nodes, start, carried, combine, ["id"]).where("up_ancestor IS NOT NULL")
    return d.select("id", F.col("up_ancestor").alias("ancestor"), F.col("up_depth").alias("depth"))


def chain_walk(nodes: DataFrame, start: Pattern) -> DataFrame:
    """(id, root, steps, path): the chain of parents from each start node to the last one that is there."""
    carried = {"root": F.col("id"), "steps": F.lit(1), "path": F.concat(F.lit(">"), F.col("id"))}

    def combine(far: str) -> dict[str, Column]:
        return {"root": F.col(f"{far}root"), "steps": F.col("steps") + F.col(f"{far}steps"), "path": F.concat("path", f"{far}path")}

    d = _above(nodes, start, carried, combine, ["id"])
    return d.select("id", F.coalesce("up_root", "id").alias("root"), F.coalesce("up_steps", F.lit(0)).alias("steps"), F.concat("id", F.coalesce("up_path", F.lit(""))).alias("path"))


def substituted_chain(links: DataFrame, start: DataFrame) -> DataFrame:
    """(id, target, arguments, steps): delegation followed to the last target, the arguments of each call put in for the parameters of the one it calls.

    links: (id, target, arguments array<string>); an argument ``$n`` stands for parameter n of the node itself, anything else for itself.
    ``arguments`` are those of the last target in terms of the first node's parameters. Chains are doubled, as composing substitutions is
    associative. start: (id). A node that doesn't delegate is its own target, with its parameters unknown (null).
    """
    up = links.select("id", F.col("target").alias("jump"), F.col("target").alias("last"), "arguments", F.lit(1).alias("steps"))

    def put_in(far: str) -> Column:
        number = lambda x: F.regexp_extract(x, r"^\$(\d+)$", 1)
        return F.transform(f"{far}arguments", lambda x: F.when(number(x) != "", F.coalesce(F.get("arguments", number(x).try_cast("int") - 1), x)).otherwise(x))

    def combine(far: str) -> dict[str, Column]:
        return {"last": F.col(f"{far}last"), "arguments": put_in(far), "steps": F.col("steps") + F.col(f"{far}steps")}

    found = lifted(up, combine).select("id", F.col("last").alias("target"), "arguments", "steps")
    d = start.select("id").join(found, "id", "left")
    return d.select("id", F.coalesce("target", "id").alias("target"), "arguments", F.coalesce("steps", F.lit(0)).alias("steps"))


def rewritten(types: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """(id, text) of every type, written from its parts upwards, with other names for some kinds.

    types: (id, parent, place, kind, pattern); ``{n}`` in a pattern stands for the text of the part at place n, and ``{name}`` for the new name of its kind. names: (kind, name).
    A kind without a name, where the pattern asks for one, is an error if ``strict``, else the kind itself is written. A round writes the types all of whose parts are written, so rounds are as
    many as the deepest type has levels, and each joins only types that wait for one of the last round's.
    """
    missing = F.raise_error(F.concat(F.lit("no name for "), F.coalesce("kind", F.lit("null")))).cast("string") if strict else F.col("kind")
    new = names.groupBy("kind").agg(F.max("name").alias("name"))
    named = types.join(new, "kind", "left").withColumn("asks", F.col("pattern").contains("{name}"))
    own = F.when(F.col("asks"), F.replace("pattern", F.lit("{name}"), F.coalesce("name", missing))).otherwise(F.col("pattern"))
    parts = types.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("parts"))
    waiting = written(named.select("id", "parent", "place", own.alias("text")).join(parts, "id", "left").select("id", "parent", "place", "text", F.coalesce("parts", F.lit(0)).alias("parts")), "types")
    front = done = written(waiting.where("parts = 0").select("id", "parent", "place", "text"), "written", {"n": F.count(F.lit(1))})
    arrived = None
    while front.observed["n"]:
        came = front.where("parent IS NOT NULL").select(F.col("parent").alias("id"), "place", "text")
        last, arrived = arrived, written(came if arrived is None else came.unionByName(arrived), "arrived")
        release(last)
        have = arrived.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("text").alias("part")))).alias("have"))
        ready = waiting.where("parts > 0").join(have, "id").where(F.size("have") == F.col("parts"))
        text = F.aggregate("have", F.col("text"), lambda t, p: F.replace(t, F.concat(F.lit("{"), p["place"].cast("string"), F.lit("}")), p["part"]))
        front = written(ready.select("id", "parent", "place", text.alias("text")), "written", {"n": F.count(F.lit(1))})
        last, arrived = arrived, written(arrived.join(front.select("id"), "id", "left_anti"), "arrived")
        release(last)
        done = done.unionByName(front)
    return done.select("id", "text")


def unique_name(places: DataFrame) -> DataFrame:
    """(file, line, col, generated): one generated name per place."""
    return places.select("file", "line", "col").distinct().withColumn("generated", F.concat_ws("_", F.lit("unnamed"), "file", "line", "col"))
