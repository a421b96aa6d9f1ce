"""Many tree patterns at once: labels and relations of nodes as bits, a few joins for any number of patterns.

A pattern is a text over the labels of a node: ``a & !b``, ``(a | b)``, and of its surroundings: ``child(p)``, ``parent(p)``, ``below(p)`` (a descendant),
``above(p)`` (an ancestor), and ``ref(p)`` (the node it refers to). Nodes are (id, parent, ref, labels array<string>); a label is a kind or any other property.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tree import lifted
from weftline.shared import release, written

RELATIONS = ("child", "parent", "below", "above", "ref")
#: Bits of one mask column.
_BITS = 60

Node = tuple
#: Columns of 60 bits each that say which of some labels a node has.
Bits = Callable[[list[str]], list[Column]]


def parsed(text: str) -> Node:
    """A pattern as nested tuples: ("label", x), ("not", p), ("and", p, q...), ("or", p, q...), and (relation, p)."""
    tokens = re.findall(r"[\w:]+|[&|!()]|\S", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(expected: str | None = None) -> str:
        nonlocal at
        t = peek()
        if not t or (expected and t != expected):
            raise ValueError(f"{expected or 'more'} expected at {at} in {text!r}")
        at += 1
        return t

    def chain(op: str, name: str, inner) -> Node:
        parts = [inner()]
        while peek() == op:
            take(op)
            parts.append(inner())
        return parts[0] if len(parts) == 1 else (name, *parts)

    def factor() -> Node:
        t = take()
        if t == "!":
            return ("not", factor())
        if t == "(":
            p = either()
            take(")")
            return p
        if not re.fullmatch(r"[\w:]+", t):
            raise ValueError(f"{t!r} in {text!r}")
        if t in RELATIONS and peek() == "(":
            take("(")
            p = either()
            take(")")
            return (t, p)
        return ("label", t)

    def either() -> Node:
        return chain("|", "or", lambda: chain("&", "and", factor))

    p = either()
    if at < len(tokens):
        raise ValueError(f"{peek()!r} left over in {text!r}")
    return p


def level(p: Node) -> int:
    """How many relations are nested in a pattern."""
    if p[0] == "label":
        return 0
    return max(map(level, p[1:])) + (p[0] in RELATIONS)


def _related(p: Node) -> set[Node]:
    if p[0] == "label":
        return set()
    found = set().union(*map(_related, p[1:]))
    return found | {p} if p[0] in RELATIONS else found


def _direct(p: Node) -> set[Node]:
    """The relations of a pattern that aren't inside another one."""
    if p[0] == "label":
        return set()
    return {p} if p[0] in RELATIONS else set().union(*map(_direct, p[1:]))


def _solved(p: Node, place: dict[Node, tuple[str, int] | bool], unknown: bool, yes: bool = True) -> Node | bool:
    """p, or its negation, over the bits in ``place``: nested ("and" | "or", parts) of (column, bit, yes), or a constant. A relation without a place counts as ``unknown``, negated or not.

    So False gives a bound from below and True one from above; where both agree, no relation that is still unknown can change the result.
    """
    if p in place:
        at = place[p]
        return at == yes if isinstance(at, bool) else (*at, yes)
    if p[0] == "not":
        return _solved(p[1], place, unknown, not yes)
    if p[0] in RELATIONS:
        return unknown
    whole = (p[0] == "and") == yes
    parts: list[Node] = []
    for x in p[1:]:
        s = _solved(x, place, unknown, yes)
        if isinstance(s, bool):
            if s != whole:
                return s
        elif s[0] == ("and" if whole else "or"):
            parts += s[1]
        else:
            parts.append(s)
    return ("and" if whole else "or", parts) if parts else whole


def _column(s: Node | bool) -> Column:
    """The test of ``_solved`` as a column; bits of one mask are compared at once, which keeps the generated code short."""
    if isinstance(s, bool):
        return F.lit(s)
    whole, parts = (True, [s]) if s[0] not in ("and", "or") else (s[0] == "and", s[1])
    asked: dict[str, list[int]] = {}
    tests = []
    for x in parts:
        if x[0] in ("and", "or"):
            tests.append(_column(x))
        else:
            asked.setdefault(x[0], [0, 0])[x[2]] |= 1 << x[1]
    for name, (no, yes) in asked.items():
        if no & yes:
            return F.lit(not whole)
        same = F.col(name).bitwiseAND(F.lit(no | yes).cast("long")) == F.lit(yes if whole else no).cast("long")
        tests.insert(0, same if whole else ~same)
    return reduce(lambda a, b: a & b if whole else a | b, tests)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _packed(tests: list[Column], name: str) -> list[Column]:
    """Tests as bits of as many long columns as they need."""
    zero, out = F.lit(0).cast("long"), []
    for m in range(0, len(tests), _BITS):
        bits = [F.when(t, F.lit(1 << b).cast("long")).otherwise(zero) for b, t in enumerate(tests[m : m + _BITS])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"{name}_{m // _BITS}"))
    return out


def label_bits(names: list[str]) -> list[Column]:
    """Which of these labels a node has, as bits of long columns, from its array ``labels``."""
    return _packed([F.coalesce(F.array_contains("labels", x), F.lit(False)) for x in names], "_b")


def labels_of(p: Node) -> set[str]:
    """The labels that a pattern names."""
    return {p[1]} if p[0] == "label" else set().union(*map(labels_of, p[1:]))


def _places(tests: list[Node], name: str) -> dict[Node, tuple[str, int]]:
    return {t: (f"{name}_{i // _BITS}", i % _BITS) for i, t in enumerate(tests)}


def _names(tests: list[Node], name: str) -> list[str]:
    return list(dict.fromkeys(c for c, _ in _places(tests, name).values()))


def _ors(names: list[str]) -> list[Column]:
    return [F.bit_or(n).alias(n) for n in names]


def _some(names: list[str]) -> Column:
    return _any([F.col(n) != 0 for n in names])


def _joined(rows: DataFrame, key: Column, found: DataFrame, names: list[str]) -> DataFrame:
    """rows with the masks that ``found`` (id, masks) has for a key, 0 without one. Rows without a key go by their own id, so that they spread over the tasks."""
    own = rows.withColumns({"_own": key.isNotNull(), "_key": F.coalesce(key, F.concat(F.lit("\0"), F.col("id")))})
    d = own.join(found.select(F.col("id").alias("_key"), *[F.col(n).alias(f"{n}_") for n in names]), "_key", "left")
    return d.select(*rows.columns, *[F.when(F.col("_own"), F.coalesce(f"{n}_", F.lit(0))).otherwise(F.lit(0)).cast("long").alias(n) for n in names])


def _ways(inner: DataFrame, above: list[str], below: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, above) and (id, below) over the nodes with a child that has children: bits of a node and all its ancestors, and of all that lies below it.

    inner: (id, parent, above: a node's own bits, below: those of its children), nodes with children. Only a few of these have children with children, and only those are doubled.
    """
    deep = [f"{n}_" for n in below]
    up = inner.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.lit(True).alias("_deep"), *[F.bit_or(n).alias(m) for n, m in zip(below, deep, strict=True)])
    ladder = written(inner.join(up, "id").select("id", F.col("parent").alias("jump"), *above, *[F.col(n).bitwiseOR(F.col(m)).alias(n) for n, m in zip(below, deep, strict=True)]), "ladder")
    got = [ladder.select("id", *below)]

    def double(at: DataFrame) -> None:
        further = at.where("jump IS NOT NULL").select("id", "jump").join(got[0].where(_some(below)), "id").select(F.col("jump").alias("id"), *below)
        last, got[0] = got[0], written(got[0].unionByName(further).groupBy("id").agg(*_ors(below)), "below")
        release(last)

    way = lifted(ladder.select("id", "jump", *above), lambda far: {m: F.col(m).bitwiseOR(F.col(far + m)) for m in above}, double if below else None)
    return way.select("id", *above), got[0]


def matches(nodes: DataFrame, patterns: dict[str, str | Node], carried: tuple[str, ...] = (), bits: Bits = label_bits) -> DataFrame:
    """(id, carried columns, pattern) of each node and each pattern that it matches.

    Patterns are taken apart; all tests that one kind of relation needs are bits of the same masks, so there is one join, or one doubling, for each kind and level of
    nesting however many patterns there are. A node is joined only where its relatives can still change a result, and kept only if it has children, may match, or may count for another one.
    Ids must be unique; a null label matches nothing; a parent or ref that isn't there is none. The nodes are evaluated twice and must come out the same.

    ``bits`` gives columns of 60 bits each for a list of labels, where labels come cheaper than by an array.
    """
    trees = {k: parsed(v) if isinstance(v, str) else v for k, v in sorted(patterns.items())}
    related = sorted(set().union(*map(_related, trees.values())), key=repr) if trees else []
    labels = sorted(set().union(*map(labels_of, trees.values())))
    names = [f"_b_{m}" for m in range(-(-len(labels) // _BITS))]
    place: dict[Node, tuple[str, int] | bool] = {("label", x): at for x, at in _places(labels, "_b").items()}
    at = nodes.select("id", "parent", "ref", *carried, *[c.alias(n) for c, n in zip(bits(labels) if labels else [], names, strict=True)])

    def test(p: Node, unknown: bool = False, known: dict | None = None) -> Column:
        return _column(_solved(p, known or place, unknown))

    def open_for(kinds: tuple[str, ...], depth: int) -> Column:
        """Whether a relation of these kinds at this level can still change what a row matches or counts for."""
        mine = {p for p in related if p[0] in kinds and level(p) == depth and p not in place}
        found = []
        for t in {*trees.values(), *(p[1] for p in related if level(p) > depth)}:
            if mine & _direct(t):
                found.append(_column(_solved(t, place, True)) & ~_column(_solved(t, place, False)))
        return _any(found)

    def wanted(child: int, ref: int, known: dict) -> Column:
        """Whether a row may match, or count for its parents or for what refers to it from these levels on."""
        counts = {p[1] for p in related if p[0] in ("child", "below", "ref") and level(p) >= (ref if p[0] == "ref" else child)}
        return _any([test(t, True, known) for t in sorted({*trees.values(), *counts}, key=repr)])

    for depth in range(1, max(map(level, related), default=0) + 1):
        tests = {r: sorted({p[1] for p in related if p[0] == r and level(p) == depth}, key=repr) for r in RELATIONS}
        masks = {r: _names(t, f"_{r}{depth}") for r, t in tests.items()}
        known = {p: _places(tests[p[0]], f"_{p[0]}{depth}")[p[1]] for p in related if level(p) == depth}
        own = {r: _packed([test(t) for t in tests[r]], f"_{r}{depth}") for r in RELATIONS}
        down, up, ref = [*masks["child"], *masks["below"]], [*masks["parent"], *masks["above"]], masks["ref"]
        given = at.where("parent IS NOT NULL").select(F.col("parent").alias("id"), *own["child"], *own["below"])
        if depth == 1:
            found = given.groupBy("id").agg(F.lit(True).alias("_inner"), *_ors(down))
            d = at.join(found, "id", "left").withColumns({"_inner": F.coalesce("_inner", F.lit(False)), **{n: F.coalesce(n, F.lit(0)).cast("long") for n in down}})
            leaf = {**place, **{p: False for p in related if p[0] in ("child", "below")}}
            at = written(d.where(F.col("_inner") | wanted(2, 1, leaf)), "related")
        elif down:
            found = given.where(_some(down)).groupBy("id").agg(*_ors(down))
            key = F.when(F.col("_inner") & (open_for(("child", "below"), depth) | F.lit(bool(masks["below"]))), F.col("id"))
            last, at = at, written(_joined(at, key, found, down), "related")
            release(last)
        place |= {p: x for p, x in known.items() if p[0] == "child"}
        inner = at.where("_inner")
        over = deep = None
        if masks["below"] or masks["above"]:
            over, deep = _ways(inner.select("id", "parent", *own["above"], *masks["below"]), masks["above"], masks["below"])
        keys: list[tuple[Column, DataFrame, list[str]]] = []
        if masks["below"]:
            keys.append((F.when(F.col("_inner") & open_for(("below",), depth), F.col("id")), deep.where(_some(masks["below"])), masks["below"]))
        if up:
            beside = inner.select("id", "parent", *own["parent"], *own["above"])
            if masks["above"]:
                far = [f"{n}_far" for n in masks["above"]]
                beside = _joined(beside, F.col("parent"), over.where(_some(masks["above"])).select("id", *[F.col(n).alias(f) for n, f in zip(masks["above"], far, strict=True)]), far)
                beside = beside.select("id", *masks["parent"], *[F.col(n).bitwiseOR(F.col(f)).alias(n) for n, f in zip(masks["above"], far, strict=True)])
            keys.append((F.when(open_for(("parent", "above"), depth), F.col("parent")), beside.where(_some(up)).select("id", *up), up))
        if ref:
            keys.append((F.when(open_for(("ref",), depth), F.col("ref")), at.select("id", *own["ref"]).where(_some(ref)), ref))
        if keys:
            asks = _any([k.isNotNull() for k, _, _ in keys])
            rest = at.where(~asks)
            new = [n for _, _, ns in keys for n in ns]
            out = at.where(asks).withColumns({f"_k{i}": k for i, (k, _, _) in enumerate(keys)})
            for i, (_, found, ns) in enumerate(keys):
                before = out.withColumnsRenamed({n: f"{n}_near" for n in ns if n in out.columns})
                out = _joined(before, F.col(f"_k{i}"), found, ns)
                if ns == masks["below"]:
                    out = out.withColumns({n: F.col(n).bitwiseOR(F.col(f"{n}_near")) for n in ns})
            have = [c for c in at.columns if c not in new]
            out = out.select(*have, *new).unionByName(rest.select(*have, *[F.col(n) if n in at.columns else F.lit(0).cast("long").alias(n) for n in new]))
        else:
            out = at
        place |= known
        if depth < max(map(level, related)):
            last, at = at, written(out.where(F.col("_inner") | wanted(depth + 1, depth + 1, place)), "related")
            release(last)
        else:
            at = out
    hits = [F.when(test(t), F.lit(k)) for k, t in trees.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return at.where(_any([test(t) for t in trees.values()])).select("id", *carried, F.explode(found).alias("pattern"))


def matched_groups(nodes: DataFrame, patterns: dict[str, Node], group: str, bits: Bits = label_bits) -> DataFrame:
    """(group, pattern): which patterns some node of each group matches, a group being the nodes with the same value in a column.

    Most are told by labels alone, in one pass. Relations are looked at only for patterns and groups that this leaves open.
    """
    names = sorted(patterns)
    labels = sorted(set().union(*map(labels_of, patterns.values())))
    place = {("label", x): at for x, at in _places(labels, "_b").items()}
    masks = [f"_sure_{m}" for m in range(-(-len(names) // _BITS))]
    at = nodes.select(group, *[c.alias(f"_b_{m}") for m, c in enumerate(bits(labels))])
    told = at.select(group, *_packed([_column(_solved(patterns[n], place, False)) for n in names], "_sure"))
    has = [F.shiftright(F.col(f"_sure_{i // _BITS}"), i % _BITS).bitwiseAND(1) == 1 for i in range(len(names))]
    sure = written(told.groupBy(group).agg(*_ors(masks)), "sure", {f"n{i}": F.count_if(~h) for i, h in enumerate(has)})
    found = sure.select(group, F.explode(F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in zip(names, has, strict=True)]))).alias("pattern"))
    left = [n for i, n in enumerate(names) if sure.observed[f"n{i}"]]
    if not left:
        return found
    asked = {f"@{n}": ~has[names.index(n)] for n in left}

    def with_asked(labels: list[str]) -> list[Column]:
        extra = _packed([F.coalesce(asked[x], F.lit(False)) if x in asked else F.lit(False) for x in labels], "_b")
        ours = [sum(1 << b for b, x in enumerate(labels[m : m + _BITS]) if x in asked) for m in range(0, len(labels), _BITS)]
        return [c.bitwiseAND(F.lit(~o).cast("long")).bitwiseOR(e) for c, o, e in zip(bits(labels), ours, extra, strict=True)]

    beside = sure.select(F.col(group).alias("_group"), *masks)
    more = matches(nodes.join(beside, F.col(group).eqNullSafe(F.col("_group")), "left"), {n: ("and", ("label", f"@{n}"), patterns[n]) for n in left}, (group,), with_asked)
    return found.unionByName(more.select(group, "pattern").distinct())


def pattern_sql(text: str, table: str = "nodes", closure: str = "closure") -> str:
    """The same test in SQL, on a row ``n`` of ``table`` with list ``labels``; closure: (anc, id) of every node and its ancestors."""

    def sql(p: Node, n: str) -> str:
        if p[0] == "label":
            return f"list_contains({n}.labels, '{p[1]}')"
        if p[0] == "not":
            return f"NOT ({sql(p[1], n)})"
        if p[0] in ("and", "or"):
            return "(" + f" {p[0].upper()} ".join(sql(x, n) for x in p[1:]) + ")"
        x = f"{n}x"
        inner = sql(p[1], x)
        if p[0] == "child":
            return f"{n}.id IN (SELECT {x}.parent FROM {table} {x} WHERE {x}.parent IS NOT NULL AND {inner})"
        if p[0] in ("parent", "ref"):
            return f"coalesce({n}.{p[0]} IN (SELECT {x}.id FROM {table} {x} WHERE {inner}), false)"
        mine, other = ("id", "anc") if p[0] == "above" else ("anc", "id")
        return f"{n}.id IN (SELECT c.{mine} FROM {closure} c JOIN {table} {x} ON {x}.id = c.{other} WHERE {inner})"

    return sql(parsed(text), "n")
