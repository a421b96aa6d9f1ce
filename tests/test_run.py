"""The run from end to end over small snapshots, and the patterns of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.patterns import matches, parsed
from weftline.operators.rules import RULES
from weftline.plans.run_queries import deducing
from weftline.run import RunConfig, include_closure, run, scan_includes
from weftline.shared import scratch_path
from weftline.sources.store import Store


def snapshot(spark, texts, times, units):
    """What a scan sees of texts by path, with the units' commands."""
    ids = {p: i + 10 for i, p in enumerate(sorted(texts))}
    t = spark.createDataFrame(list(texts.items()), "path string, text string")
    edges = scan_includes(t, ["/inc/"])
    pairs = include_closure(edges, spark.createDataFrame([(u,) for u in units], "path string")).collect()
    files = spark.createDataFrame([(i, p) for p, i in ids.items()], "id long, path string")
    cu = spark.createDataFrame([(ids[u], times[u], a) for u, a in units.items()], "id long, ts long, args string")
    rel = spark.createDataFrame([(ids[r.path], ids[r.dep_path], times[r.dep_path]) for r in pairs], "file_id long, dep_id long, ts long")
    return files, cu, rel, t


TEXTS = {
    "/s/A.cpp": '#include "A.h"\n#include <All.h>\nauto a;\nint x;\nauto b;\n',
    "/s/B.cpp": '#include "All.h"\nint b;\n',
    "/s/C.cpp": "int c;\n",
    "/s/A.h": '#include "All.h"\nauto h;\n',
    "/inc/All.h": '#include "/s/A.h"\n',
    "/s/All.h": "int all;\n",
}


def test_includes(spark):
    t = spark.createDataFrame(list(TEXTS.items()), "path string, text string")
    edges = sorted((r.path, r.dep_path or "") for r in scan_includes(t, ["/inc/"]).collect())
    assert edges == [("/inc/All.h", ""), ("/s/A.cpp", "/s/A.h"), ("/s/A.cpp", "/s/All.h"), ("/s/A.h", "/s/All.h"), ("/s/All.h", ""), ("/s/B.cpp", "/s/All.h"), ("/s/C.cpp", "")]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "path string, dep_path string")
    start = spark.createDataFrame([("a",), ("d",)], "path string")
    assert sorted(map(tuple, include_closure(loop, start).collect())) == [("a", "a"), ("a", "b"), ("a", "c")]


def sizes(store):
    return tuple(store.read(n).count() for n in ("compilation_unit", "files", "relations", "transformations", "replacements", "lines"))


def test_runs_in_a_row(spark, tmp_path):
    store = Store(spark, scratch_path(spark, "store"))
    config = RunConfig(include=["/s/"], perf=str(tmp_path / "perf"))
    times = dict.fromkeys(TEXTS, 5)
    two = {"/s/A.cpp": " cc a", "/s/B.cpp": " cc b"}
    r = run(spark, config, *snapshot(spark, TEXTS, times, two), deducing(), store)
    assert sizes(store) == (2, 6, 3, 1, 3, 9)
    assert r.log == [("find-features", 1, 4), ("deduce", 1, 2), ("deduce", 2, 1)]
    text = {x.path: x.text for x in r.texts.collect()}
    assert text["/s/A.cpp"].count("auto") == 0 and text["/s/A.cpp"].endswith("int a;\nint x;\nint b;\n") and set(text) == {"/s/A.cpp", "/s/A.h"}
    assert {x.source for x in spark.read.json(str(tmp_path / "perf")).collect()} == {"scan", "diff", "transforms", "texts", "store"}
    # A third unit comes in: only it is new, and it has nothing to change.
    three = {**two, "/s/C.cpp": " cc c"}
    r = run(spark, config, *snapshot(spark, TEXTS, times, three), deducing(), store)
    assert [tuple(x) for x in r.reasons.collect()] == [("/s/C.cpp", "new")] and sizes(store) == (3, 6, 3, 1, 3, 9)
    # Nothing changed: nothing is queued, nothing is stored anew.
    r = run(spark, config, *snapshot(spark, TEXTS, times, three), deducing(), store)
    assert r.reasons.count() == 0 and r.log == [] and sizes(store) == (3, 6, 3, 1, 3, 9)
    # A header changes: the units that include it are done again, their stored relations stay and get its time.
    r = run(spark, config, *snapshot(spark, {**TEXTS, "/s/All.h": "\nauto all;\n"}, {**times, "/s/All.h": 6}, three), deducing(), store)
    assert {tuple(x) for x in r.reasons.collect()} == {("/s/A.cpp", "dep_timestamp"), ("/s/B.cpp", "dep_timestamp")}
    assert sizes(store) == (3, 6, 3, 1, 7, 12)
    assert {x.dependency_timestamp for x in store.read("relations").collect()} == {5, 6}
    # A unit drops an include in a text that changed itself; another's arguments change.
    texts = {**TEXTS, "/s/A.cpp": "int a;\n"}
    r = run(spark, config, *snapshot(spark, texts, {**times, "/s/A.cpp": 8, "/s/All.h": 6}, {**three, "/s/B.cpp": " cc b -O2"}), deducing(), store)
    assert {tuple(x) for x in r.reasons.collect()} == {("/s/A.cpp", "timestamp"), ("/s/B.cpp", "args")}
    assert sizes(store)[:3] == (3, 6, 1) and {x.cmd_args for x in store.read("compilation_unit").collect()} == {" cc a", " cc b -O2", " cc c"}
    r = run(spark, RunConfig(include=["/s/"], reset_database=True), *snapshot(spark, TEXTS, times, two), deducing(), store)
    assert {x.reason for x in r.reasons.collect()} == {"reset"} and sizes(store) == (2, 6, 3, 1, 3, 9)


def test_modes_and_sinks(spark, tmp_path):
    seen = snapshot(spark, TEXTS, dict.fromkeys(TEXTS, 5), {"/s/A.cpp": "x", "/s/B.cpp": "y"})
    store = Store(spark, scratch_path(spark, "store"))
    check = lambda t: t.select("path", (~F.col("text").contains("auto")).alias("passed"))
    r = run(spark, RunConfig(include=["/s/"], no_database=True, source_root="/s/", dest=f"{tmp_path}/out/", check=check), *seen, deducing(), store)
    assert {x.reason for x in r.reasons.collect()} == {"no database"} and store._pointer()[0] == 0
    assert (tmp_path / "out" / "A.h").read_text() == '#include "All.h"\nint h;\n'
    assert tuple(r.summary.first()) == (4, 0) and r.failed.count() == 0
    r = run(spark, RunConfig(sources=["/s/B.cpp"], include=["/s/"], transforms=["deduce"], no_database=True, serialize_dir=f"{tmp_path}/edits"), *seen, deducing())
    assert r.log[0] == ("deduce", 1, 2) and r.edits.count() == 0
    r = run(spark, RunConfig(include=["/s/"], targets={"clang": "3.6"}, no_database=True, check=check), *seen, deducing())
    assert [x[0] for x in r.log] == ["find-features"] and tuple(r.summary.first()) == (2, 2), "no target needs the transform"
    with pytest.raises(ValueError):
        run(spark, RunConfig(include=["/none/"]), *seen, deducing())


def plain(p, n, nodes):
    if p[0] == "label":
        return p[1] in (n["labels"] or [])
    if p[0] == "not":
        return not plain(p[1], n, nodes)
    if p[0] in ("and", "or"):
        return (all if p[0] == "and" else any)(plain(x, n, nodes) for x in p[1:])
    up = lambda x: nodes.get(x["parent"])
    if p[0] == "child":
        return any(plain(p[1], x, nodes) for x in nodes.values() if x["parent"] == n["id"])
    if p[0] in ("parent", "ref"):
        x = nodes.get(n[p[0]])
        return x is not None and plain(p[1], x, nodes)
    if p[0] == "above":
        x = up(n)
        while x:
            if plain(p[1], x, nodes):
                return True
            x = up(x)
        return False
    return any(plain(("above", ("label", "\0")), x, nodes) or plain(p[1], x, nodes) for x in nodes.values() if under(x, n, nodes))


def under(x, n, nodes):
    while x := nodes.get(x["parent"]):
        if x is n:
            return True
    return False


def test_patterns_are_the_plain_ones(spark):
    rnd = random.Random(3)
    labels = ["a", "b", "c"]
    nodes = {}
    for i in range(60):
        nodes[f"n{i}"] = {"id": f"n{i}", "parent": rnd.choice([None, "absent", *list(nodes)[-6:], *list(nodes)[-6:]]), "ref": rnd.choice([None, "absent", f"n{rnd.randrange(60)}"]), "labels": rnd.choice([None, [], rnd.sample(labels, 1), rnd.sample(labels, 2)])}
    df = spark.createDataFrame([(*x.values(), "clash") for x in nodes.values()], "id string, parent string, ref string, labels array<string>, _m0 string")
    patterns = {
        "p1": "a & !b", "p2": "child(a | b)", "p3": "parent(a) & !below(b)", "p4": "above(a & child(b)) | ref(c)", "p5": "below(a & !above(b))", "p6": "!(child(a) & child(b))", "p7": "ref(ref(a & above(c)))",
        **{f"q{i}": f"below({x} & {y}{z})" for i, (x, y, z) in enumerate((x, y, z) for x in "abc" for y in ("", "!") for z in "abc")},
    }
    got = {(r.id, r.pattern) for r in matches(df, patterns).collect()}
    assert got == {(i, k) for k, t in patterns.items() for i, n in nodes.items() if plain(parsed(t), n, nodes)}
    assert matches(df.limit(0), patterns).count() == 0


def test_every_rule_can_be_read():
    assert sum(len(r) for r in RULES.values()) > 60
    for rules in RULES.values():
        for text in rules.values():
            parsed(text)
    for bad in ("a &", "(a", "a b", "child a)", "?"):
        with pytest.raises(ValueError):
            parsed(bad)


def kept(monkeypatch):
    """What the pattern operators write from now on: (name, types of columns, rows)."""
    from weftline.operators import patterns
    from weftline.shared import written

    seen = []

    def write(df, name, observed=None):
        out = written(df, name, observed)
        seen.append((name, [t for _, t in out.dtypes], out.count()))
        return out

    monkeypatch.setattr(patterns, "written", write)
    return seen


def test_patterns_keep_bits_of_nodes_that_count(spark, monkeypatch):
    nodes = {"r": {"id": "r", "parent": None, "ref": None, "labels": ["Decl", "implicit"]}, "s": {"id": "s", "parent": "r", "ref": None, "labels": [f"x{i}" for i in range(70)]}}
    for i in range(200):
        nodes[f"n{i}"] = {"id": f"n{i}", "parent": "rs"[i % 2], "ref": f"n{i + 1}" if i % 3 else None, "labels": [f"x{i}", "Return"] if i < 70 else ["Other"]}
    df = spark.createDataFrame([tuple(x.values()) for x in nodes.values()], "id string, parent string, ref string, labels array<string>")
    patterns = {f"p{i}": f"child(x{i} & Return)" for i in range(70)} | {"q": "x3 & above(Decl & implicit) & !ref(x4)", "w": "x8 & ref(x9) & parent(x65 & below(x5))", "never": "x6 & !x6", "always": "x7 | !x7"}
    some = {k: v for k, v in patterns.items() if k != "always"}
    seen = kept(monkeypatch)
    for asked in (some, patterns):
        got = {(r.id, r.pattern) for r in matches(df, asked).collect()}
        assert got == {(i, k) for k, t in asked.items() for i, n in nodes.items() if plain(parsed(t), n, nodes)}
        if asked is some:
            assert seen and max(n for _, _, n in seen) < 100 and not any(t.startswith("array") for _, types, _ in seen for t in types)


def test_numbers_give_the_bits_of_their_labels(spark):
    from pyspark.sql import functions as F

    from weftline.operators.patterns import label_bits
    from weftline.plans.rule_queries import FLAGS, KINDS, _labels, number_bits

    names = sorted({*FLAGS, *(x for k in KINDS for x in k), "@none"})
    df = spark.createDataFrame([(i,) for i in [None, -64, -33, *range(2100), 10**12 + 5]], "number long").withColumn("labels", _labels(F.col("number")))
    rows = df.select(F.array(*label_bits(names)).alias("a"), F.array(*number_bits(names)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({tuple(r.a) for r in rows}) > 1000


def test_finder_asks_relations_only_where_labels_leave_it_open(spark, monkeypatch):
    from weftline.operators.rules import feature_queue

    far = [("a", None, None, "f1", ["Lambda"]), ("b", "a", None, "f2", ["Return"]), ("c", "b", None, None, ["Construct", "rvalue_subtype"])]
    df = spark.createDataFrame([*far, ("d", None, "e", "f3", ["DeclRef"]), ("e", None, None, "f4", ["Declarator", "Var", "rvalue_subtype"])], "id string, parent string, ref string, file string, labels array<string>")
    more = {(t, f) for t, f in [("replace-lambda", "f1"), ("replace-rvalue", None), ("replace-rvalue", "f3"), ("replace-rvalue", "f4")]}
    assert {tuple(r) for r in feature_queue(df, ["replace-lambda", "replace-rvalue"]).collect()} == more
    seen = kept(monkeypatch)
    known = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, None, f"f{i % 2}", ["Lambda"]) for i in range(100)], df.schema)
    got = [tuple(r) for r in feature_queue(known, ["replace-lambda"]).collect()]
    assert sorted(got) == [("replace-lambda", "f0"), ("replace-lambda", "f1")] and [(name, n) for name, _, n in seen] == [("sure", 2)]
