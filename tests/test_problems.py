"""The core problem operators against brute force, on small and awkward inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.packed import split_packed
from weftline.operators.accumulate import dense_by_key, dependents, frequent_keys
from weftline.operators.orphans import orphan_report, orphans
from weftline.shared import scratch_path
from weftline.streaming.incremental import RunLog

T = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(100)]
REFS = "ref_table string, file_id long, ref_id long, seen_at timestamp_ntz"
FILES = "id long, added_at timestamp_ntz, removed_at timestamp_ntz, extra string, status string"


def status(ref, at, files):
    lives = [(a, b) for i, a, b, *_ in files if i == ref and i is not None and a is not None and (b is None or b > a)]
    if at is not None and any(a <= at and (b is None or at < b) for a, b in lives):
        return None
    if not lives:
        return "missing"
    return "deleted" if at is not None and any(a <= at for a, _ in lives) else "late"


@pytest.mark.parametrize("split", [7, 500_000])
def test_orphans(spark, split):
    rnd = random.Random(3)
    files = [(rnd.choice([1, 1, 2, 3, 4, 5, None]), rnd.choice([*T[:60], None]), rnd.choice([None, *T]), "x", "y") for _ in range(25)]
    files += files[:5] + [(9, T[5], T[9], "x", "y"), (9, T[9], T[12], "x", "y"), (8, T[5], T[5], "x", "y")]
    refs = [("r", i, rnd.choice([1, 1, 1, 1, 2, 3, 6, 8, 9, None]), rnd.choice([*T[:40], None])) for i in range(300)]
    refs += refs[:20] + [("r", 900, 9, T[9]), ("r", 901, 9, T[12]), ("r", 902, 9, T[4])]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(files, FILES), rows_per_split=split).collect()
    want = [(*r, s) for r in refs if (s := status(r[2], r[3], files))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_orphans_empty(spark):
    none = spark.createDataFrame([], FILES)
    refs = spark.createDataFrame([("r", 1, 1, T[0])], REFS)
    assert [r.status for r in orphans(refs, none).collect()] == ["missing"]
    assert orphans(spark.createDataFrame([], REFS), none).count() == 0
    r = orphan_report(orphans(refs, none)).first()
    assert (r.period, r.n_rows, r.n_keys) == ("2024-01", 1, 1)


CU = "id long, timestamp long, cmd_args string, run_id int, seen_at timestamp_ntz, base string"
REL = "file_id long, dep_id long, dependency_timestamp long, run_id int, seen_at timestamp_ntz"


def history(rnd):
    units, rels = [], []
    for run in range(1, 7):
        for u in range(40):
            if rnd.random() < 0.25:
                continue
            late = [(u, 99, "old", run, T[run])] if rnd.random() < 0.2 else []
            units += [*late, *[(u, rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", "a", "a", "a ", None]), run, T[run + 20])] * rnd.choice([1, 2])]
            for dep in range(rnd.choice([0, 2, 2])):
                rels.append((u, dep, rnd.choice([5, 5, 5, 5, 6]), run, T[run + 20]))
                if rnd.random() < 0.2:
                    rels.append((u, dep, 77, run, T[run]))
    return units, rels, [(1, "succeeded"), (2, "succeeded"), (3, "failed"), (4, "succeeded"), (5, "failed"), (6, "running")]


def expected(units, rels, runs):
    u, r = {}, {}
    for i, t, c, run, at in sorted(units, key=lambda x: x[4]):
        u[run, i] = (t, c)
    for f, d, t, run, at in sorted(rels, key=lambda x: x[4]):
        r[run, f, d] = t
    deps = {}
    for (run, f, d), t in r.items():
        deps.setdefault((run, f), set()).add((d, t))
    ok = {run for run, s in runs if s == "succeeded"}
    out = set()
    for run, i in u:
        base = max((p for p, j in u if j == i and p < run and p in ok), default=None)
        if run > 1 and (base is None or u[run, i] != u[base, i] or deps.get((run, i), set()) != deps.get((base, i), set())):
            out.add((run, i))
    return out


def test_runs_in_one_batch_or_many_with_failures(spark):
    units, rels, runs = history(random.Random(5))
    rnd = random.Random(6)
    rnd.shuffle(units), rnd.shuffle(rels)
    cu = spark.createDataFrame([(*x, "clash") for x in units], CU)
    rel = spark.createDataFrame(rels, REL)
    table = lambda n: spark.createDataFrame([x for x in runs if x[0] <= n], "run_id int, status string")
    want = expected(units, rels, runs)
    one = RunLog(spark, scratch_path(spark, "one"))
    m = one.process(cu, rel, table(6))
    assert (m["watermark"], m["upper"]) == (5, 6)
    assert {tuple(x) for x in one.changes().collect()} == want
    many = RunLog(spark, scratch_path(spark, "many"))
    for n in range(1, 7):
        part = cu.where(F.col("run_id") <= n), rel.where(F.col("run_id") <= n), table(n)
        before = many.manifest()
        with pytest.raises(RuntimeError):
            many.process(*part, fail_before_publish=True)
        assert many.manifest() == before
        many.process(*part)
        assert {tuple(x) for x in many.changes().collect()} == {x for x in want if x[0] <= n}
    assert sorted(map(tuple, many.changes().collect())) == sorted(want), "no change is published twice"
    # The open run ends; its rows are judged again, in place of the open ones.
    done = spark.createDataFrame([*runs[:5], (6, "succeeded")], "run_id int, status string")
    assert many.process(cu, rel, done)["watermark"] == 6
    assert sorted(map(tuple, many.changes().collect())) == sorted(want)
    assert many.process(cu, rel, done)["version"] == 7, "nothing new, nothing published"


def test_publish_is_exclusive(spark):
    log = RunLog(spark, scratch_path(spark, "twice"))
    log.publish({"version": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        log.publish({"version": 1, "other": True})
    assert log.manifest() == {"version": 1}


def test_runs_empty(spark):
    log = RunLog(spark, scratch_path(spark, "none"))
    log.process(spark.createDataFrame([], CU), spark.createDataFrame([], REL), spark.createDataFrame([(1, "succeeded")], "run_id int, status string"))
    assert log.changes().count() == 0


def plain_split(text):
    out, now, has, quote, i = [], "", False, "", 0
    while i < len(text):
        c, nxt = text[i], text[i + 1 : i + 2]
        if quote == "'":
            if c == "'":
                quote = ""
            else:
                now += c
        elif quote == '"':
            if c == "\\" and nxt == '"':
                now, i = now + nxt, i + 1
            elif c == '"':
                quote = ""
            else:
                now += c
        elif c == "\\" and nxt and nxt in "\"' ":
            now, has, i = now + nxt, True, i + 1
        elif c in "\"'":
            quote, has = c, True
        elif c in " \t\n\r\v\f;|":
            if has or now:
                out.append(now)
            now, has = "", False
        else:
            now += c
        i += 1
    return [*out, now] if has or now else out


@pytest.mark.parametrize("frequent", [0, 50, 4096])
def test_split_packed(spark, frequent):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "bc", " ", "\t", ";", "|", '"', "'", "\\", ",", "\u0001", "\u0002", "\u0003", "\u0004", "a", "ö"]) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    texts += ["", " ;| ", None, '""', "a''b", "x" * 200_000 + " 'y z'", "C:\\a\\b " * 5000, "' open", "\\", '"a\\\\"b" c']
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = split_packed(spark.createDataFrame(rows, "row long, t string, parts string, shape string"), "t", ["row"], frequent)
    by = {}
    for r in got.collect():
        by.setdefault(r.row, {})[r.pos] = r.value
    for i, t in enumerate(texts):
        want = plain_split(t) if t is not None else []
        assert [by.get(i, {})[k + 1] for k in range(len(by.get(i, {})))] == want, repr(t)[:100]


def test_split_packed_on_the_tables(spark):
    d = "/root/testdata/sf0.001"
    cu = spark.read.parquet(f"{d}/compilation_unit.parquet").select("id", "run_id", "cmd_args").distinct()
    want = sorted((r[0], r[1], k + 1, v) for r in cu.collect() for k, v in enumerate(plain_split(r[2])))
    assert sorted(map(tuple, split_packed(cu, "cmd_args", ["id", "run_id"]).collect())) == want


def test_dense_by_key(spark, monkeypatch):
    import weftline.operators.accumulate as m

    monkeypatch.setattr(m, "FOLD_ROWS", 50)
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, -5, 2**62, None, rnd.randrange(50)]), rnd.choice([None, -(2**40), 3, 2**52]), rnd.choice([None, 7, -9])) for _ in range(1000)]
    want = {}
    for k, w, v in rows:
        n, s, top = want.get(k, (0, 0, None))
        want[k] = (n + 1, s + (w or 0), top if v is None else v if top is None else max(v, top))
    got = dense_by_key(spark.createDataFrame(rows, "k long, w long, v long"), "k", "w", "v").collect()
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    empty = spark.createDataFrame([], "k long, w long, v long")
    assert dense_by_key(empty, "k", "w", "v").count() == 0 and frequent_keys(empty, "k").count() == 0


def test_frequent_and_dependents(spark):
    rows = [(f, d, t) for f, d, t in [(1, 5, 3), (1, 5, 9), (2, 5, 4), (3, 6, None), (None, 6, 1), (4, None, 2)] for _ in range(10)]
    df = spark.createDataFrame(rows, "file_id long, dep_id long, dependency_timestamp long")
    assert {r.dep_id: (r.n_rows, r.n_dependents, r.newest_timestamp) for r in dependents(df).collect()} == {5: (30, 2, 9), 6: (20, 2, 1), None: (10, 1, 2)}
    assert {r.dep_id for r in frequent_keys(df, "dep_id", 33).collect()} == {5, 6}


def test_state_in_merged_folders(spark, monkeypatch):
    import weftline.streaming.incremental as m

    monkeypatch.setattr(m, "FAN", 2)
    units, rels, runs = history(random.Random(9))
    cu, rel = spark.createDataFrame([(*x, "clash") for x in units], CU), spark.createDataFrame(rels, REL)
    table = spark.createDataFrame(runs, "run_id int, status string")
    log = RunLog(spark, scratch_path(spark, "merged"))
    for n in range(1, 7):
        log.process(cu, rel, table, upper=n)
    last = log.manifest()
    assert [level for _, level in last["folders"]] == [2, 0], "five ended runs in folders of four and one"
    want = expected(units, rels, runs)
    assert sorted(map(tuple, log.changes().collect())) == sorted(want)
    log.vacuum()
    assert sorted(map(tuple, log.changes().collect())) == sorted(want) and log.manifest() == last
    assert log.late(cu, rel).count() == 0
    more = cu.unionByName(spark.createDataFrame([(999, 1, "a", 2, T[60], "x"), (999, 1, "a", 6, T[60], "x")], CU))
    assert [(r.run_id, r.n_now - r.n_recorded) for r in log.late(more, rel).collect()] == [(2, 1)], "a row that came to an ended run is reported, one of an open run isn't"
    # A unit that only a relation names, ties, nulls and extra columns.
    odd_units = spark.createDataFrame([(1, None, None, 1, None, "b"), (1, 5, "x", 1, None, "b"), (2, 5, None, 1, T[1], "b"), (None, 5, "x", 1, T[1], "b"), (2, 5, None, 2, T[1], "b"), (3, 5, "", 2, T[1], "b")], CU)
    odd_rels = spark.createDataFrame([(7, 1, 1, 2, T[1]), (2, None, None, 1, T[1]), (2, None, None, 2, T[1]), (None, 1, 1, 2, T[1])], REL)
    odd = RunLog(spark, scratch_path(spark, "odd"))
    odd.process(odd_units, odd_rels, spark.createDataFrame([(1, "succeeded"), (2, "succeeded"), (None, "failed")], "run_id int, status string"))
    assert [tuple(r) for r in odd.changes().collect()] == [(2, 3)]


def test_summaries_keep_what_is_frequent():
    import pyarrow as pa

    from weftline.skew import _summaries

    rnd = random.Random(4)
    keys = [rnd.choice([1] * 5 + [2] * 3 + [None, *range(3, 400)]) for _ in range(5000)] + [1] * 500 + [2] * 300
    rnd.shuffle(keys)
    for most in (4, 50, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 700], pa.int64())], names=["k"]) for i in range(0, len(keys), 700)]
        rows = [(k, n) for b in _summaries(iter(batches), most) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert rows[-1] == (None, len(keys)) and len(rows) <= most + 1
        got = dict(rows[:-1])
        for k in {x for x in keys if x is not None}:
            n = keys.count(k)
            assert n - len(keys) / (most + 1) - 1 <= got.get(k, 0) <= n
    assert list(_summaries(iter([]), 4)) == []


@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_hot_keys_of_every_kind(spark, kind):
    from weftline.skew import all_salts, hot_keys, with_salt

    value = {"long": lambda k: k, "binary": lambda k: bytes([k]), "string": str}[kind]
    rows = [(value(k), i) for i, k in enumerate([1] * 300 + [2] * 90 + list(range(3, 100)))] + [(None, 500)] * 200
    df = spark.createDataFrame(rows, f"k {kind}, v long")
    hot = hot_keys(df, "k", 80)
    assert {r.k if kind != "binary" else bytes(r.k) for r in hot.collect()} == {value(1), value(2)} and hot.few
    salted = with_salt(df, hot, "k", "v").groupBy("k", "salt").count().collect()
    assert max(r["count"] for r in salted if r.k is not None) <= 160 and sum(r["count"] for r in salted) == len(rows)
    both = with_salt(df, hot, "k", "v").join(all_salts(df.select("k").distinct(), hot, "k"), ["k", "salt"])
    assert both.count() == len(rows) - 200
    assert hot_keys(df.limit(0), "k", 80).count() == 0


def test_unrepeated_rows(spark):
    from weftline.functions.packed import unrepeated

    rows = [(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (None, 1, "x"), (None, 1, "x"), (2, 1, "p"), (2, 1, "q"), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, run int, t string")
    assert sorted(map(str, map(tuple, unrepeated(df, ["id", "run"]).collect()))) == sorted(map(str, set(rows)))
    assert unrepeated(df.limit(0), ["id"]).count() == 0


def test_scratch_tables_go_with_their_scope(spark):
    from weftline.shared import hadoop_path, release, scratch_scope, shared_dir, written

    there = lambda df: hadoop_path(spark, df.scratch)[0].exists(hadoop_path(spark, df.scratch)[1])
    out = written(spark.range(5), "out")
    with scratch_scope():
        inner = written(spark.range(3), "inner", {"n": F.count(F.lit(1))})
        assert inner.observed["n"] == 3 and there(inner)
        early = written(spark.range(3), "early")
        release(early)
        assert not there(early)
    assert there(out) and not there(inner)
    none = written(spark.range(0), "none", {"n": F.count(F.lit(1)), "s": F.sum("id")})
    assert none.observed == {"n": 0, "s": None} and none.count() == 0

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x", "getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda *_: None)}))})

    with pytest.raises(RuntimeError, match="share"):
        shared_dir(Cluster())
