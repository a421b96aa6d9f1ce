"""The text operators against brute force, planted cases and awkward inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import copies as C
from weftline.llm import leaks as L
from weftline.llm import packing as P
from weftline.llm import reading as R


def key(text):
    return re.sub(r"[\W_]+", "", text.upper().lower())


@pytest.mark.parametrize("split", [5, 1_000_000])
def test_copies(spark, split):
    rnd = random.Random(1)
    base = ["a/b.c", "C:/x", "ÖL/t_1", "q"]
    texts = [rnd.choice(["a/b.c", "A\\B.C", " a b_c ", "ab-C", "a.b/c", *base, "", "..", None, "Straße", "STRASSE", "z" * 50_000]) for _ in range(400)]
    rows = [(rnd.randrange(300) if rnd.random() < 0.95 else None, t, "clash", "clash") for t in texts]
    df = spark.createDataFrame(rows, "id long, path string, key string, salt string")
    k = C.keyed(df, "files", "id", C.canonical(F.col("path")))
    groups = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            groups.setdefault(key(t), set()).add(i)
    want = sorted(("files", min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(map(tuple, C.copies(k, split).collect())) == want
    assert sorted(map(tuple, C.collapsed(k, split).collect())) == sorted(("files", min(g), len(g)) for g in groups.values())
    assert C.copies(k.limit(0), split).count() == 0


def test_notations_of_one_record(spark):
    same = [
        '{"directory": "C:/w", "command": "cc -c a.c", "file": "a.c"}',
        '{"FILE":"A.C","DIRECTORY":"C:\\\\w","COMMAND":"cc  -c a.c "},',
        '{\n  "command" :  "cc -c a.c",\n  "file" :  "a.c",\n  "directory" :  "C:/w",\n}',
        "command = cc -c a.c; file = a.c; directory = C:\\w",
        'File: "a.c"\nDirectory: "c:/W"\nCommand: "CC -C a.c"',
        '{"directory": "C:/w", "command": "cc \\u002dc a\\n.c", "file": "a.c"}',
    ]
    other = ['{"directory": "C:/w", "command": "cc -c a.c", "file": "b.c"}', '{"directory": "C:/wcc", "command": "-c a.c", "file": "a.c"}', "nothing", "", "{broken", None]
    df = spark.createDataFrame(list(enumerate(same + other)), "i int, r string")
    keys = {r[0]: r[1] for r in df.select("i", C.record_key(F.col("r"))).collect()}
    assert {keys[i] for i in range(len(same))} == {"cw\u0001ccca" + "c\u0001ac"}
    assert keys[len(same)] != keys[0] != keys[len(same) + 1]


def best_fit(sizes, capacity, most):
    bins, used, out = [], {}, []
    for size in sizes:
        fits = [b for b in bins if used[b] + size <= capacity]
        if fits:
            b = max(fits, key=lambda x: used[x])
        else:
            if len(bins) >= most:
                bins.remove(max(bins, key=lambda x: used[x]))
            b = len(used)
            used[b] = 0
            bins.append(b)
        used[b] += size
        if used[b] == capacity:
            bins.remove(b)
        out.append(used[b])
    return sorted(used.values()), out


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit_is_the_plain_one(most):
    rnd = random.Random(most)
    sizes = [rnd.randrange(0, 41) for _ in range(500)]
    fit, used = P.BestFit(40, most, 7), {}
    for s in sizes:
        b = fit.put(s)
        used[b] = used.get(b, 0) + s
        assert fit.n_open <= most
    assert sorted(used.values()) == best_fit(sizes, 40, most)[0]


def test_pack_keeps_all_and_cuts_only_what_is_too_long(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 1, 5, 30, 64, 65, 128, 1000, None])) for i in range(300)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, n_tokens long, pack_id string")
    rows = P.pack(df, "doc_id", [(1, 64), (2, 256), (3, None), (4, 0)], 8, items_per_task=120).collect()
    assert {r.pack_id for r in rows} == {1, 2}
    for pack_id, cap in ((1, 64), (2, 256)):
        mine = [r for r in rows if r.pack_id == pack_id]
        full = {}
        for r in mine:
            full[r.container_id] = full.get(r.container_id, 0) + r.n_tokens
        assert max(full.values()) <= cap
        for i, n in sizes:
            parts = sorted((r for r in mine if r.doc_id == i), key=lambda r: r.piece)
            assert sum(r.n_tokens for r in parts) == (n or 0) and [r.start for r in parts] == [k * cap for k in range(len(parts))]
            assert len(parts) == max(1, -(-(n or 0) // cap))
    again = P.pack(df, "doc_id", [(1, 64), (2, 256)], 8, items_per_task=120).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert P.pack(df.limit(0), "doc_id", [(1, 64)]).count() == 0


def test_token_counts(spark):
    texts = ["", None, "Hello world", "<|endoftext|>", "ä" * 1000, "x" * 200_000]
    got = {r.doc_id: r.n_tokens for r in P.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] > 1 and got[5] > 1000


def leak_case(seed):
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.choice([50, 80])))) for i in range(12)]
    filler = lambda n: " ".join(f"f{rnd.randrange(3000)}" for _ in range(n))
    docs, want = [], set()
    for d in range(80):
        i, t = rnd.choice(items)
        w = t.split()
        part = rnd.choice([0.2, 0.3, 0.55, 0.7, 1.0])
        n = int(len(w) * part)
        at = rnd.randrange(len(w) - n + 1)
        piece = w[at : at + n]
        style = rnd.choice(["plain", "upper", "altered", "wrapped", "shuffled"])
        if style == "altered":
            piece = [x for k, x in enumerate(piece) for x in ((["zzz"], [], [x, "yyy"])[k % 3] if k % 9 == 8 else [x])]
        if style == "shuffled":
            rnd.shuffle(piece)
        text = (",\n " if style == "wrapped" else " ").join(piece)
        docs.append((d, f"{filler(60)}. {text.upper() if style == 'upper' else text}! {filler(90)}", "clash"))
        if part > 0.5 and style != "shuffled":
            want.add((d, i))
    return items, docs, want


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_leaks(spark, block):
    items, docs, want = leak_case(4)
    docs += [(900, "", "x"), (901, None, "x"), (902, items[0][1], "x"), (902, items[0][1], "x"), (903, "f1 " * 100_000 + items[1][1] + " f2" * 100_000, "x")]
    more = [*items, (77, ""), (78, None), (79, "too short"), (None, items[2][1])]
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(more, "item_id long, text string"), block_words=block).collect()
    assert len(got) == len({(r.doc, r.item) for r in got})
    assert {(r.doc, r.item) for r in got} == want | {(902, items[0][0]), (903, items[1][0])}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 50)], "item_id long, text string")
    assert L.leaks(docs.limit(0), items).count() == 0
    assert L.leaks(docs, items.limit(0)).count() == 0


def test_words():
    assert L.words("Long-\n  awaited, the (Ampli\ufb01er)\u2019s\tend_of") == [b"longawaited", b"the", b"amplifier", b"s", b"end", b"of"]
    assert L.words("long-awaited it's") == L.words("LONGAWAITED its")


def test_alignment_is_the_plain_one():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = (np.array([rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 15))], np.int32) for _ in "ab")
        h, top = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
                top = max(top, h[i + 1, j + 1])
        assert L.aligned(a, b)[1] == top


def level_text(rnd, level, n=12):
    plain = ["pin", "cap", "rod", "lid", "cup", "bar", "mat", "peg"]
    words = plain + [f"hard{k}" for k in range(8)] * (level - 1)
    body = " ".join(" ".join(rnd.choice(words) for _ in range(7 * level + rnd.randrange(-1, 2))).capitalize() + " the." for _ in range(n))
    return f"Title\n\nABSTRACT\n{body}\n\nCLAIMS\n1. {'very long claim words ' * 60}"


def test_reading_levels(spark):
    rnd = random.Random(5)
    truth = {i: rnd.randrange(1, 5) for i in range(300)}
    docs = [(i, level_text(rnd, v), "x") for i, v in truth.items()] + [(900, "", "x"), (901, None, "x"), (902, "12 34", "x"), (903, level_text(rnd, 1, 4000), "x")]
    labels = [(i, "r", v if rnd.random() < 0.9 else rnd.randrange(1, 5)) for i, v in truth.items() if i % 3 == 0] + [(0, "r", None), (None, "r", 2), (5, "r", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, level string")
    got = R.reading_levels(df, spark.createDataFrame(labels, "doc_id long, reader string, level int")).collect()
    by = {r.doc: r.level for r in got}
    assert len(got) == len(by) == 302 and 900 not in by and 901 not in by
    rest = [i for i in truth if i % 3]
    assert sum(by[i] == truth[i] for i in rest) >= 0.97 * len(rest) and by[902] == by[903] == 1
    bare = R.reading_levels(df, spark.createDataFrame([], "doc_id long, reader string, level int")).collect()
    assert {r.level for r in bare} == {1, 2, 3, 4}
    assert R.reading_levels(df.limit(0), spark.createDataFrame(labels, "doc_id long, reader string, level int")).count() == 0


def test_held_out_levels_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "reading_labels"))
    fit, test = (labels.where(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1))
    joined = R.reading_levels(docs, fit).select(F.col("doc").alias("doc_id"), F.col("level").alias("found")).join(test, "doc_id").collect()
    assert sum(r.found == r.level for r in joined) >= 0.85 * len(joined)


def test_profile(spark):
    levels = spark.createDataFrame([(1, 2, 0.0, 9.0, 0.5), (2, 2, 0.0, 11.0, 0.1)], "doc long, level int, score double, length double, unfamiliar double")
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, source string")
    assert tuple(R.level_profile(levels, docs).first())[:4] == ("a", 2, 2, 10.0)


def test_leaks_with_a_word_altered_every_few_words(spark):
    # Equal runs as in a true case of the tables: few whole shingles of five words are left, the score is 0.67 a word.
    item = [f"w{k}" for k in range(76)]
    held, at = [], 18
    for n, run in enumerate((6, 2, 6, 5, 4, 4, 4, 5, 4)):
        held += [*item[at : at + run], *(["zzz"] if n not in (3, 8) else [])]
        at += run + 1
    # A word added behind every second word, which is the least score there is.
    added = [x for k in range(0, 40, 2) for x in (item[k], item[k + 1], "yyy")]
    fill = [f"f{k}" for k in range(300)]
    docs = [(1, " ".join(fill + held + fill)), (2, " ".join(fill + added + fill)), (3, " ".join(fill + item[:29] + fill))]
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc, r.item) for r in found} == {(1, 7), (2, 7)}


def plain_passing(a, b):
    """Whether some stretch passes, by all paths from every beginning as (score, best score on the way); it ends where the score rises above all before."""
    least = L.least_held(len(a))
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            if least == 1:
                return True
            at = {(i, j): {(1, 1)}}
            for x in range(i, len(a)):
                for y in range(j, len(b)):
                    new = set(at.get((x, y), ()))
                    for px, py, d in ((x - 1, y - 1, 1 if a[x] == b[y] else -1), (x - 1, y, -1), (x, y - 1, -1)):
                        for s, m in at.get((px, py), ()):
                            if s + d > m and x - i + 1 >= least and s + d >= L.DENSITY * (x - i + 1):
                                return True
                            if s + d > 0:
                                new.add((s + d, max(m, s + d)))
                    at[x, y] = new
    return False


def test_passing_is_the_plain_one():
    rnd, seen = random.Random(6), set()
    for _ in range(150):
        a, b = (np.array([rnd.randrange(1, 7) for _ in range(rnd.randrange(6, 16))], np.int32) for _ in "ab")
        held, score = L.passing(a, b)
        assert (held > 0) == plain_passing(a, b) and (held == 0 or (held >= L.least_held(len(a)) and score >= L.DENSITY * held))
        seen.add(held > 0)
    assert seen == {True, False}


def test_leaks_in_pieces_close_together(spark):
    item = [f"w{k}" for k in range(108)]
    foreign, fill = [f"g{k}" for k in range(28)], [f"f{k}" for k in range(200)]
    bodies = [item[:45] + foreign + item[73:], item[:45] + item[73:], item[:30] + foreign + item[78:], item[:30] + fill[:28] + item[90:]]
    docs = [(k, " ".join(fill + x + fill)) for k, x in enumerate(bodies)]
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc, r.held) for r in found} == {(0, 45), (1, 45)}


def test_leaks_late_in_a_long_item(spark):
    item = [f"w{k}" for k in range(9000)]
    ids = np.arange(1, 9001, dtype=np.int32)
    assert L.aligned(ids, ids[5300:]) == (3700, 3700)
    docs = spark.createDataFrame([(1, " ".join(["f", *item[5300:], "f"])), (2, " ".join(item[5500:]))], "doc_id long, text string")
    found = L.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc, r.held) for r in found] == [(1, 3700)]


def test_short_items(spark):
    rnd = random.Random(11)
    items = {n * 10 + k: [f"w{rnd.randrange(9)}" for _ in range(n)] for n in range(1, 13) for k in range(3)}
    docs = {d: [f"w{rnd.randrange(14)}" for _ in range(rnd.randrange(1, 14))] for d in range(40)}
    found = L.leaks(
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    ).collect()
    got = {(r.doc, r.item) for r in found}
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if plain_passing(w, t)}
    assert want and got == want


def test_prefix_meets_every_stretch():
    rnd = np.random.default_rng(5)
    for _ in range(400):
        n, width = int(rnd.integers(6, 90)), int(rnd.integers(1, 3))
        rank = rnd.integers(0, n, n - width + 1)
        places = L.prefix(rank, n, width)
        size = int(rnd.integers(L.least_held(n), n + 1))
        at = int(rnd.integers(0, n - size + 1))
        inside = np.arange(at, at + size - width + 1)
        shared = inside[np.argsort(-rank[inside])][: L.least_shared(size, width)]
        assert places[shared].any(), "the most frequent places that a stretch can share"


def test_arrangement_check_sees_faults(spark):
    packs = spark.createDataFrame([(1, 10)], "pack_id int, capacity int")
    sizes = spark.createDataFrame([(1, 4), (2, 25), (3, 7), (4, 3)], "doc long, n_tokens long")
    good = P.pack(sizes, "doc", [(1, 10)])
    assert tuple(P.checked(good, sizes, "doc", packs).first()) == (1, 0, 0, 0, 4)
    bad = spark.createDataFrame([(1, 0, 1, 0, 0, 4), (1, 0, 3, 0, 0, 7), (1, 1, 4, 0, 0, 1), (1, 2, 4, 1, 1, 2), (1, 3, 2, 0, 0, 10)], good.schema)
    assert tuple(P.checked(bad, sizes, "doc", packs).first()) == (1, 1, 1, 1, 4)


def test_labels_beyond_the_histogram_count(spark):
    feats = spark.createDataFrame([(i, float(10 * lv), 0.1) for i, lv in enumerate([1, 2, 3, 4] * 20)] + [(99, 1e7, 0.9)], "doc long, length double, unfamiliar double")
    labels = spark.createDataFrame([(i, lv) for i, lv in enumerate([1, 2, 3, 4] * 20)] + [(99, 4)], "doc_id long, level int")
    weights, cuts = R.fitted(feats, labels)
    assert len(weights) == 3 and len(cuts) == 3
