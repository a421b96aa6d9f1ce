"""Evaluation texts leaking into a corpus: a prefix-filtered set join on word shingles, verified by alignment."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import written

#: Words of a shingle: of three words a stretch of the least score may have none, as every second word may have one added behind it.
SHINGLE = 2
#: Items of fewer words have shingles of one word, as one equal word is all they need; any longer stretch begins with two equal words in a row.
SHORT = 3
#: A document holds an item if it has this share of its words in one running stretch.
SHARE = 0.4
#: An aligned stretch scores 1 for an equal word and -1 for one altered, missing or added; at least this much a word.
DENSITY = 0.5
#: Item words that one pass over the corpus holds; more items take more passes.
BLOCK_WORDS = 2_000_000

_BROKEN = re.compile(r"(?<=\w)-[^\S\n]*\r?\n\s*")
_OTHER = re.compile(r"[^\x00-\x7f\w]+")
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words in UTF-8, without regard to case, punctuation, line breaks and hyphenation."""
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for c in "\u2019\u00ad\u2010\u2011":
            text = text.replace(c, "")
        text = _OTHER.sub(" ", text)
    return text.lower().encode("utf8", "replace").translate(_SPACED, b"-'").split()


def shingles(ids: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hashes) of the shingles in which every word is known, that is, its id isn't 0."""
    if len(ids) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = ids > 0
    whole = known[: len(ids) - width + 1].copy()
    for k in range(1, width):
        whole &= known[k : len(ids) - width + 1 + k]
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h ^ ids[at + k].astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
    return at, h.view(np.int64)


def least_held(n_words: int) -> int:
    """Words of an item of so many words that a stretch must cover."""
    return math.ceil(SHARE * n_words - 1e-9)


def least_shared(n_words: int, width: int = SHINGLE) -> int:
    """Places in a stretch that covers so many item words whose shingles the document has, at least.

    Each error ends a run of equal words at most, so a stretch has at least as many pairs of equal neighbours as its score less one, and
    its score is at least DENSITY a word. Of single words (1 + DENSITY) / 2 are equal at least, as one altered costs two.
    """
    return max(1, math.ceil(DENSITY * n_words - 1 - 1e-9) if width == 2 else math.ceil((1 + DENSITY) / 2 * n_words - 1e-9))


def needed(n_words: int, n_shingles: int, width: int = SHINGLE) -> int:
    """Distinct shingles that a document which holds an item of so many words and distinct shingles shares with it; a shingle that the item repeats may count once only."""
    return max(1, least_shared(least_held(n_words), width) - (n_words - width + 1 - n_shingles))


def prefix(rank: np.ndarray, n_words: int, width: int = SHINGLE) -> np.ndarray:
    """Which places of an item, with these ranks of rarity, are necessary: every document that holds the item has the shingle of one of them.

    A stretch of two times the least length or more has a half in which as large a share of places is shared. So there is a window of at least the least
    length and less than twice of it, ``least_shared`` of whose places are shared, and hence one of the rarest in it. The prefix is the union of these over all windows.
    In long items windows begin and end on a grid, and each stretch lies in the smallest that holds it.
    """
    held = least_held(n_words)
    grid = max(1, held // 24)
    padded = np.concatenate([rank, np.full(-(-n_words // grid) * grid - n_words, np.iinfo(np.int64).max)])
    out = np.zeros(len(padded), bool)
    slack = 2 * (grid - 1)
    for size in range(-(-held // grid) * grid, min(2 * held + slack, len(padded) + width - 1) + 1, grid):
        windows = np.lib.stride_tricks.sliding_window_view(padded, size - width + 1)[::grid]
        last = windows.shape[1] - least_shared(max(held, size - slack), width)
        bound = np.partition(windows, last, axis=1)[:, last]
        for k, (window, most) in enumerate(zip(windows, bound, strict=True)):
            out[k * grid : k * grid + len(window)] |= window <= most
    return out[: len(rank)]


def dense(at: np.ndarray, least: int, width: int = SHINGLE) -> bool:
    """Whether shingles at these places, in order, have ``least`` or more in a row that stand as close together as those of a stretch.

    A stretch of k equal words has (1 - DENSITY) * k words more at most, and one with k pairs of equal neighbours has (k + 1) / DENSITY equal words at most.
    """
    if len(at) < least:
        return False
    each = 2 - DENSITY if width == 1 else (2 - DENSITY) / DENSITY
    x = each * np.arange(len(at)) - at
    return bool((x[least - 1 :] - np.minimum.accumulate(x)[: len(x) - least + 1]).max() >= width - width * each - 1e-6)


def aligned(item: np.ndarray, text: np.ndarray, needed_score: float = 0) -> tuple[int, int]:
    """(item words covered, score) of the best local alignment of two word sequences; it may stop, with a lesser one, once none can reach the needed score."""
    one, low = 1 << 32, (1 << 32) - 1  # the score in the upper 32 bits, the beginning in the lower
    steps = np.arange(len(text), dtype=np.int64) * one
    gains = np.where(item[:, None] == text[None, :], one, -one)
    row = np.zeros(len(text) + 1, np.int64)
    best = (0, 0)
    for i, gain in enumerate(gains):
        fresh = low - i  # a score of 0 that begins at this row; earlier beginnings win ties
        now = np.maximum(np.where(row[:-1] >= one, row[:-1], fresh) + gain, row[1:] - one)
        now += steps
        np.maximum.accumulate(now, out=now)
        now -= steps
        now[now < one] = 0
        top = int(now.max(initial=0))
        if top >= one and (top >> 32) > best[1]:
            best = (i - (low - (top & low)) + 1, top >> 32)
        if max((top >> 32) + len(item) - i - 1, best[1]) < needed_score:
            break
        row[1:] = now
    return best


def passing(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(item words covered, score) of the best-scoring stretch that is long and dense enough; (0, 0) if there is none.

    The best local alignment may bridge a gap and then be too thin, or be too short, where another stretch passes. So every beginning is
    followed by itself. A stretch ends where its score rises above all before: no piece at either end may cost as much as it scores, so that foreign
    words around a short echo don't lengthen it. It can begin with the first word of a run of two or more, or of any run in a short item.
    """
    size, least = len(item), least_held(len(item))
    equal = item[:, None] == text[None, :]
    heads = equal.copy()
    heads[1:, 1:] &= ~equal[:-1, :-1]
    if size >= SHORT:
        heads[:-1, :-1] &= equal[1:, 1:]
        heads[-1], heads[:, -1] = False, False
    heads[size - least + 1 :] = False
    # The score in the upper 32 bits; below, counted down, the best score on the way to it.
    one, low = 1 << 32, (1 << 32) - 1
    steps = np.arange(len(text), dtype=np.int64) * one
    begun, rows = np.empty(0, np.int64), np.empty((0, len(text)), np.int64)
    best = (0, 0)
    for i in range(size):
        if len(begun):
            came = np.zeros_like(rows)
            came[:, 1:] = rows[:, :-1]
            now = np.where(came >= one, came + np.where(equal[i], one, -one), 0)
            now = np.maximum(now, rows - one)
            more = (now >> 32) > low - (now & low)
            now -= more
            held = i - begun + 1
            score = np.where(more, now >> 32, 0).max(axis=1, initial=0)
            for k in np.flatnonzero((held >= least) & (score >= DENSITY * held)):
                best = max(best, (int(score[k]), int(held[k])))
            now = np.maximum.accumulate(now + steps, axis=1) - steps
            now[now < one] = 0
            alive = now.any(axis=1)
            begun, rows = begun[alive], now[alive]
        if heads[i].any():
            begun = np.append(begun, i)
            rows = np.vstack([rows, np.where(heads[i], one + low - 1, 0)])
    return best[1], best[0]


def may_align(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether some band of diagonals has equal words in as many places of the item as a stretch must have; False only if there is no stretch.

    A stretch with g words added or missing stays in a band of g + 1 diagonals, and has g equal words more than its score at
    least, and (1 + DENSITY) / 2 equal words an item word. All equal words of a band are counted first; where they are enough, each place of the item counts once.
    """
    i, p = np.nonzero(item[:, None] == text[None, :])
    at, width, held = p - i + len(item), len(item) + len(text) + 1, least_held(len(item))
    bands = range(int((1 - DENSITY) / 2 * held), int((1 - DENSITY) * len(item)) + 1)
    least = [max((1 + DENSITY) / 2 * held, DENSITY * held + g) for g in bands]
    total = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=width))])
    if not any(int((total[w:] - total[:-w]).max()) >= n for w, n in zip((min(g + 1, width) for g in bands), least, strict=True)):
        return False
    # A place counts for the bands that begin behind its last equal word, or no more than g before this one.
    behind = np.where(np.concatenate([[False], i[1:] == i[:-1]]), np.concatenate([[0], at[:-1]]) + 1, 0)
    ends = np.bincount(at + 1, minlength=width + 1)
    return any(int(np.cumsum(np.bincount(np.maximum(at - g, behind), minlength=width + 1) - ends).max()) >= n for g, n in zip(bands, least, strict=True))


#: Counts of shingles that one row of a scan holds.
_COUNTS = 4096
_FOUND = "doc long, region int, ids binary, at binary, hashes array<long>"


def _scanned(corpus: DataFrame, key: str, text: str, vocabulary: dict[bytes, int], known: np.ndarray, least: int, reach: int, width: int) -> DataFrame:
    """Regions of documents around shingles that some item has: (key, region, ids, at, hashes).

    Rows with region -1 hold, for each task, in how many of its documents a shingle of ``hashes`` stands, as numbers in ``at``.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((vocabulary, known))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def batch(rows: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["k", "r", "i", "a", "h"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, sorted_known = shared.value
        get = voc.get
        documents = np.zeros(len(sorted_known), np.int32)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ws = words(t)
                ids = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
                at, h = shingles(ids, width)
                if not len(at):
                    continue
                place = np.searchsorted(sorted_known, h)
                place[place == len(sorted_known)] = 0
                mine = sorted_known[place] == h
                at, h, place = at[mine], h[mine], place[mine]
                documents[np.unique(place)] += 1
                if len(at) < least:
                    continue
                for n, part in enumerate(np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1)):
                    if not dense(at[part], least, width):
                        continue
                    a, z = max(0, int(at[part[0]]) - reach), int(at[part[-1]]) + width + reach
                    for col, v in zip(rows, (k, n, ids[a:z].tobytes(), (at[part] - a).astype(np.int32).tobytes(), h[part]), strict=True):
                        col.append(v)
            yield batch(rows)
        seen = np.flatnonzero(documents)
        for a in range(0, len(seen), _COUNTS):
            part = seen[a : a + _COUNTS]
            yield batch(([None], [-1], [None], [documents[part].tobytes()], [sorted_known[part]]))

    return corpus.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(scan, _FOUND)


def _frequencies(found: DataFrame) -> DataFrame:
    """(shingle, df): in how many documents of the whole corpus each shingle stands."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(np.frombuffer(raw, np.int32).astype(np.int64))], names=["s", "n"])

    counts = found.where("region = -1").select("at", "hashes").mapInArrow(unpack, "shingle long, n long")
    return counts.groupBy("shingle").agg(F.sum("n").alias("df"))


def _index(items: dict[int, np.ndarray], df: dict[int, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, bounds, items): the inverted index of the items' necessary prefixes, shingles ordered by rarity over the corpus."""
    pairs = []
    for i, w in items.items():
        h = shingles(w, width)[1]
        n = np.array([df.get(int(x), 0) for x in h], np.int64)
        order = np.lexsort((h, n))
        rank = np.empty(len(h), np.int64)
        # Equal shingles share a rank, so a place is in the prefix whenever an equal one is.
        rank[order] = np.concatenate([[0], np.cumsum((np.diff(n[order]) != 0) | (np.diff(h[order]) != 0))])
        pairs += [(int(x), i) for x in np.unique(h[prefix(rank, len(w), width)])]
    pairs.sort()
    hashes = np.array([x for x, _ in pairs], np.int64)
    keys, first = np.unique(hashes, return_index=True)
    return keys, np.append(first, len(hashes)), np.array([i for _, i in pairs], np.int64)


def _verified(regions: DataFrame, items: dict[int, np.ndarray], index: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(doc, item, held, n_words, score) of the regions (doc, ids, at, hashes) that hold an item: candidates by the prefix, then bounds on places, then alignment."""
    shared = regions.sparkSession.sparkContext.broadcast((items, index))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, (keys, first, owners) = shared.value
        own: dict[int, np.ndarray] = {}
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, raw, raw_at, hashes in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                ids, at, h = np.frombuffer(raw, np.int32), np.frombuffer(raw_at, np.int32), np.array(hashes, np.int64)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                rare = np.unique(place[keys[place] == h])
                among = np.unique(np.concatenate([owners[first[x] : first[x + 1]] for x in rare])) if len(rare) else ()
                for i in map(int, among):
                    w = texts[i]
                    mine = own[i] if i in own else own.setdefault(i, np.unique(shingles(w, width)[1]))
                    size, least = len(w), needed(len(w), len(mine), width)
                    place = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                    hit = mine[place] == h
                    p, q = at[hit], h[hit]
                    if len(p) < least:
                        continue
                    # Hits further apart than any two neighbours in a stretch are in different windows. A stretch begins and ends with a hit,
                    # as any other beginning or end would score no more than it costs.
                    for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > size + width) + 1):
                        if not dense(p[part], least, width) or len(np.unique(q[part])) < least:
                            continue
                        window = ids[int(p[part[0]]) : int(p[part[-1]]) + width]
                        if not may_align(w, window):
                            continue
                        held, score = aligned(w, window, DENSITY * least_held(size))
                        if score >= DENSITY * least_held(size) and (held < least_held(size) or score < DENSITY * held):
                            held, score = passing(w, window)
                        if held >= least_held(size) and score >= DENSITY * held:
                            for col, v in zip(rows, (doc, i, held, size, score), strict=True):
                                col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["a", "b", "c", "d", "e"])

    return regions.select("doc", "ids", "at", "hashes").mapInArrow(verify, "doc long, item long, held long, n_words long, score long")


def _block(corpus: DataFrame, key: str, text: str, rows: list[tuple[int, str]], width: int) -> DataFrame | None:
    """The leaks of one block of items, those that have shingles of this width."""
    vocabulary: dict[bytes, int] = {}
    items = {}
    for i, t in rows:
        ws = words(t or "")
        if ws and (len(ws) < SHORT) == (width == 1):
            items[i] = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32)
    if not items:
        return None
    own = {i: np.unique(shingles(w, width)[1]) for i, w in items.items()}
    known = np.unique(np.concatenate(list(own.values())))
    least, reach = min(needed(len(items[i]), len(h), width) for i, h in own.items()), max(map(len, items.values()))
    found = written(_scanned(corpus, key, text, vocabulary, known, least, reach, width), "regions")
    # At most the shingles of one block of items.
    counts = _frequencies(found).toArrow()
    df = dict(zip(counts["shingle"].to_pylist(), counts["df"].to_pylist(), strict=True))
    spread = found.where("region >= 0").repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "region")
    return _verified(spread, items, _index(items, df, width), width)


def leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, held, n_words): documents that hold at least SHARE of an item's words in one running stretch.

    Items are taken in blocks of about ``block_words`` words, which bounds what a task and the driver hold; each block is one pass over whole
    documents, and one more if it has items of fewer than SHORT words. The pass keeps regions around shingles that some item has, and counts
    in how many documents of the whole corpus each shingle stands. These frequencies order shingles by rarity, and each item's necessary prefix goes
    into an inverted index, which is broadcast to the regions, so a frequent shingle gathers no rows anywhere. A candidate must then
    share enough shingles within windows of the item's size and in a band of places, and is verified by aligning item and window word by word. Null texts hold
    nothing; an item without words is held by none; a null key is kept as null. Repeated documents or items give one row each pair.
    """
    spark = corpus.sparkSession
    known = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    size = known.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = max(1, -(-int(size) // block_words))
    out = None
    for b in range(n):
        rows = [(r[0], r[1]) for r in known.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).orderBy("i", "t").collect()]
        for width in (SHINGLE, 1):
            part = _block(corpus, key, text, rows, width)
            if part is not None:
                out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc long, item long, held long, n_words long")
    return out.groupBy("doc", "item").agg(F.max("held").alias("held"), F.max("n_words").alias("n_words"))
