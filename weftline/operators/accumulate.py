"""Per-key results without imbalance: dense accumulator arrays over equal input splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task buffers before it folds them into its accumulators.
FOLD_ROWS = 1 << 20
_BLOCK = "block int, ids binary, counts binary, weights binary, newest binary"
_LEAST = np.iinfo(np.int64).min


class Accumulators:
    """A sorted dictionary of keys and, by code, dense arrays: rows, summed weights and the greatest value."""

    def __init__(self) -> None:
        self.ids = np.empty(0, np.int64)
        self.counts = self.weights = self.newest = self.ids
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, newest: np.ndarray) -> None:
        self.waiting.append((ids, counts, weights, newest))
        self.rows += len(ids)
        if self.rows >= max(FOLD_ROWS, len(self.ids)):
            self.fold()

    def fold(self) -> None:
        """Encodes what waits by the merged dictionary and scatter-reduces it into new arrays."""
        if not self.waiting:
            return
        ids, counts, weights, newest = (np.concatenate(x) for x in zip((self.ids, self.counts, self.weights, self.newest), *self.waiting, strict=True))
        self.ids, code = np.unique(ids, return_inverse=True)
        size = len(self.ids)
        self.counts = _exact_sums(code, counts, size)
        self.weights = _exact_sums(code, weights, size)
        self.newest = np.full(size, _LEAST)
        np.maximum.at(self.newest, code, newest)
        self.waiting, self.rows = [], 0


def _exact_sums(code: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """bincount with 64-bit integer weights, in two halves as its sums are doubles."""
    low = np.bincount(code, values & 0xFFFFFF, size).astype(np.int64)
    return low + (np.bincount(code, values >> 24, size).astype(np.int64) << 24)


def _blocks(acc: Accumulators, n_blocks: int) -> Iterator[pa.RecordBatch]:
    acc.fold()
    mixed = (acc.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    block = (mixed % np.uint64(n_blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        cols = [[x[part].tobytes()] for x in (acc.ids, acc.counts, acc.weights, acc.newest)]
        yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["block", "ids", "counts", "weights", "newest"])


def dense_by_key(df: DataFrame, key: str, weight: str | None = None, newest: str | None = None) -> DataFrame:
    """(key long, n_rows long, weight long, newest long) for each value of an integer key.

    Every input split encodes its keys in a sorted dictionary and counts, sums ``weight`` (an integer, 1 a row if not
    given) and takes the greatest ``newest`` by scatter-reduce into dense arrays. So a split sends one entry per key however many
    rows the key has. The arrays go out in blocks of keys by hash, and a block's arrays are merged the same way, one after the other,
    in one task of the reduction. A null key is a key of its own; null weights count 0; ``newest`` is null if all values are.
    """
    n_blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.select(
        F.col(key).cast("long").alias("id"),
        (F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1)).cast("long").alias("w"),
        F.coalesce(F.col(newest).cast("long"), F.lit(_LEAST)).alias("m") if newest else F.lit(_LEAST).alias("m"),
    )
    known, unknown = cols.where(F.col("id").isNotNull()), cols.where(F.col("id").isNull())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulators()
        for b in batches:
            ids, w, m = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            acc.add(ids, np.ones(len(ids), np.int64), w, m)
        yield from _blocks(acc, n_blocks)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, at = Accumulators(), None
        for b in batches:
            for row in range(b.num_rows):
                if at is not None and b.column(0)[row].as_py() != at:
                    yield _result(acc)
                    acc = Accumulators()
                at = b.column(0)[row].as_py()
                acc.add(*[np.frombuffer(b.column(i)[row].as_buffer(), np.int64) for i in range(1, 5)])
        if at is not None:
            yield _result(acc)

    parts = known.mapInArrow(split, _BLOCK).repartition(n_blocks, "block").sortWithinPartitions("block")
    out = parts.mapInArrow(reduce, "id long, n_rows long, weight long, newest long")
    null = unknown.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("weight"), F.max("m").alias("newest")).where(F.col("n_rows") > 0)
    both = out.unionByName(null.select(F.lit(None).cast("long").alias("id"), "n_rows", "weight", "newest"))
    return both.select(F.col("id").alias(key), "n_rows", "weight", F.when(F.col("newest") != _LEAST, F.col("newest")).alias("newest"))


def _result(acc: Accumulators) -> pa.RecordBatch:
    acc.fold()
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (acc.ids, acc.counts, acc.weights, acc.newest)], names=["id", "n_rows", "weight", "newest"])


def frequent_keys(df: DataFrame, key: str, percent: int = 2) -> DataFrame:
    """Keys that hold at least ``percent`` per cent of all rows, with their counts. A null key counts as a key."""
    total = df.count()
    return dense_by_key(df, key).where(F.col("n_rows") * 100 >= F.lit(total) * percent).select(key, "n_rows")


def dependents(relations: DataFrame) -> DataFrame:
    """(dep_id, n_rows, n_dependents, newest_timestamp): rows, distinct dependents and the newest dependency_timestamp of each dep_id.

    Pairs are made distinct first; as a pair's key holds both ids, a hot dep_id spreads over all tasks there. A null file_id
    counts as one dependent.
    """
    pairs = relations.groupBy("dep_id", "file_id").agg(F.count(F.lit(1)).alias("pair_rows"), F.max("dependency_timestamp").alias("pair_newest"))
    d = dense_by_key(pairs, "dep_id", "pair_rows", "pair_newest")
    return d.select("dep_id", F.col("weight").alias("n_rows"), F.col("n_rows").alias("n_dependents"), F.col("newest").alias("newest_timestamp"))
