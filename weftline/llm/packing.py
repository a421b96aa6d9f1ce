"""Filling fixed-capacity containers: bounded-space online best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import written

#: A public byte-level BPE vocabulary; the path is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_BINS = 512
#: A share's last open containers stay partly empty, so a share must hold many times as many items as it has open containers.
ITEMS_PER_TASK = 50_000


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of each text; a null text has 0 tokens. Strings of special tokens count as ordinary text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["k", "n"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("t")).mapInArrow(count, f"{key} long, n_tokens long")


class BestFit:
    """At most ``most`` open containers; bit f of ``free`` is set if one has f units left."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next = capacity, most, first_id
        self.free, self.by_free, self.n_open = 0, {}, 0

    def _take(self, f: int) -> int:
        ids = self.by_free[f]
        bin_id = ids.pop()
        if not ids:
            del self.by_free[f]
            self.free ^= 1 << f
        self.n_open -= 1
        return bin_id

    def put(self, size: int) -> int:
        """The container that an item of at most the capacity goes into: the fullest in which it fits, else a new one.

        A new one beyond the bound closes the fullest open container first.
        """
        fits = self.free >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(f)
        else:
            if self.n_open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            f, bin_id = self.capacity, self.next
            self.next += 1
        left = f - size
        if left:
            if left in self.by_free:
                self.by_free[left].append(bin_id)
            else:
                self.by_free[left] = [bin_id]
                self.free |= 1 << left
            self.n_open += 1
        return bin_id


def pack(sizes: DataFrame, key: str, capacities: list[tuple[int, int]], open_bins: int = OPEN_BINS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(pack_id, container_id, key, piece, start, n_tokens): every item's place for each capacity.

    sizes: (key, n_tokens), keys unique. An item above the capacity is cut into full containers and a rest, which is packed as an item;
    no other item is cut. Items without units go where they fit. Each task packs its own share of items, by hash and
    then order of key, so a task that runs again gives the same containers; a share leaves at most ``open_bins`` containers that others
    might have filled. Null sizes count 0; capacities that are null or below 1 are left out.
    """
    caps = [(int(p), int(c)) for p, c in capacities if p is not None and c is not None and c > 0]
    n = sizes.count()
    tasks = max(1, -(-n // items_per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = [(p, c, BestFit(c, open_bins, base)) for p, c in caps]
        for b in batches:
            keys, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for pack_id, cap, fit in bins:
                for k, size in zip(keys, counts, strict=True):
                    at = piece = 0
                    while True:
                        part = min(size - at, cap)
                        for col, v in zip(rows, (pack_id, fit.put(part), k, piece, at, part), strict=True):
                            col.append(v)
                        at, piece = at + part, piece + 1
                        if at >= size:
                            break
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["a", "b", "c", "d", "e", "f"])

    shares = sizes.select(F.col(key).cast("long").alias(key), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    shares = shares.repartition(tasks, key).sortWithinPartitions(key, "n_tokens")
    return shares.mapInArrow(place, f"pack_id int, container_id long, {key} long, piece int, start long, n_tokens long")


def pack_texts(df: DataFrame, key: str, text: str, packs: DataFrame, tokenizer: str = TOKENIZER, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pack`` over token counts. packs: (pack_id, capacity), a fixed handful of rows."""
    return pack(written(token_counts(df, key, text, tokenizer), "sizes"), key, capacities_of(packs), open_bins)


def capacities_of(packs: DataFrame) -> list[tuple[int, int]]:
    """The distinct (pack_id, capacity) rows, a fixed handful."""
    return [(r[0], r[1]) for r in packs.select("pack_id", "capacity").distinct().orderBy("pack_id").collect()]


def checked(placed: DataFrame, sizes: DataFrame, key: str, packs: DataFrame) -> DataFrame:
    """Per pack what must hold of any arrangement: containers above the capacity, items cut though they fit, items not placed whole (all 0), and items placed."""
    caps = F.broadcast(packs.select("pack_id", "capacity"))
    full = placed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("used")).join(caps, "pack_id")
    over = full.groupBy("pack_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_over"))
    n, piece = F.col("n_tokens"), F.col("piece")
    per = placed.groupBy("pack_id", key).agg(F.count(F.lit(1)).alias("pieces"), F.sum(n).alias("placed"), F.max(F.col("start") + n).alias("end"), F.max(piece).alias("last"))
    items = per.join(sizes.select(key, F.col("n_tokens").alias("size")), key, "left").join(caps, "pack_id")
    whole = (F.col("placed") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("last") + 1 == F.col("pieces"))
    cut = items.groupBy("pack_id").agg(
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_cut"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_broken"), F.count(F.lit(1)).alias("n_items")
    )
    return over.join(cut, "pack_id").select("pack_id", "n_over", "n_cut", "n_broken", "n_items")


def fill(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, units used and the share of space used."""
    per = placed.groupBy("pack_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(F.broadcast(packs.select("pack_id", "capacity")), "pack_id").withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
