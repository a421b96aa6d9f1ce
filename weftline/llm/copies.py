"""Copies hidden by formatting differences: one record per canonical key, with counts and a representative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.shared import written
from weftline.skew import hinted, hot_keys, with_salt

FIELDS = ("directory", "command", "file")
#: A group with more records than this is salted.
ROWS_PER_SPLIT = 50_000


def canonical(text: Column) -> Column:
    """The letters and digits of a text, without regard to case."""
    # The strip stands between the two mappings, as the optimizer would take lower(upper(x)) for lower(x).
    return F.lower(F.regexp_replace(F.upper(text), r"[^\p{L}\p{Nd}]+", ""))


def record_fields(record: Column) -> Column:
    """array<struct<k,v>> of a compile-command entry: JSON, ``key = value`` parts set off by semicolons, or ``Key: "value"`` lines.

    Names of fields count without regard to case and their order doesn't matter. JSON may have commas too many. A record in
    none of these notations gives an empty array.
    """
    tidy = F.regexp_replace(F.regexp_replace(record, r",(?=\s*\}\s*,?\s*$)", ""), r",\s*$", "")
    parsed = F.from_json(tidy, "map<string,string>")
    name = "|".join(FIELDS)
    lines = F.regexp_extract_all(record, F.lit(rf'(?im)^\s*({name})\s*:\s*"(.*)"\s*$'), F.lit(0))
    parts = F.regexp_extract_all(record, F.lit(rf"(?is)(?:^|;)\s*(?:{name})\s*=.*?(?=;\s*(?:{name})\s*=|$(?!\n))"), F.lit(0))
    flat = F.when(F.size(lines) > 0, lines).otherwise(parts)
    pair = F.transform(
        flat, lambda x: F.struct(F.lower(F.regexp_extract(x, rf"(?i)({name})", 1)).alias("k"), F.regexp_replace(x, r"^[;\s]*\w+\s*[:=]", "").alias("v"))
    )
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return F.when(F.ltrim(record).startswith("{") & parsed.isNotNull(), entries).otherwise(pair)


def field_of(fields: Column, name: str) -> Column:
    """The first value of a field; the empty text if it has none."""
    return F.coalesce(F.get(F.filter(fields, lambda e: e["k"] == name), 0)["v"], F.lit(""))


def record_key(record: Column) -> Column:
    """The three field values of an entry in canonical form, in fixed order."""
    fields = record_fields(record)
    return F.concat_ws("\u0001", *[canonical(field_of(fields, f)) for f in FIELDS])


def keyed(df: DataFrame, src: str, record_id: str, key: Column) -> DataFrame:
    """(src, id, key): the key is a 128-bit digest of source and canonical text. Rows with a null text or id have no key and go."""
    return df.select(F.lit(src).alias("src"), F.col(record_id).cast("long").alias("id"), key.alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(
        "src", "id", F.unhex(F.md5(F.concat_ws("\u0002", "src", "text"))).alias("key")
    )


def grouped(df: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(src, key, id, keep_id, n_copies): each distinct record with its group's smallest id and number of distinct records.

    Keys with more than ``rows_per_split`` rows are found from partial counts of the input splits. Their records are aggregated by (key, salt) and
    then by key, and the few results go back to their records. All other records meet their group in one shuffle.
    A record that comes several times with one key counts once.
    """
    hot = hot_keys(df, "key", rows_per_split)
    cold = df.join(hinted(hot), "key", "left_anti").repartition("key").dropDuplicates(["key", "id"])
    w = W.partitionBy("key")
    cold = cold.select("src", "key", "id", F.min("id").over(w).alias("keep_id"), F.count(F.lit(1)).over(w).alias("n_copies"))
    many = with_salt(df.join(hinted(hot), "key", "left_semi"), hot, "key", "id").groupBy("src", "key", "salt", "id").agg(F.lit(1).alias("one")).drop("one")
    first = many.groupBy("src", "key", "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    second = first.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n_copies"))
    second = F.broadcast(second) if hot.few else second.hint("merge")
    return cold.unionByName(many.join(second, "key").select("src", "key", "id", "keep_id", "n_copies"))


def copies(df: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(src, keep_id, copy_id): every record but its group's representative."""
    return grouped(df, rows_per_split).where(F.col("id") != F.col("keep_id")).select("src", "keep_id", F.col("id").alias("copy_id"))


def collapsed(df: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(src, keep_id, n_copies): one row per group."""
    return grouped(df, rows_per_split).where(F.col("id") == F.col("keep_id")).select("src", "keep_id", "n_copies")


def all_keyed(files: DataFrame, commands: DataFrame, raw: DataFrame) -> DataFrame:
    """The three sources of copies in one table of short keys, written once so that texts are read and parsed once."""
    parts = [
        keyed(files, "files", "id", canonical(F.col("path"))),
        keyed(commands, "compile_commands", "id", canonical(F.col("file"))),
        keyed(raw, "raw_commands", "record_id", F.when(F.col("record").isNotNull(), record_key(F.col("record")))),
    ]
    return written(reduce(DataFrame.unionByName, parts), "keyed")
