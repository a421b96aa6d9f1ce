"""Queries of the text problems 5 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.copies import all_keyed, collapsed, copies
from weftline.llm.leaks import leaks
from weftline.llm.packing import capacities_of, checked, fill, pack, pack_texts, token_counts
from weftline.llm.reading import level_profile, reading_levels
from weftline.shared import written
from weftline.sources.tables import table


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return all_keyed(table(spark, d, "files"), table(spark, d, "compile_commands"), table(spark, d, "raw_commands"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(_keyed(spark, d)).distinct()


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(_keyed(spark, d))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p6_packing(spark, d), table(spark, d, "pack_sizes"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the whole arrangement, counted over every container and every document."""
    packs = table(spark, d, "pack_sizes")
    sizes = written(token_counts(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    placed = written(pack(sizes, "doc_id", capacities_of(packs)), "placed")
    return checked(placed, sizes, "doc_id", packs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item that leaked, with the number of documents that hold it and the greatest share held."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.col("held") / F.col("n_words")).alias("most_held"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select(F.col("doc").alias("doc_id"), "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return level_profile(reading_levels(docs, table(spark, d, "reading_labels")), docs)


QUERIES = {
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}

_PLAIN = "regexp_replace(lower(upper({})), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


def _field(name: str) -> str:
    quoted = f"regexp_extract(record, '(?i)[\"]?{name}[\"]?\\s*:\\s*\"([^\"]*)\"', 1)"
    bare = f"regexp_extract(record, '(?i)(?:^|;)\\s*{name}\\s*=([^;]*)', 1)"
    return _PLAIN.format(f"CASE WHEN {quoted} <> '' THEN {quoted} ELSE {bare} END")


_GROUPS = f"""WITH k AS (
  SELECT 'files' AS src, id, {_PLAIN.format('path')} AS key FROM files
  UNION ALL SELECT 'compile_commands', id, {_PLAIN.format('file')} FROM compile_commands
  UNION ALL SELECT 'raw_commands', record_id, {_field('directory')} || '|' || {_field('command')} || '|' || {_field('file')} FROM raw_commands),
g AS (SELECT DISTINCT src, id, key, min(id) OVER (PARTITION BY src, key) AS keep_id FROM k)
"""

_ZERO = "CAST(0 AS BIGINT)"

SQL = {
    "p6_check": f"SELECT pack_id, {_ZERO} AS n_over, {_ZERO} AS n_cut, {_ZERO} AS n_broken, (SELECT count(*) FROM documents) AS n_items FROM pack_sizes",
    "p5_found": _GROUPS + "SELECT DISTINCT src, keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p5_collapsed": _GROUPS + "SELECT src, min(id) AS keep_id, count(DISTINCT id) AS n_copies FROM k GROUP BY src, key",
}
