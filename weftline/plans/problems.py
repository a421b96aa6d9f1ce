"""Queries of the general data problems 1 to 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.packed import split_packed, unrepeated
from weftline.operators.accumulate import dependents, frequent_keys
from weftline.operators.orphans import orphan_report, orphans, period_of
from weftline.shared import scratch_path
from weftline.sources.adapters import arguments_sql
from weftline.sources.tables import table
from weftline.streaming.incremental import RunLog


def _references(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "relations").select(F.lit("relations").alias("ref_table"), "file_id", F.col("dep_id").alias("ref_id"), "seen_at")
    cu = table(spark, d, "compilation_unit").select(F.lit("compilation_unit").alias("ref_table"), F.col("id").alias("file_id"), F.col("id").alias("ref_id"), "seen_at")
    return rel.unionByName(cu)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans(_references(spark, d), table(spark, d, "files"))
    return found.select("ref_table", "file_id", "ref_id", period_of("seen_at").alias("period")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphans(_references(spark, d), table(spark, d, "files"))).select("ref_table", "period", "status", "n_rows", "n_keys")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The job as it would have run: one batch as each run came in, judged by the state that the batches before it left."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    units, relations, runs = (table(spark, d, t) for t in ("compilation_unit", "relations", "scan_runs"))
    for run in sorted(r[0] for r in runs.select("run_id").where("run_id IS NOT NULL").distinct().collect()):
        log.process(units, relations, runs, upper=run)
    return log.changes().distinct()


def _commands(spark: SparkSession, d: str) -> DataFrame:
    cc = table(spark, d, "compile_commands").select(F.lit("compile_commands").alias("src"), F.col("id").alias("row_id"), F.lit(0).alias("run_id"), F.col("command").alias("packed"))
    cu = table(spark, d, "compilation_unit").select(F.lit("compilation_unit").alias("src"), F.col("id").alias("row_id"), "run_id", F.col("cmd_args").alias("packed"))
    return cc.unionByName(unrepeated(cu, ["row_id", "run_id"]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(_commands(spark, d), "packed", ["src", "row_id", "run_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_keys(table(spark, d, "relations"), "dep_id").select("dep_id")


def p4_dependents(spark: SparkSession, d: str) -> DataFrame:
    return dependents(table(spark, d, "relations"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_dependents": p4_dependents}

_REFS = """refs AS (
  SELECT 'relations' AS ref_table, file_id, dep_id AS ref_id, seen_at FROM relations
  UNION ALL SELECT 'compilation_unit', id, id, seen_at FROM compilation_unit),
judged AS (
  SELECT r.*, EXISTS (SELECT 1 FROM files f WHERE f.id = r.ref_id AND f.added_at <= r.seen_at AND (f.removed_at IS NULL OR r.seen_at < f.removed_at)) AS live,
    EXISTS (SELECT 1 FROM files f WHERE f.id = r.ref_id AND f.added_at <= r.seen_at AND (f.removed_at IS NULL OR f.added_at < f.removed_at)) AS before,
    EXISTS (SELECT 1 FROM files f WHERE f.id = r.ref_id AND (f.removed_at IS NULL OR f.added_at < f.removed_at)) AS ever
  FROM refs r)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, file_id, ref_id, strftime(seen_at, '%Y-%m') AS period FROM judged WHERE NOT live",
    "p1_report": f"""WITH {_REFS}
SELECT ref_table, strftime(seen_at, '%Y-%m') AS period, CASE WHEN before THEN 'deleted' WHEN ever THEN 'late' ELSE 'missing' END AS status,
  count(*) AS n_rows, count(DISTINCT ref_id) AS n_keys
FROM judged WHERE NOT live GROUP BY 1, 2, 3""",
    "p2_found": """WITH u AS (
  SELECT run_id, id, timestamp, cmd_args FROM compilation_unit QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY seen_at DESC) = 1),
r AS (SELECT run_id, file_id, dep_id, dependency_timestamp FROM relations QUALIFY row_number() OVER (PARTITION BY run_id, file_id, dep_id ORDER BY seen_at DESC) = 1),
s AS (SELECT u.run_id, u.id, timestamp, cmd_args, coalesce((SELECT string_agg(dep_id || ':' || dependency_timestamp, ',' ORDER BY dep_id) FROM r WHERE r.run_id = u.run_id AND r.file_id = u.id), '') AS deps FROM u),
b AS (SELECT s.*, (SELECT max(p.run_id) FROM s p JOIN scan_runs k ON k.run_id = p.run_id AND k.status = 'succeeded' WHERE p.id = s.id AND p.run_id < s.run_id) AS base FROM s)
SELECT b.run_id, b.id FROM b LEFT JOIN s o ON o.id = b.id AND o.run_id = b.base
WHERE b.run_id > (SELECT min(run_id) FROM scan_runs)
  AND (o.id IS NULL OR o.timestamp IS DISTINCT FROM b.timestamp OR o.cmd_args IS DISTINCT FROM b.cmd_args OR o.deps IS DISTINCT FROM b.deps)""",
    "p3_found": f"""SELECT src, row_id, run_id, CAST(i AS INT) AS pos, args[i] AS value FROM (
  SELECT *, unnest(range(1, len(args) + 1)) AS i FROM (
    SELECT 'compile_commands' AS src, id AS row_id, 0 AS run_id, {arguments_sql('command')} AS args FROM compile_commands
    UNION ALL SELECT 'compilation_unit', id, run_id, {arguments_sql('cmd_args')} FROM (SELECT DISTINCT id, run_id, cmd_args FROM compilation_unit)))""",
    "p4_found": "SELECT dep_id FROM relations GROUP BY dep_id HAVING count(*) * 50 >= (SELECT count(*) FROM relations)",
    "p4_dependents": """SELECT dep_id, count(*) AS n_rows, count(DISTINCT file_id) AS n_dependents, max(dependency_timestamp) AS newest_timestamp
FROM relations GROUP BY dep_id""",
}
