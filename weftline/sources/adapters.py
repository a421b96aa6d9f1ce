"""The store as the operators see it, derived from the raw tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.packed import split_packed
from weftline.sources.tables import table


def files(spark: SparkSession, d: str) -> DataFrame:
    """(id, path, number_of_lines): one row per id, that of its newest life."""
    newest = F.max(F.struct("added_at", "path", "number_of_lines")).alias("x")
    return table(spark, d, "files").where(F.col("id").isNotNull()).groupBy("id").agg(newest).select("id", "x.path", "x.number_of_lines")


def _runs(spark: SparkSession, d: str, which: str) -> DataFrame:
    """Succeeded runs: all, all but the last (``old``), or the last (``now``). Runs are few, whatever the tables' size."""
    ok = table(spark, d, "scan_runs").where(F.col("status") == "succeeded").select("run_id")
    last = F.lit(ok.agg(F.max("run_id")).first()[0])
    keep = {"all": F.lit(True), "old": F.col("run_id") < last, "now": F.col("run_id") == last}[which]
    return F.broadcast(ok.where(keep))


def units(spark: SparkSession, d: str, which: str = "all") -> DataFrame:
    """(id, ts, args): what the newest of the runs that wrote a unit wrote."""
    u = table(spark, d, "compilation_unit").join(_runs(spark, d, which), "run_id", "left_semi")
    newest = F.max(F.struct("run_id", "seen_at", "timestamp", "cmd_args")).alias("x")
    return u.groupBy("id").agg(newest).select("id", F.col("x.timestamp").alias("ts"), F.col("x.cmd_args").alias("args"))


def relations(spark: SparkSession, d: str, which: str = "all") -> DataFrame:
    """(file_id, dep_id, ts): the dependencies that the newest of the runs that reached a unit wrote."""
    r = table(spark, d, "relations").join(_runs(spark, d, which), "run_id", "left_semi")
    last = r.groupBy("file_id").agg(F.max("run_id").alias("run_id"))
    per_dep = r.groupBy("run_id", "file_id", "dep_id").agg(F.max_by("dependency_timestamp", "seen_at").alias("ts"))
    return per_dep.join(last, ["file_id", "run_id"], "left_semi").select("file_id", "dep_id", "ts")


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Replacements with ``unhandled`` as a boolean; it is true where missing."""
    return table(spark, d, "replacements").withColumn("unhandled", F.coalesce("unhandled", F.lit(1)) != 0)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(id, file_id, line, original_line): the line table that the edits leave, the last edit of a line wins."""
    last = F.max(F.struct("id", "comes_from_start_line")).alias("x")
    return edits(spark, d).groupBy("file_id", F.col("start_line").alias("line")).agg(last).select("x.id", "file_id", "line", F.col("x.comes_from_start_line").alias("original_line"))


def line_edits(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, replacement_id): the bridge between lines and edits."""
    e = edits(spark, d).select(F.col("id").alias("replacement_id"), "file_id", F.col("start_line").alias("line"))
    return lines(spark, d).select(F.col("id").alias("line_id"), "file_id", "line").join(e, ["file_id", "line"]).select("line_id", "replacement_id")


def spaced_edits(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, start_line, replaced, inserted, text): edits of order lines four lines apart, so that none overlap."""
    q = F.floor(F.min("l_quantity")).cast("int"), F.floor(F.max("l_quantity")).cast("int")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), "l_linenumber")
    e = g.agg((q[0] % 3).alias("replaced"), (q[1] % 5).alias("inserted"), F.concat(F.min("l_returnflag"), F.max("l_linestatus")).alias("text"))
    return e.select("file_id", (F.col("l_linenumber") * 4).alias("start_line"), "replaced", "inserted", "text")


def stored_edits(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, start_line, replaced, inserted, text): the replacements, which may overlap."""
    columns = {"lines_replaced": "replaced", "lines_in_replacement": "inserted", "replacement_text": "text"}
    return table(spark, d, "replacements").select("file_id", "start_line", *[F.col(c).alias(n) for c, n in columns.items()])


def partial_results(spark: SparkSession, d: str) -> DataFrame:
    """(worker, seq, transform, path, n, flag): what eight workers hand back."""
    return table(spark, d, "events").select(
        F.pmod("user_id", F.lit(8)).alias("worker"), F.col("event_id").alias("seq"), F.col("event_type").alias("transform"), F.col("user_id").alias("path"),
        F.floor("value").alias("n"), (F.col("event_type") == "error").alias("flag"),
    )


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(id, parent, kind, name): region, nation, customer, order and line as a labelled tree."""

    def level(t: str, kind: str, key: str, parent: str | None, up: str, name: str) -> DataFrame:
        p = F.concat(F.lit(up), F.col(parent)) if parent else F.lit(None).cast("string")
        return table(spark, d, t).select(F.concat(F.lit(kind[0]), F.col(key)).alias("id"), p.alias("parent"), F.lit(kind).alias("kind"), F.col(name).alias("name"))

    # The lines of an order stay together, up to 1024 of them, so what is summed up by order later is summed up before it is sent.
    block = F.floor(F.col("l_linenumber") / 1024)
    li = table(spark, d, "lineitem").withColumn("block", block).repartition("l_orderkey", "block").groupBy("l_orderkey", "block", "l_linenumber").agg(F.min("l_returnflag").alias("name"))
    leaves = li.select(
        F.concat(F.lit("l"), "l_orderkey", F.lit("."), "l_linenumber").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.lit("line").alias("kind"), "name"
    )
    return (
        level("region", "region", "r_regionkey", None, "", "r_name")
        .unionByName(level("nation", "nation", "n_nationkey", "n_regionkey", "r", "n_name"))
        .unionByName(level("customer", "customer", "c_custkey", "c_nationkey", "n", "c_mktsegment"))
        .unionByName(level("orders", "order", "o_orderkey", "o_custkey", "c", "o_orderpriority"))
        .unionByName(leaves)
    )


def arguments(spark: SparkSession, d: str) -> DataFrame:
    """(id, directory, file, args array<string>): compile commands with the command cut at separators outside quotes."""
    commands = table(spark, d, "compile_commands")
    by_place = F.array_sort(F.collect_list(F.struct("pos", "value")))
    cut = split_packed(commands, "command", ["id"]).groupBy("id").agg(F.transform(by_place, lambda x: x["value"]).alias("args"))
    none = F.when(F.col("command").isNotNull(), F.array().cast("array<string>"))
    return commands.join(cut, "id", "left").select("id", "directory", "file", F.coalesce("args", none).alias("args"))


#: The same views in SQL; a query's SQL begins with those it uses.
VIEWS = {
    "ok": "SELECT run_id FROM scan_runs WHERE status = 'succeeded'",
    "m": "SELECT max(run_id) AS last FROM ok",
    "file": "SELECT id, path, number_of_lines FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY added_at DESC, path DESC, number_of_lines DESC NULLS LAST) = 1",
    "cu_runs": "SELECT c.* FROM compilation_unit c JOIN ok USING (run_id)",
    "cu": "SELECT id, timestamp AS ts, cmd_args AS args FROM cu_runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC, seen_at DESC, timestamp DESC, cmd_args DESC) = 1",
    "cu_old": "SELECT id, timestamp AS ts, cmd_args AS args FROM cu_runs, m WHERE run_id < last QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC, seen_at DESC, timestamp DESC, cmd_args DESC) = 1",
    "cu_now": "SELECT id, timestamp AS ts, cmd_args AS args FROM cu_runs, m WHERE run_id = last QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, timestamp DESC, cmd_args DESC) = 1",
    "rel_runs": "SELECT r.run_id, file_id, dep_id, dependency_timestamp AS ts FROM relations r JOIN ok USING (run_id) QUALIFY row_number() OVER (PARTITION BY r.run_id, file_id, dep_id ORDER BY seen_at DESC) = 1",
    "rel": "SELECT file_id, dep_id, ts FROM rel_runs QUALIFY run_id = max(run_id) OVER (PARTITION BY file_id)",
    "rel_old": "SELECT file_id, dep_id, ts FROM rel_runs, m WHERE run_id < last QUALIFY run_id = max(run_id) OVER (PARTITION BY file_id)",
    "rel_now": "SELECT file_id, dep_id, ts FROM rel_runs, m WHERE run_id = last",
    "edit": "SELECT * REPLACE (coalesce(unhandled, 1) <> 0 AS unhandled) FROM replacements",
    "lines": "SELECT id, file_id, start_line AS line, comes_from_start_line AS original_line FROM replacements QUALIFY row_number() OVER (PARTITION BY file_id, start_line ORDER BY id DESC) = 1",
    "bridge": "SELECT l.id AS line_id, e.id AS replacement_id FROM lines l JOIN replacements e ON e.file_id = l.file_id AND e.start_line = l.line",
    "ledit": """SELECT l_orderkey AS file_id, 4 * l_linenumber AS start_line, CAST(floor(min(l_quantity)) AS INT) % 3 AS replaced, CAST(floor(max(l_quantity)) AS INT) % 5 AS inserted,
  min(l_returnflag) || max(l_linestatus) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "part_result": "SELECT user_id % 8 AS worker, event_id AS seq, event_type AS transform, user_id AS path, CAST(floor(value) AS BIGINT) AS n, event_type = 'error' AS flag FROM events",
    "node": """SELECT 'r' || r_regionkey AS id, NULL AS parent, 'region' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order', o_orderpriority FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 'line', min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_linenumber""",
}

#: An argument: characters that neither separate nor quote, escapes, and quoted stretches; then its pieces.
_ARGUMENT = r"""(?:[^ \t\n\x0B\f\r;|"'\\]|\\+["' ]|\\+|"(?:[^"\\]|\\+"|\\+)*(?:"|\z)|'[^']*(?:'|\z))+"""
_ARGUMENT_PIECE = r"""[^"'\\]+|\\+["' ]|\\+|"(?:[^"\\]|\\+"|\\+)*(?:"|\z)|'[^']*(?:'|\z)"""


def arguments_sql(text: str) -> str:
    """A SQL expression: the list of a packed field's arguments, with regard to quotes and escapes."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    # Within a double quote an escaped mark stands for itself, within a single quote all does; outside, the last backslash before a mark or blank goes.
    double = "replace(regexp_replace(x[2:], '(^|[^\\\\])\"\\z', '\\1'), '\\\"', '\"')"
    escaped = "regexp_replace(x, '\\\\([\"'' ])', '\\1')"
    piece = f"CASE x[1] WHEN '\"' THEN {double} WHEN chr(39) THEN rtrim(x[2:], chr(39)) WHEN chr(92) THEN {escaped} ELSE x END"
    return f"list_transform(regexp_extract_all({text}, {q(_ARGUMENT)}), lambda a: array_to_string(list_transform(regexp_extract_all(a, {q(_ARGUMENT_PIECE)}), lambda x: {piece}), ''))"


VIEWS["cmd"] = f"SELECT id, directory, file, {arguments_sql('command')} AS args FROM compile_commands"
