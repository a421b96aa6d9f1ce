"""Queries over the store: lookups, joins, change detection, merges, writes and line provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import diff, lookup, merge, provenance
from weftline.plans.registry import Book
from weftline.sources import adapters as a
from weftline.sources import compile_db, store
from weftline.sources.tables import table

book = Book()
S = SparkSession


# Lookups. Probes are ids that relations name, some of which no file has.

_DEPS = "probe AS (SELECT DISTINCT dep_id AS id FROM relations)"


def _deps(s: S, d: str) -> DataFrame:
    return table(s, d, "relations").select(F.col("dep_id").alias("id"))


@book("SELECT c.file AS path, coalesce(max(f.id), -1) AS id FROM (SELECT DISTINCT file FROM compile_commands) c LEFT JOIN file f ON f.path = c.file GROUP BY 1")
def file_id_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(table(s, d, "compile_commands").select(F.col("file").alias("path")), a.files(s, d), ["path"], "id", -1)


@book("SELECT p.id, coalesce(f.path, '') AS path FROM probe p LEFT JOIN file f USING (id)", _DEPS)
def file_path_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(_deps(s, d), a.files(s, d), ["id"], "path", "")


@book("SELECT p.id, coalesce(c.args, '') AS args FROM probe p LEFT JOIN cu c USING (id)", _DEPS)
def cmd_line_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(_deps(s, d), a.units(s, d), ["id"], "args", "")


@book("SELECT p.id, coalesce(c.ts, -1) AS ts FROM probe p LEFT JOIN cu c USING (id)", _DEPS)
def cu_timestamp_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(_deps(s, d), a.units(s, d), ["id"], "ts", -1)


@book("SELECT id, id IN (SELECT id FROM cu) AS found FROM probe", _DEPS)
def cu_exists(s: S, d: str) -> DataFrame:
    return lookup.exists(_deps(s, d), a.units(s, d), ["id"])


@book("SELECT id, id IN (SELECT id FROM file) AS found FROM probe", _DEPS)
def file_exists(s: S, d: str) -> DataFrame:
    return lookup.exists(_deps(s, d), a.files(s, d), ["id"])


@book("SELECT p.id, coalesce(f.number_of_lines, -1) AS number_of_lines FROM probe p LEFT JOIN file f USING (id)", _DEPS)
def file_line_count(s: S, d: str) -> DataFrame:
    return lookup.lookup(_deps(s, d), a.files(s, d), ["id"], "number_of_lines", -1)


_ENDS = "probe AS (SELECT DISTINCT file_id, comes_from_end_line AS line FROM replacements)"


def _ends(s: S, d: str) -> DataFrame:
    return table(s, d, "replacements").select("file_id", F.col("comes_from_end_line").alias("line"))


@book("SELECT p.file_id, p.line, l.id IS NOT NULL AS found FROM probe p LEFT JOIN lines l USING (file_id, line)", _ENDS)
def line_exists(s: S, d: str) -> DataFrame:
    return lookup.exists(_ends(s, d), a.lines(s, d), ["file_id", "line"])


@book("SELECT p.file_id, p.line, coalesce(l.id, -1) AS id FROM probe p LEFT JOIN lines l USING (file_id, line)", _ENDS)
def line_id_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(_ends(s, d), a.lines(s, d), ["file_id", "line"], "id", -1)


@book("SELECT p.file_id, p.line, coalesce(l.original_line, p.line) AS original_line FROM probe p LEFT JOIN lines l USING (file_id, line)", _ENDS)
def original_line(s: S, d: str) -> DataFrame:
    return provenance.original_line(_ends(s, d), a.lines(s, d))


@book("SELECT r.id, coalesce(l.line, -1) AS line FROM replacements r LEFT JOIN lines l USING (id)")
def actual_line_by_id(s: S, d: str) -> DataFrame:
    return lookup.lookup(table(s, d, "replacements"), a.lines(s, d), ["id"], "line", -1)


@book("SELECT p.id, coalesce(t.name, '') AS name FROM (SELECT DISTINCT transformation_id + 3 AS id FROM replacements) p LEFT JOIN transformations t USING (id)")
def transform_name_lookup(s: S, d: str) -> DataFrame:
    return lookup.lookup(table(s, d, "replacements").select((F.col("transformation_id") + 3).alias("id")), table(s, d, "transformations"), ["id"], "name", "")


@book("""SELECT id, name FROM transformations UNION ALL SELECT row_number() OVER (ORDER BY event_type) + (SELECT max(id) FROM transformations), event_type
FROM (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN (SELECT name FROM transformations))""")
def transform_ids(s: S, d: str) -> DataFrame:
    return lookup.transform_ids(table(s, d, "events").select(F.col("event_type").alias("name")), table(s, d, "transformations"))


# Edits.


@book("""SELECT e.id, coalesce(t.path, '') AS target, coalesce(o.path, '') AS origin, coalesce(n.name, '') AS name, start_line, lines_replaced, lines_in_replacement,
comes_from_start_line, comes_from_end_line, unhandled, replacement_text
FROM edit e LEFT JOIN file t ON t.id = e.file_id LEFT JOIN file o ON o.id = e.comes_from_file_id LEFT JOIN transformations n ON n.id = e.transformation_id""")
def edit_detail(s: S, d: str) -> DataFrame:
    return lookup.edit_detail(a.edits(s, d), a.files(s, d), table(s, d, "transformations"))


@book("SELECT file_id, start_line, lines_replaced, lines_in_replacement, replacement_text, max(id) AS id FROM edit GROUP BY ALL")
def edit_find(s: S, d: str) -> DataFrame:
    return lookup.edit_find(a.edits(s, d))


_MIDS = "probe AS (SELECT id AS file_id, number_of_lines // 2 AS line, id % 12 + 1 AS transformation_id FROM file WHERE number_of_lines IS NOT NULL)"


def _mids(s: S, d: str) -> DataFrame:
    half = F.floor(F.col("number_of_lines") / 2).cast("int")
    return a.files(s, d).where(F.col("number_of_lines").isNotNull()).select(F.col("id").alias("file_id"), half.alias("line"), (F.col("id") % 12 + 1).alias("transformation_id"))


@book("SELECT p.file_id, p.line, e.id FROM probe p JOIN edit e ON e.file_id = p.file_id AND e.start_line <= p.line", _MIDS)
def edits_upto_line(s: S, d: str) -> DataFrame:
    return lookup.edits_upto_line(_mids(s, d).drop("transformation_id"), a.edits(s, d))


@book("SELECT p.file_id, p.transformation_id, p.line, e.id FROM probe p JOIN edit e ON e.file_id = p.file_id AND e.transformation_id = p.transformation_id AND e.start_line <= p.line", _MIDS)
def edits_upto_line_by_transform(s: S, d: str) -> DataFrame:
    return lookup.edits_upto_line(_mids(s, d), a.edits(s, d), by_transform=True)


@book("SELECT id, file_id FROM edit WHERE unhandled")
def edits_unhandled(s: S, d: str) -> DataFrame:
    return lookup.edits_unhandled(a.edits(s, d))


@book("SELECT l.file_id, l.line, e.id AS replacement_id, e.transformation_id, e.replacement_text FROM lines l JOIN bridge b ON b.line_id = l.id JOIN edit e ON e.id = b.replacement_id")
def edits_of_line(s: S, d: str) -> DataFrame:
    return lookup.edits_of_line(a.lines(s, d), a.line_edits(s, d), a.edits(s, d))


@book("SELECT DISTINCT l.file_id, l.line, e.transformation_id FROM lines l JOIN bridge b ON b.line_id = l.id JOIN edit e ON e.id = b.replacement_id")
def transforms_of_line(s: S, d: str) -> DataFrame:
    return lookup.transforms_of_line(a.lines(s, d), a.line_edits(s, d), a.edits(s, d))


@book("SELECT DISTINCT file_id, start_line, lines_replaced, replacement_text FROM edit")
def dedup_edits(s: S, d: str) -> DataFrame:
    return merge.dedup_edits(a.edits(s, d))


@book("SELECT file_id, min(lines_in_replacement) AS lines_in_replacement FROM edit GROUP BY 1")
def min_by_key(s: S, d: str) -> DataFrame:
    return merge.min_by_key(a.edits(s, d), "file_id", "lines_in_replacement")


# Units and relations.


@book("SELECT r.file_id, f.path, r.ts FROM rel r JOIN file f ON f.id = r.dep_id")
def dependency_list(s: S, d: str) -> DataFrame:
    return lookup.dependency_list(a.relations(s, d), a.files(s, d))


@book("SELECT c.id, f.path, c.ts, c.args FROM cu c JOIN file f USING (id)")
def compilation_units(s: S, d: str) -> DataFrame:
    return lookup.compilation_units(a.units(s, d), a.files(s, d))


@book("SELECT c.id, coalesce(r.dep_id >> 20, 0) AS part, CAST(count(r.dep_id) AS INT) AS n_deps, coalesce(string_agg(r.dep_id, ',' ORDER BY r.dep_id), '') AS deps FROM cu c LEFT JOIN rel r ON r.file_id = c.id GROUP BY 1, 2")
def load_dependencies(s: S, d: str) -> DataFrame:
    return lookup.load_dependencies(a.units(s, d), a.relations(s, d))


@book("SELECT c.id, coalesce(x.path, '') AS dep_path FROM cu c LEFT JOIN (SELECT file_id, path FROM rel JOIN file ON file.id = dep_id) x ON x.file_id = c.id")
def deps_keep_empty(s: S, d: str) -> DataFrame:
    return lookup.deps_keep_empty(a.units(s, d), a.relations(s, d), a.files(s, d))


@book("SELECT DISTINCT path FROM file WHERE id IN (SELECT id FROM cu UNION ALL SELECT dep_id FROM rel)")
def all_files_distinct(s: S, d: str) -> DataFrame:
    return diff.all_files_distinct(a.units(s, d), a.relations(s, d), a.files(s, d))


def _snapshots(s: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return a.units(s, d, "now"), a.units(s, d, "old"), a.relations(s, d, "now"), a.relations(s, d, "old")


@book("SELECT id FROM cu_now WHERE id NOT IN (SELECT id FROM cu_old)")
def new_units(s: S, d: str) -> DataFrame:
    return diff.new_units(*_snapshots(s, d)[:2])


@book("""SELECT id FROM cu_now WHERE id IN (SELECT id FROM cu_old) AND EXISTS (SELECT 1 FROM rel_old o WHERE o.file_id = cu_now.id
AND NOT EXISTS (SELECT 1 FROM rel_now n WHERE n.file_id = o.file_id AND n.dep_id = o.dep_id AND n.ts = o.ts))""")
def dep_ts_mismatch(s: S, d: str) -> DataFrame:
    return diff.dep_ts_mismatch(*_snapshots(s, d))


_SETS = """x AS (SELECT n.id, o.id IS NOT NULL AS known, n.args AS n_args, o.args AS o_args, n.ts AS n_ts, o.ts AS o_ts,
  coalesce(p.k, 0) AS nk, coalesce(q.k, 0) AS ok, coalesce(p.ids, '') AS nids, coalesce(q.ids, '') AS oids, coalesce(p.pairs, '') AS npairs, coalesce(q.pairs, '') AS opairs
  FROM cu_now n LEFT JOIN cu_old o USING (id)
  LEFT JOIN (SELECT file_id, count(*) AS k, string_agg(dep_id, ',' ORDER BY dep_id) AS ids, string_agg(dep_id || ':' || ts, ',' ORDER BY dep_id) AS pairs FROM rel_now GROUP BY 1) p ON p.file_id = n.id
  LEFT JOIN (SELECT file_id, count(*) AS k, string_agg(dep_id, ',' ORDER BY dep_id) AS ids, string_agg(dep_id || ':' || ts, ',' ORDER BY dep_id) AS pairs FROM rel_old GROUP BY 1) q ON q.file_id = n.id),
reasons AS (SELECT id, CASE WHEN NOT known THEN 'new' WHEN n_args IS DISTINCT FROM o_args THEN 'args' WHEN n_ts IS DISTINCT FROM o_ts THEN 'timestamp' WHEN nk <> ok THEN 'dep_count'
  WHEN nids <> oids THEN 'dep_set' WHEN npairs <> opairs THEN 'dep_timestamp' END AS reason FROM x)"""


@book("SELECT id FROM x WHERE known AND nids <> oids", _SETS)
def dep_set_changed(s: S, d: str) -> DataFrame:
    return diff.dep_set_changed(*_snapshots(s, d))


@book("SELECT id, reason FROM reasons WHERE reason IS NOT NULL", _SETS)
def change_reason(s: S, d: str) -> DataFrame:
    return diff.change_reason(*_snapshots(s, d))


@book(
    """SELECT n.id FROM cu_now n WHERE NOT EXISTS (SELECT 1 FROM cu_old o WHERE o.id = n.id AND o.ts = n.ts AND o.args = n.args
  AND NOT EXISTS (SELECT 1 FROM rel_old r JOIN cur c USING (dep_id) WHERE r.file_id = n.id AND c.ts_now <> r.ts))""",
    "cur AS (SELECT dep_id, max(ts) AS ts_now FROM rel_now GROUP BY 1)",
)
def skip_unchanged(s: S, d: str) -> DataFrame:
    now, old, rel_now, rel_old = _snapshots(s, d)
    return diff.skip_unchanged(now, old, rel_old, rel_now.groupBy("dep_id").agg(F.max("ts").alias("ts_now")))


_REBUILT = "rebuilt AS (SELECT n.id FROM cu_now n LEFT JOIN cu_old o USING (id) WHERE o.id IS NULL OR o.ts IS DISTINCT FROM n.ts)"


@book(
    """SELECT file_id, dep_id, ts FROM rel_now WHERE file_id IN (SELECT id FROM rebuilt)
UNION ALL SELECT o.file_id, o.dep_id, coalesce(n.ts, o.ts) FROM rel_old o LEFT JOIN rel_now n USING (file_id, dep_id) WHERE o.file_id NOT IN (SELECT id FROM rebuilt)""",
    _REBUILT,
)
def apply_snapshot(s: S, d: str) -> DataFrame:
    return diff.apply_snapshot(*_snapshots(s, d))


@book("SELECT id, ts, args FROM cu_now UNION ALL SELECT id, ts, args FROM cu_old WHERE id NOT IN (SELECT id FROM cu_now)")
def apply_units(s: S, d: str) -> DataFrame:
    return diff.apply_units(*_snapshots(s, d)[:2])


@book(
    """SELECT f.path FROM (SELECT id FROM reasons WHERE reason IS NOT NULL UNION ALL
SELECT dep_id FROM rel_now WHERE file_id IN (SELECT id FROM reasons WHERE reason IS NOT NULL)) u JOIN file f USING (id)""",
    _SETS,
)
def flatten_sources(s: S, d: str) -> DataFrame:
    return diff.flatten_sources(change_reason(s, d), a.relations(s, d, "now"), a.files(s, d))


# Merging partial results.


@book("SELECT transform, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS total, bool_or(flag) AS any_flag FROM part_result GROUP BY 1")
def merge_counters(s: S, d: str) -> DataFrame:
    return merge.merge_counters(a.partial_results(s, d))


@book("SELECT worker, seq, transform FROM part_result WHERE flag UNION ALL SELECT worker, seq, transform FROM part_result WHERE n > 50")
def merge_edit_bags(s: S, d: str) -> DataFrame:
    p = a.partial_results(s, d)
    return merge.merge_bags(p.where("flag").select("worker", "seq", "transform"), p.where("n > 50").select("worker", "seq", "transform"))


@book("SELECT DISTINCT transform, path FROM part_result")
def merge_work_queue(s: S, d: str) -> DataFrame:
    return merge.merge_sets(a.partial_results(s, d), ["transform", "path"])


@book("SELECT path, seq, n FROM part_result QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) = 1")
def first_wins_merge(s: S, d: str) -> DataFrame:
    return merge.first_wins(a.partial_results(s, d), ["path"], "seq", ["seq", "n"])


@book("SELECT file_id, dep_id, dependency_timestamp FROM relations QUALIFY row_number() OVER (PARTITION BY file_id, dep_id ORDER BY seen_at, dependency_timestamp) = 1")
def merge_dependencies(s: S, d: str) -> DataFrame:
    return merge.first_wins(table(s, d, "relations"), ["file_id", "dep_id"], "seen_at", ["dependency_timestamp"])


@book("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // least(40, greatest(1, (SELECT count(*) FROM orders) // 997)) AS chunk FROM orders""")
def chunk_groups(s: S, d: str) -> DataFrame:
    """Chunks of up to 40 for 997 workers: at most sizes of the table fewer, so that each worker has one."""
    return merge.chunk_groups(table(s, d, "orders"), "o_orderkey", 40, 997)


# Writes.


@book("""SELECT file_id, start_line, replacement_text FROM (SELECT *, row_number() OVER (PARTITION BY file_id, start_line ORDER BY comes_from_file_id = file_id AND id % 2 = 1 DESC, id DESC) AS k FROM replacements) WHERE k = 1""")
def upsert_lines(s: S, d: str) -> DataFrame:
    e = table(s, d, "replacements").withColumn("new", (F.col("comes_from_file_id") == F.col("file_id")) & (F.col("id") % 2 == 1))
    keys = ["file_id", "start_line"]
    old = merge.last_wins(e.where(~F.col("new")), keys, "id", ["replacement_text"])
    return store.upsert(old, e.where("new"), keys, "id")


@book("SELECT file_id, dep_id, ts FROM rel_old UNION ALL SELECT file_id, dep_id, ts FROM rel_now n WHERE NOT EXISTS (SELECT 1 FROM rel_old o WHERE o.file_id = n.file_id AND o.dep_id = n.dep_id)")
def insert_ignore(s: S, d: str) -> DataFrame:
    return store.insert_ignore(a.relations(s, d, "old"), a.relations(s, d, "now"), ["file_id", "dep_id"], "ts")


@book(
    """SELECT path, id, false AS refused FROM stored UNION ALL
SELECT path, id, path IN (SELECT path FROM stored) OR row_number() OVER (PARTITION BY path ORDER BY id) > 1 FROM file WHERE id % 2 = 1""",
    "stored AS (SELECT path, min(id) AS id FROM file WHERE id % 2 = 0 GROUP BY 1)",
)
def insert_files(s: S, d: str) -> DataFrame:
    """Files with odd ids put into a store of those with even ones, and what is refused, as its path is stored or comes twice."""
    f = a.files(s, d).select("path", "id")
    stored = f.where("id % 2 = 0").groupBy("path").agg(F.min("id").alias("id"))
    after, refused = store.insert_checked(stored, f.where("id % 2 = 1"), ["path"])
    return after.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@book(
    """SELECT file_id, dep_id, ts FROM rel_old UNION ALL SELECT file_id, dep_id, min(ts) AS ts FROM named n
WHERE NOT EXISTS (SELECT 1 FROM rel_old o WHERE o.file_id = n.file_id AND o.dep_id = n.dep_id) GROUP BY 1, 2""",
    """ids AS (SELECT path, max(id) AS id FROM file GROUP BY 1),
named AS (SELECT coalesce(x.id, -1) AS file_id, coalesce(y.id, -1) AS dep_id, n.ts FROM rel_now n LEFT JOIN file f ON f.id = n.file_id LEFT JOIN file g ON g.id = n.dep_id
  LEFT JOIN ids x ON x.path = f.path LEFT JOIN ids y ON y.path = g.path)""",
)
def add_relations(s: S, d: str) -> DataFrame:
    """The last run's relations added by path; those of units or dependencies without a file get -1."""
    f = a.files(s, d)
    named = a.relations(s, d, "now").join(f.select(F.col("id").alias("file_id"), "path"), "file_id", "left").join(f.select(F.col("id").alias("dep_id"), F.col("path").alias("dep_path")), "dep_id", "left")
    return store.add_relations(a.relations(s, d, "old"), named.select("path", "dep_path", "ts"), f)


@book("SELECT id, file_id, line, original_line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line ORDER BY moved DESC, id DESC) AS k FROM m2) WHERE k = 1",
      "m2 AS (SELECT id, file_id, CASE WHEN id % 3 = 0 THEN line + 1 ELSE line END AS line, original_line, id % 3 = 0 AS moved FROM lines)")
def renumber_lines(s: S, d: str) -> DataFrame:
    lines = a.lines(s, d)
    return store.renumber_lines(lines, lines.where("id % 3 = 0").select("id", (F.col("line") + 1).alias("line")))


@book("SELECT r.file_id, r.dep_id, coalesce(n.ts, r.ts) AS ts FROM rel_old r LEFT JOIN rel_now n USING (file_id, dep_id)")
def update_by_key(s: S, d: str) -> DataFrame:
    return store.update_by_key(a.relations(s, d, "old"), a.relations(s, d, "now"), ["file_id", "dep_id"], "ts")


@book("SELECT id, unhandled AND file_id NOT IN (SELECT id FROM cu) AS unhandled FROM edit")
def mark_handled(s: S, d: str) -> DataFrame:
    e = a.edits(s, d)
    done = e.join(a.units(s, d).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    return store.mark_handled(e.select("id", "unhandled"), done)


@book("SELECT file_id, dep_id, ts FROM rel WHERE file_id NOT IN (SELECT id FROM cu_now)")
def delete_by_key(s: S, d: str) -> DataFrame:
    return store.delete_by_key(a.relations(s, d), a.units(s, d, "now").select(F.col("id").alias("file_id")), ["file_id"])


@book("SELECT file_id, dep_id, ts FROM rel_old o WHERE NOT EXISTS (SELECT 1 FROM rel_now n WHERE n.file_id = o.file_id AND n.dep_id = o.dep_id)")
def remove_dependency(s: S, d: str) -> DataFrame:
    return store.delete_by_key(a.relations(s, d, "old"), a.relations(s, d, "now"), ["file_id", "dep_id"])


@book("""SELECT file_id, start_line, lines_replaced, lines_in_replacement, replacement_text, (SELECT max(id) FROM replacements) + row_number() OVER (
ORDER BY file_id NULLS FIRST, start_line NULLS FIRST, lines_replaced NULLS FIRST, lines_in_replacement NULLS FIRST, replacement_text NULLS FIRST) AS id FROM replacements""")
def edit_add(s: S, d: str) -> DataFrame:
    """Every stored edit added once more: each gets an id of its own above the stored ones, in order of the key."""
    e = table(s, d, "replacements")
    return store.edit_add(e, e.drop("id"), lookup.EDIT_KEY).select(*lookup.EDIT_KEY, "id")


# Line provenance.

_LENGTHS = "len AS (SELECT DISTINCT file_id, 40 AS n FROM ledit)"


def _lengths(s: S, d: str) -> DataFrame:
    return a.spaced_edits(s, d).select("file_id").distinct().withColumn("n", F.lit(40))


@book("SELECT file_id, start_line, replaced, inserted, inserted - replaced AS delta, start_line + replaced AS end_line FROM ledit")
def edit_metrics(s: S, d: str) -> DataFrame:
    return provenance.edit_metrics(a.spaced_edits(s, d))


_SHIFT = """sh AS (SELECT *, CAST(sum(inserted - replaced) OVER w AS BIGINT) AS after FROM ledit
  WINDOW w AS (PARTITION BY file_id ORDER BY start_line, start_line + replaced, text DESC ROWS UNBOUNDED PRECEDING)),
shift AS (SELECT *, after - (inserted - replaced) AS before FROM sh)"""


@book("SELECT file_id, start_line, before, after FROM shift", _SHIFT)
def line_shift(s: S, d: str) -> DataFrame:
    return provenance.line_shift(a.spaced_edits(s, d)).select("file_id", "start_line", "before", "after")


# The same over the stored edits, of which a few files hold many.

_STORED = "sedit AS (SELECT file_id, start_line, lines_replaced AS replaced, lines_in_replacement AS inserted, replacement_text AS text FROM replacements)"
_STORED_SHIFT = _STORED + ", " + _SHIFT.replace("ledit", "sedit").replace("text DESC", "text DESC, inserted")


@book("SELECT file_id, start_line, replaced, inserted, inserted - replaced AS delta, start_line + replaced AS end_line FROM sedit", _STORED)
def edit_metrics_stored(s: S, d: str) -> DataFrame:
    return provenance.edit_metrics(a.stored_edits(s, d))


@book("SELECT file_id, start_line, before, after FROM shift", _STORED_SHIFT)
def line_shift_stored(s: S, d: str) -> DataFrame:
    return provenance.line_shift(a.stored_edits(s, d)).select("file_id", "start_line", "before", "after")


@book("SELECT o_orderkey AS file_id, i AS line, i AS original_line FROM orders, range(1, 11) t(i) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = i)")
def register_lines(s: S, d: str) -> DataFrame:
    files = table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(10).alias("n"))
    known = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line")).distinct()
    return provenance.register_lines(files, known)


_PROV = f"""{_LENGTHS}, {_SHIFT},
total AS (SELECT file_id, sum(inserted - replaced) AS t FROM ledit GROUP BY 1),
grid AS (SELECT l.file_id, i AS line, n, t FROM len l JOIN total USING (file_id), range(1, 80) g(i) WHERE i <= greatest(n, n + t)),
prov AS (SELECT g.file_id, g.line, coalesce(
    (SELECT max_by(s.start_line, s.start_line) FROM shift s WHERE s.file_id = g.file_id AND g.line >= s.start_line + s.before AND g.line < s.start_line + s.before + s.inserted),
    CASE WHEN g.line > g.n + g.t THEN g.line END,
    g.line - coalesce((SELECT max_by(s.after, s.start_line) FROM shift s WHERE s.file_id = g.file_id AND s.start_line + s.replaced + s.after <= g.line), 0)) AS original_line FROM grid g)"""


@book("SELECT file_id, line, CAST(original_line AS BIGINT) AS original_line FROM prov", _PROV)
def line_provenance(s: S, d: str) -> DataFrame:
    return provenance.line_provenance(a.spaced_edits(s, d), _lengths(s, d))


_TRACE = "probe AS (SELECT DISTINCT l_partkey AS file_id, l_linenumber AS line, l_returnflag = 'R' AS path_is_correct FROM lineitem)"


@book(
    """SELECT p.file_id, p.line, p.path_is_correct, CASE WHEN p.file_id IN (SELECT id FROM file) THEN coalesce(l.original_line, p.line) WHEN p.path_is_correct THEN p.line ELSE -1 END AS original_line
FROM probe p LEFT JOIN lines l USING (file_id, line)""",
    _TRACE,
)
def trace_back(s: S, d: str) -> DataFrame:
    p = table(s, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("path_is_correct"))
    return provenance.trace_back(p, a.files(s, d), a.lines(s, d))


@book("SELECT file_id, line, original_line FROM lines WHERE file_id NOT IN (SELECT id FROM cu_now)")
def reset_lines(s: S, d: str) -> DataFrame:
    gone = a.units(s, d, "now").select(F.col("id").alias("file_id"))
    return provenance.reset_lines(a.lines(s, d), gone).select("file_id", "line", "original_line")


# Compilation databases and source selection.

_INCLUDE, _EXCLUDE = ["/srv/", "/opt/", "C:/work/"], ["/opt/toolset/", "/srv/build/velora"]
_IN = "(" + " OR ".join(f"starts_with(path, '{p}')" for p in _INCLUDE) + ")"
_OUT = "(" + " OR ".join(f"starts_with(path, '{p}')" for p in _EXCLUDE) + ")"


@book("SELECT f.path AS file, coalesce(c.id >> 20, 0) AS part, CAST(count(c.id) AS INT) AS n_commands, coalesce(string_agg(c.id, ',' ORDER BY c.id), '') AS ids FROM (SELECT DISTINCT path FROM file) f LEFT JOIN compile_commands c ON c.file = f.path GROUP BY 1, 2")
def commands_by_file(s: S, d: str) -> DataFrame:
    """The commands of every file of the store, many of which have none."""
    return compile_db.commands_of(a.files(s, d).select(F.col("path").alias("file")), table(s, d, "compile_commands"))


@book("SELECT DISTINCT path, id FROM (SELECT id, unnest(args) AS path FROM cmd) WHERE path IN (SELECT path FROM file)")
def commands_for_file(s: S, d: str) -> DataFrame:
    return compile_db.commands_for_file(a.files(s, d), a.arguments(s, d))


@book("SELECT id, directory, command, file FROM compile_commands WHERE file IN (SELECT path FROM file JOIN cu USING (id))")
def partial_database(s: S, d: str) -> DataFrame:
    group = lookup.compilation_units(a.units(s, d), a.files(s, d))
    return compile_db.partial_database(table(s, d, "compile_commands"), group).select("id", "directory", "command", "file")


@book("SELECT DISTINCT directory, command, file FROM compile_commands")
def distinct_commands(s: S, d: str) -> DataFrame:
    return compile_db.distinct_commands(table(s, d, "compile_commands"))


@book(f"SELECT path, {_IN} AND NOT {_OUT} AS included, {_OUT} AS excluded FROM files")
def include_exclude(s: S, d: str) -> DataFrame:
    return compile_db.include_exclude(table(s, d, "files"), _INCLUDE, _EXCLUDE)


@book(f"SELECT DISTINCT file AS path FROM (SELECT file, file AS path FROM compile_commands) WHERE NOT {_OUT}")
def select_sources(s: S, d: str) -> DataFrame:
    """Given sources win over the database."""
    given = table(s, d, "compile_commands").select(F.col("file").alias("path"))
    return compile_db.select_sources(given, table(s, d, "files"), _INCLUDE, _EXCLUDE)


@book(f"SELECT DISTINCT path FROM files WHERE {_IN} AND NOT {_OUT}")
def select_included(s: S, d: str) -> DataFrame:
    """No source is given, so the database's included files are taken."""
    return compile_db.select_sources(None, table(s, d, "files"), _INCLUDE, _EXCLUDE)


@book("SELECT id, path FROM files WHERE regexp_matches(path, '\\.(cpp|c|cxx|cc)$')")
def source_ext_filter(s: S, d: str) -> DataFrame:
    return compile_db.source_files(table(s, d, "files")).select("id", "path")


_MOD = f"""mods AS (SELECT r.file_id, r.dep_id, CASE WHEN r.dep_id = r.file_id THEN true WHEN f.path IS NULL THEN false ELSE ({_IN} AND NOT {_OUT}) END AS modifiable
FROM rel r LEFT JOIN file f ON f.id = r.dep_id)"""


@book("SELECT * FROM mods", _MOD)
def is_modifiable(s: S, d: str) -> DataFrame:
    return compile_db.is_modifiable(a.relations(s, d), a.files(s, d), _INCLUDE, _EXCLUDE)


@book(f"""SELECT e.id, e.start_line >= 1 AND e.lines_replaced >= 0 AND e.comes_from_file_id = e.file_id
  AND CASE WHEN c.id IS NOT NULL THEN true WHEN f.path IS NULL THEN false ELSE {_IN} AND NOT {_OUT} END AS valid
FROM edit e LEFT JOIN file f ON f.id = e.file_id LEFT JOIN cu c ON c.id = e.file_id""")
def edit_guard(s: S, d: str) -> DataFrame:
    return compile_db.edit_guard(a.edits(s, d), a.files(s, d), a.units(s, d), _INCLUDE, _EXCLUDE)


QUERIES, SQL = book.queries, book.sql
