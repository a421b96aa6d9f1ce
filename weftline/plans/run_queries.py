"""The whole run over the store tables: a first run over the older snapshot, and a second over the newer one with the store that the first left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import Book
from weftline.plans.store_queries import _EXCLUDE, _IN, _INCLUDE, _OUT
from weftline.run import RunConfig, run
from weftline.shared import scratch_path, written
from weftline.sources import adapters as a
from weftline.sources.store import Store
from weftline.streaming.fixpoint import Registry, Transform

book = Book()
S = SparkSession


def _files(s: S, d: str) -> DataFrame:
    """(id, path): the least id of each path."""
    return written(a.files(s, d).where("path IS NOT NULL").groupBy("path").agg(F.min("id").alias("id")).select("id", "path"), "files")


def _texts(files: DataFrame) -> DataFrame:
    """(path, text): two declarations, one with a type to deduce in every third file and both in every ninth."""
    first = F.when(F.col("id") % 3 == 0, "auto").otherwise("int")
    second = F.when(F.col("id") % 9 == 0, "auto").otherwise("int")
    return files.select("path", F.concat(first, F.lit(" a;\n"), second, F.lit(" b;\n")).alias("text"))


def deducing() -> Registry:
    """A finder of texts with ``auto`` and a transform that replaces the first one of a text and asks for the text again while there are more."""

    def joined(queue: DataFrame, state: object) -> DataFrame:
        return state.texts.join(queue, "path", "left_semi").withColumn("at", F.locate("auto", F.col("text")) - 1)

    def find(queue: DataFrame, state: object) -> tuple[DataFrame, DataFrame]:
        hit = joined(queue, state).where("at >= 0").select(F.lit("deduce").alias("transform"), "path")
        return queue.select("path", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text")).where(F.lit(False)), hit

    def deduce(queue: DataFrame, state: object) -> tuple[DataFrame, DataFrame]:
        hit = joined(queue, state).where("at >= 0")
        again = hit.where(F.col("text").rlike("(?s)auto.*auto")).select(F.lit("deduce").alias("transform"), "path")
        return hit.select("path", F.col("at").alias("start"), (F.col("at") + 4).alias("end"), F.lit("int").alias("text")), again

    r = Registry()
    r.add(Transform("find-features", 99, find, finder=True))
    r.add(Transform("deduce", 4, deduce, {"clang": "3.6"}))
    return r


_RUNS = f"""one AS (SELECT min(id) AS id, path FROM file WHERE path IS NOT NULL GROUP BY path),
u_old AS (SELECT c.id, ts, args FROM cu_old c JOIN one USING (id) WHERE {_IN} AND NOT {_OUT}),
u_now AS (SELECT c.id, ts, args FROM cu_now c JOIN one USING (id) WHERE {_IN} AND NOT {_OUT}),
r_old AS (SELECT r.file_id, r.dep_id, r.ts FROM rel_old r JOIN u_old u ON u.id = r.file_id JOIN one o ON o.id = r.dep_id),
r_now AS (SELECT r.file_id, r.dep_id, r.ts FROM rel_now r JOIN u_now u ON u.id = r.file_id JOIN one o ON o.id = r.dep_id),
sets AS (SELECT n.id, o.id IS NULL AS fresh, n.args IS DISTINCT FROM o.args AS args, n.ts IS DISTINCT FROM o.ts AS ts,
  coalesce((SELECT string_agg(dep_id, ',' ORDER BY dep_id) FROM r_now WHERE file_id = n.id), '') AS nids, coalesce((SELECT string_agg(dep_id, ',' ORDER BY dep_id) FROM r_old WHERE file_id = n.id), '') AS oids,
  coalesce((SELECT string_agg(dep_id || ':' || ts, ',' ORDER BY dep_id) FROM r_now WHERE file_id = n.id), '') AS npairs, coalesce((SELECT string_agg(dep_id || ':' || ts, ',' ORDER BY dep_id) FROM r_old WHERE file_id = n.id), '') AS opairs
  FROM u_now n LEFT JOIN u_old o USING (id)),
why AS (SELECT id, CASE WHEN fresh THEN 'new' WHEN args THEN 'args' WHEN ts THEN 'timestamp' WHEN len(string_split(nids, ',')) <> len(string_split(oids, ',')) OR (nids = '') <> (oids = '') THEN 'dep_count'
  WHEN nids <> oids THEN 'dep_set' WHEN npairs <> opairs THEN 'dep_timestamp' END AS reason FROM sets),
touched AS (SELECT 1 AS run, id FROM u_old UNION SELECT 1, dep_id FROM r_old JOIN one ON one.id = dep_id WHERE dep_id = file_id OR ({_IN} AND NOT {_OUT})
  UNION SELECT 2, id FROM why WHERE reason IS NOT NULL
  UNION SELECT 2, dep_id FROM r_now JOIN one ON one.id = dep_id WHERE file_id IN (SELECT id FROM why WHERE reason IS NOT NULL) AND (dep_id = file_id OR ({_IN} AND NOT {_OUT}))),
edited AS (SELECT run, id, CASE WHEN id % 9 = 0 THEN 2 ELSE 1 END AS n FROM touched WHERE id % 3 = 0),
again AS (SELECT n.id FROM u_now n LEFT JOIN u_old o USING (id) WHERE o.id IS NULL OR o.ts IS DISTINCT FROM n.ts)"""


@book(
    """SELECT 1 AS run, 'files' AS name, (SELECT count(*) FROM one) AS n UNION ALL SELECT 2, 'files', (SELECT count(*) FROM one)
UNION ALL SELECT 1, 'units', (SELECT count(*) FROM u_old) UNION ALL SELECT 2, 'units', (SELECT count(*) FROM (SELECT id FROM u_old UNION SELECT id FROM u_now))
UNION ALL SELECT 1, 'relations', (SELECT count(*) FROM r_old)
UNION ALL SELECT 2, 'relations', (SELECT count(*) FROM r_now WHERE file_id IN (SELECT id FROM again)) + (SELECT count(*) FROM r_old WHERE file_id NOT IN (SELECT id FROM again))
UNION ALL SELECT k, 'edits', CAST((SELECT sum(n) FROM edited WHERE run <= k) AS BIGINT) FROM range(1, 3) t(k)
UNION ALL SELECT k, 'lines', 3 * (SELECT count(DISTINCT id) FROM edited WHERE run <= k) FROM range(1, 3) t(k)
UNION ALL SELECT 1, 'reason new', (SELECT count(*) FROM u_old) UNION ALL SELECT 2, 'reason ' || reason, count(*) FROM why WHERE reason IS NOT NULL GROUP BY reason""",
    _RUNS,
)
def run_twice(s: S, d: str) -> DataFrame:
    """Rows of the store's tables and reasons after each of two runs, of which the second only does what changed."""
    files = _files(s, d)
    store = Store(s, scratch_path(s, "store"))
    out = []
    for n, which in ((1, "old"), (2, "now")):
        config = RunConfig(include=_INCLUDE, exclude=_EXCLUDE, targets={"clang": "3.5"})
        r = run(s, config, files, a.units(s, d, which), a.relations(s, d, which), _texts(files), deducing(), store)
        tables = {"files": "files", "compilation_unit": "units", "relations": "relations", "replacements": "edits", "lines": "lines"}
        out += [store.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("run"), F.lit(name).alias("name"), "n") for t, name in tables.items()]
        out.append(r.reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("run"), F.concat(F.lit("reason "), "reason").alias("name"), "n"))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


QUERIES, SQL = book.queries, book.sql
