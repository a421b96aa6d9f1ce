"""The run: which units changed, what they need, their edits to a fixpoint, new texts and line origins, and the store that results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import apply_edits, line_edits, newline_count
from weftline.operators import diff, lookup, provenance
from weftline.operators.ordered import numbered
from weftline.shared import written
from weftline.sources import compile_db
from weftline.sources.store import SCHEMAS, Store, edit_add
from weftline.streaming.fixpoint import Registry, check_summary, failed_paths, run_to_fixpoint

EDITS = "path string, start int, end int, text string"


@dataclass
class RunConfig:
    """What a run is told.

    sources: paths to transform, else the included ones of the scan. include, exclude: prefixes of files that may be edited. transforms: names, else all. targets: lowest
    compiler versions that the result must suit. no_database: process everything and keep nothing; reset_database: process everything and store it anew.
    source_root, dest: edited texts go to files under dest; serialize_dir: edits are written there and not applied. perf: folder for seconds by stage.
    check: (path, text) -> (path, passed), a row for each command.
    """

    sources: list[str] | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    transforms: list[str] | None = None
    targets: dict[str, str] | None = None
    no_database: bool = False
    reset_database: bool = False
    source_root: str | None = None
    dest: str | None = None
    serialize_dir: str | None = None
    perf: str | None = None
    check: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class RunResult:
    """reasons (path, reason) of changed units; edits (path, start, end, text, transform, pass); texts (path, text) and lines (path, line, original_line) of edited files;
    log (transform, pass, paths); failed (path, n_failed) and summary if there was a check."""

    reasons: DataFrame
    edits: DataFrame
    texts: DataFrame
    lines: DataFrame
    log: list[tuple[str, int, int]]
    seconds: dict[str, float]
    failed: DataFrame | None = None
    summary: DataFrame | None = None


class Texts:
    """The texts of a run (path, text), their line origins, and all edits; each pass replaces them by new tables."""

    def __init__(self, texts: DataFrame):
        self.texts = written(texts.select("path", "text"), "texts")
        spark = texts.sparkSession
        self.lines = spark.createDataFrame([], "path string, line int, original_line int")
        self.edits = spark.createDataFrame([], f"{EDITS}, transform string, pass int, start_line int, replaced int, inserted int")
        self.passes = 0

    def apply(self, transform: str, edits: DataFrame) -> None:
        """Splices a pass's distinct edits into the texts and follows the lines. Overlapping edits and edits of an absent text are errors."""
        self.passes += 1
        spec = F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits")
        per = edits.select("path", "start", "end", "text").distinct().groupBy("path").agg(spec)
        absent = F.raise_error(F.concat(F.lit("an edit of a text that isn't there: "), "path")).cast("string")
        known = self.texts.withColumn("there", F.lit(True))
        hit = per.join(known, "path", "left").withColumn("text", F.when(F.col("there"), F.col("text")).otherwise(absent))
        new = apply_edits(F.col("text"), F.col("edits"))
        both = F.arrays_zip(F.col("edits"), line_edits(F.col("text"), F.col("edits")).alias("at"))
        done = written(hit.select("path", F.length("text").alias("size"), (newline_count(F.col("text")) + 1).alias("n"), new.alias("text"), both.alias("both")), "edited")
        each = done.select("path", F.explode("both").alias("b")).select(F.col("path"), "b.edits.*", F.col("b.at.start_line").alias("start_line"), "b.at.replaced", "b.at.inserted")
        by_line = each.select(F.col("path").alias("file_id"), "start_line", "replaced", "inserted", "text")
        moved = provenance.line_provenance(by_line, done.select(F.col("path").alias("file_id"), "n"))
        older = self.lines.withColumnRenamed("path", "file_id")
        composed = provenance.compose(moved, older).withColumnRenamed("file_id", "path")
        kept = self.lines.join(done.select("path"), "path", "left_anti")
        lines = written(kept.unionByName(composed.select("path", F.col("line").cast("int").alias("line"), F.col("original_line").cast("int").alias("original_line"))), "lines")
        texts = written(self.texts.join(done.select("path"), "path", "left_anti").unionByName(done.select("path", "text")), "texts")
        mine = each.withColumn("transform", F.lit(transform)).withColumn("pass", F.lit(self.passes))
        self.edits = self.edits.unionByName(written(mine.select(self.edits.columns), "applied"))
        self.texts, self.lines = texts, lines


def with_store_ids(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, id): each path with the id it has in the store, or the next free ones in order of path."""
    paths = files.where(F.col("path").isNotNull()).select("path").distinct()
    known = stored.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("id").alias("id"))
    top = stored.agg(F.max("id")).first()[0] or 0
    new = numbered(paths.join(known, "path", "left_anti"), [F.col("path")], "id", top + 1)
    return written(known.join(paths, "path", "left_semi").select("path", "id").unionByName(new.select("path", "id")), "ids")


def _scan(files: DataFrame, units: DataFrame, relations: DataFrame, ids: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (id, ts, args) of the sources and their relations (file_id, dep_id, ts) under store ids. Ids without a path, and relations to them, are left out."""
    to = files.where(F.col("path").isNotNull()).select(F.col("id").alias("scan_id"), "path").join(ids, "path").select("scan_id", "path", "id")
    to = written(to, "renamed")
    chosen = to.join(sources, "path", "left_semi")
    u = units.withColumnRenamed("id", "scan_id").join(chosen.select("scan_id", "id"), "scan_id").select("id", "ts", "args")
    r = relations.join(chosen.select(F.col("scan_id").alias("file_id"), F.col("id").alias("unit")), "file_id")
    r = r.join(to.select(F.col("scan_id").alias("dep_id"), F.col("id").alias("dep")), "dep_id").select(F.col("unit").alias("file_id"), F.col("dep").alias("dep_id"), "ts")
    newest = r.groupBy("file_id", "dep_id").agg(F.max("ts").alias("ts"))
    one = u.groupBy("id").agg(F.max(F.struct("ts", "args")).alias("x")).select("id", "x.ts", "x.args")
    return written(one, "units"), written(newest, "relations")


def run(spark: SparkSession, config: RunConfig, files: DataFrame, units: DataFrame, relations: DataFrame, texts: DataFrame, registry: Registry, store: Store | None = None) -> RunResult:
    """One incremental run over what a scan saw: files (id, path), units (id, ts, args), relations (file_id, dep_id, ts) and texts (path, text).

    Ids need only agree within the scan; the store knows files by path. Changed units and those of their dependencies that may be edited are queued; transforms run in order of
    priority to a fixpoint; edits are applied after each pass, so the next pass matches the new texts. At the end files, units, relations,
    transforms, edits and lines are stored in one transaction, or none of them. Nothing changed means nothing is queued and no edit is stored.
    """
    began, seconds = time.time(), {}

    def mark(stage: str) -> None:
        nonlocal began
        seconds[stage] = time.time() - began
        began = time.time()

    keeps = store is not None and not config.no_database
    if config.reset_database and keeps:
        store.truncate()
    elif keeps:
        store.create()
    stored = {n: store.read(n) if keeps else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    given = None if config.sources is None else spark.createDataFrame([(p,) for p in config.sources], "path string")
    unit_paths = files.join(units.select("id").distinct(), "id", "left_semi").select("path")
    sources = written(compile_db.select_sources(given, unit_paths, config.include, config.exclude), "sources")
    ids = with_store_ids(files, stored["files"])
    now, rel_now = _scan(files, units, relations, ids, sources)
    old = stored["compilation_unit"].select("id", F.col("timestamp").alias("ts"), F.col("cmd_args").alias("args"))
    rel_old = stored["relations"].select("file_id", "dep_id", F.col("dependency_timestamp").alias("ts"))
    mark("scan")
    if keeps and not config.reset_database:
        reasons = diff.change_reason(now, old, rel_now, rel_old)
    else:
        reasons = now.select("id", F.lit("no database" if not keeps else "reset").alias("reason"))
    reasons = written(reasons, "reasons")
    deps = compile_db.is_modifiable(rel_now.join(reasons.select(F.col("id").alias("file_id")), "file_id", "left_semi"), ids, config.include, config.exclude)
    touched = reasons.select("id").unionByName(deps.where("modifiable").select(F.col("dep_id").alias("id"))).distinct()
    touched = written(touched.join(ids, "id").select("id", "path"), "touched")
    mark("diff")

    state = Texts(texts.join(touched, "path", "left_semi"))
    chosen = registry.selected(config.transforms, config.targets)
    finder = chosen[0].name if chosen and chosen[0].finder else None
    queue = touched.select(F.explode(F.array(*[F.lit(n) for n in ([finder] if finder else [t.name for t in chosen])])).alias("transform"), "path") if chosen else touched.select(F.lit("").alias("transform"), "path").limit(0)
    log = run_to_fixpoint(registry, queue, config.transforms, config.targets, state.apply, state)[1]
    mark("transforms")

    if config.serialize_dir:
        compile_db.write_edits(state.edits.select("path", "start", "end", "text", "transform", "pass"), config.serialize_dir)
    edited = state.texts.join(state.edits.select("path").distinct(), "path", "left_semi")
    if config.dest and not config.serialize_dir:
        root = config.source_root or ""
        compile_db.write_texts(compile_db.staged(edited, root, config.dest).withColumn("path", F.substr("path", F.lit(len(config.dest) + 1))), config.dest)
    mark("texts")
    result = RunResult(reasons.join(ids, "id").select("path", "reason"), state.edits, edited, state.lines, log, seconds)
    if config.check:
        checked = written(config.check(state.texts), "checked")
        result.failed, result.summary = failed_paths(checked), check_summary(checked)
        mark("check")
    if keeps:
        _save(store, stored, state, ids, touched, (now, old, rel_now, rel_old))
        mark("store")
    if config.perf:
        compile_db.write_timings(spark, seconds, config.perf)
    return result


def _save(store: Store, stored: dict[str, DataFrame], state: Texts, ids: DataFrame, touched: DataFrame, snapshots: tuple[DataFrame, ...]) -> None:
    now, old, rel_now, rel_old = snapshots
    sizes = state.texts.join(ids, "path").select("id", (newline_count(F.col("text")) + 1).cast("int").alias("new_lines"))
    seen = ids.join(stored["files"].select("id"), "id", "left_anti").select("id", F.lit(None).cast("int").alias("number_of_lines"), "path")
    files = stored["files"].unionByName(seen).join(sizes, "id", "left").select("id", F.coalesce("new_lines", "number_of_lines").alias("number_of_lines"), "path")
    names = lookup.transform_ids(state.edits.select("transform").distinct().select(F.col("transform").alias("name")), stored["transformations"])
    names = written(names, "names")
    e = state.edits.join(ids.withColumnRenamed("id", "file_id"), "path").join(F.broadcast(names.withColumnRenamed("id", "transformation_id")), F.col("transform") == F.col("name"))
    last = F.col("start_line") + F.greatest(F.col("replaced") - 1, F.lit(0))
    row = e.select(
        "file_id", "start_line", F.col("replaced").alias("lines_replaced"), F.col("inserted").alias("lines_in_replacement"), F.col("start_line").alias("comes_from_start_line"),
        last.cast("int").alias("comes_from_end_line"), F.col("file_id").alias("comes_from_file_id"), "transformation_id", F.lit(0).alias("unhandled"), F.col("text").alias("replacement_text"),
    )
    added = edit_add(stored["replacements"], row, lookup.EDIT_KEY).select(stored["replacements"].columns)
    kept = provenance.reset_lines(stored["lines"], touched.select(F.col("id").alias("file_id")))
    top = stored["lines"].agg(F.max("id")).first()[0] or 0
    lines = numbered(state.lines.join(ids.withColumnRenamed("id", "file_id"), "path").select("file_id", "line", "original_line"), [F.col("file_id"), F.col("line")], "id", top + 1)
    with store:
        store.write("files", files)
        store.write("compilation_unit", diff.apply_units(now, old).select("id", F.col("ts").alias("timestamp"), F.col("args").alias("cmd_args")))
        store.write("relations", diff.apply_snapshot(now, old, rel_now, rel_old).select("file_id", "dep_id", F.col("ts").alias("dependency_timestamp")))
        store.write("transformations", names)
        store.write("replacements", stored["replacements"].unionByName(added))
        store.write("lines", kept.unionByName(lines.select(kept.columns)))


_INCLUDE = r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'


def scan_includes(texts: DataFrame, roots: list[str]) -> DataFrame:
    """(path, dep_path) of every include directive that a text (path, text) has of another of the texts: beside the including file, else under the first root that has it.

    A text without any has one row with a null. Names are joined by equality with what paths end in, so neither side is held whole.
    """
    from weftline.functions.paths import last_dir, normalize

    asked = texts.select("path", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(_INCLUDE), F.lit(1)))).alias("name"))
    places = F.array(F.struct(F.lit(0).alias("rank"), last_dir(F.col("path")).alias("root")), *[F.struct(F.lit(k + 1).alias("rank"), F.lit(r).alias("root")) for k, r in enumerate(roots)])
    tries = asked.where("name IS NOT NULL").select("path", "name", F.explode(places).alias("p")).select("path", "name", "p.rank", normalize(F.concat("p.root", "name")).alias("dep_path"))
    there = tries.join(texts.select(F.col("path").alias("dep_path")).distinct(), "dep_path").groupBy("path", "name").agg(F.min_by("dep_path", "rank").alias("dep_path"))
    found = there.select("path", "dep_path").distinct()
    return texts.select("path").distinct().join(found, "path", "left").select("path", "dep_path")


def include_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(path, dep_path): every text that a start text (path) includes, directly or through others; cycles are walked once.

    A round joins only pairs that the last one found. Their number is that of the result, which relations hold anyway.
    """
    e = edges.where("dep_path IS NOT NULL").select("path", "dep_path").distinct()
    seen = front = written(e.join(start.select("path"), "path", "left_semi"), "closure", {"n": F.count(F.lit(1))})
    while front.observed["n"]:
        further = front.select("path", F.col("dep_path").alias("via")).join(e.select(F.col("path").alias("via"), "dep_path"), "via").select("path", "dep_path").distinct()
        front = written(further.join(seen, ["path", "dep_path"], "left_anti"), "closure", {"n": F.count(F.lit(1))})
        seen = seen.unionByName(front)
    return seen
