"""Line provenance: composing edits into a map from new lines to the lines they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import first_match_line, newline_count

#: Lines that one bucket of a file spans. Edits that don't overlap and take lines can't be more than these; only pure insertions at one line can.
WIDTH = 1 << 12


def edit_metrics(edits: DataFrame) -> DataFrame:
    """(file_id, start_line, replaced, inserted, delta, end_line) of each edit."""
    return edits.select("file_id", "start_line", "replaced", "inserted", (F.col("inserted") - F.col("replaced")).alias("delta"), (F.col("start_line") + F.col("replaced")).alias("end_line"))


def _shifted(edits: DataFrame, width: int) -> DataFrame:
    """edits with ``after``, and ``next_start``: where the file's next edit starts.

    A file is cut into buckets of lines. Each bucket's sum and first start are found with partial sums and carried along the file's
    buckets, so the edits of one very large file are ordered by many tasks.
    """
    delta = F.col("inserted") - F.col("replaced")
    d = edits.where(F.col("file_id").isNotNull() & F.col("start_line").isNotNull()).withColumn("bucket", F.floor(F.col("start_line") / width))
    along = W.partitionBy("file_id").orderBy("bucket")
    per = d.groupBy("file_id", "bucket").agg(F.sum(delta).alias("part"), F.min("start_line").alias("first"))
    carried = F.coalesce(F.sum("part").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = per.select("file_id", "bucket", carried.alias("carried"), F.lead("first").over(along).alias("later"))
    own = W.partitionBy("file_id", "bucket").orderBy("start_line", F.col("start_line") + F.col("replaced"), F.desc("text"), "inserted")
    after = F.col("carried") + F.sum(delta).over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.join(carry, ["file_id", "bucket"]).select(*edits.columns, after.alias("after"), F.coalesce(F.lead("start_line").over(own), F.col("later")).alias("next_start"))


def line_shift(edits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each edit with ``before`` and ``after``: how far the lines in front of and behind it have moved.

    Edits of a file are taken by start, end, text descending and then inserted lines; the shift is a running sum within the file. Edits without
    file or start line are left out.
    """
    return _shifted(edits, width).drop("next_start").withColumn("before", F.col("after") - (F.col("inserted") - F.col("replaced")))


def register_lines(files: DataFrame, known: DataFrame) -> DataFrame:
    """Identity rows (file_id, line, original_line) for lines 1..n of each (file_id, n) that ``known`` lacks."""
    ask = files.where(F.col("n") > 0).select("file_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    return ask.join(known.select("file_id", "line"), ["file_id", "line"], "left_anti").withColumn("original_line", F.col("line"))


def line_provenance(edits: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """(file_id, line, original_line) after one pass of non-overlapping edits over identity lines 1..n of each (file_id, n).

    Lines that an edit inserts come from its start line; the others come from as many lines before or behind as the edits in front of
    them added or took. Where a file shrank, rows past its new end keep their identity. Each edit owns the new lines
    from its own place up to the next edit's, so one range of lines per edit is generated inside the file and no
    range join is needed: the work is proportional to edits and lines.
    """
    delta = F.col("inserted") - F.col("replaced")
    per_file = edits.groupBy("file_id").agg(F.min("start_line").alias("first"), F.sum(delta).alias("total")).join(lengths, "file_id")
    e = _shifted(edits, width).join(per_file.select("file_id", "n", "total"), "file_id").withColumn("at", F.col("start_line") + F.col("after") - delta)
    end = F.col("n") + F.col("total")
    until = F.coalesce(F.col("next_start") + F.col("after"), F.greatest(end, F.col("at") + F.col("inserted") - 1) + 1)
    own = e.where(until > F.col("at")).select("file_id", "start_line", "inserted", "after", "at", F.explode(F.sequence(F.col("at"), until - 1)).alias("line"))
    placed = own.select("file_id", "line", F.when(F.col("line") < F.col("at") + F.col("inserted"), F.col("start_line")).otherwise(F.col("line") - F.col("after")).alias("original_line"))
    first = per_file.where(F.col("first") > 1).select("file_id", F.explode(F.sequence(F.lit(1), F.col("first") - 1)).alias("line"))
    tail = per_file.where((F.col("total") < 0) & (F.col("n") > 0)).select("file_id", F.explode(F.sequence(F.greatest(end + 1, F.lit(1)), F.col("n"))).alias("line"))
    plain = lengths.where(F.col("n") > 0).join(edits.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    same = first.unionByName(tail).unionByName(plain).withColumn("original_line", F.col("line"))
    return placed.unionByName(same.select(placed.columns))


def compose(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Two passes in one: newer lines traced through the older map; lines that it lacks trace to themselves."""
    o = older.select("file_id", F.col("line").alias("original_line"), F.col("original_line").alias("first_line"))
    return newer.join(o, ["file_id", "original_line"], "left").select("file_id", "line", F.coalesce("first_line", "original_line").alias("original_line"))


def header_inserted(texts: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """The line table (file_id, line, original_line) after a line was put before the first match of each text (file_id, text).

    Lines from there on move by one, and the new line has the origin of the one that it pushed on. ``lines`` holds what was known of the texts before; lines that it lacks are their own
    origin. Texts without a match keep their rows.
    """
    at = texts.select("file_id", first_match_line(F.col("text"), pattern).alias("start_line"), (newline_count(F.col("text")) + 1).alias("n")).where("start_line > 0")
    edits = at.select("file_id", "start_line", F.lit(0).alias("replaced"), F.lit(1).alias("inserted"), F.lit("").alias("text"))
    moved = compose(line_provenance(edits, at.select("file_id", "n")), lines)
    return moved.unionByName(lines.join(at.select("file_id"), "file_id", "left_anti").select(moved.columns))


def original_line(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line, original_line): the stored origin of each distinct probed line, or the line itself."""
    return probes.select("file_id", "line").distinct().join(lines.select("file_id", "line", "original_line"), ["file_id", "line"], "left").select("file_id", "line", F.coalesce("original_line", "line").alias("original_line"))


def trace_back(probes: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line, path_is_correct, original_line): -1 for an unknown file, or the line itself where the path is known to be right."""
    known = files.select(F.col("id").alias("file_id"), F.lit(True).alias("known")).distinct()
    p = probes.select("file_id", "line", "path_is_correct").distinct().join(known, "file_id", "left").join(lines.select("file_id", "line", "original_line"), ["file_id", "line"], "left")
    out = F.when(F.col("known"), F.coalesce("original_line", "line")).when(F.col("path_is_correct"), F.col("line")).otherwise(-1)
    return p.select("file_id", "line", "path_is_correct", out.alias("original_line"))


def reset_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The line table without the lines of some files (file_id)."""
    return lines.join(files.select("file_id").distinct(), "file_id", "left_anti")
