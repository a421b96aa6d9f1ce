"""Scalar functions on text and text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import running


def trim_ws(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def literal_replace(text: Column, old: str, new: str) -> Column:
    """Every occurrence from left to right, the result not scanned again."""
    return F.replace(text, F.lit(old), F.lit(new))


def regex_replace_until_stable(text: Column, pattern: str, new: str, rounds: int = 8) -> Column:
    """Replaces matches again and again until none is left.

    A pass replaces all matches. ``rounds`` passes are made on every row, and more only on rows that still match: up to twice as many as
    the text has characters, and 1,000 at least. A row that matches even then, or has grown sixteenfold, fails, so a rule that feeds itself ends too.
    """
    for _ in range(rounds):
        text = F.regexp_replace(text, pattern, new)
    most = F.greatest(2 * F.length(text), F.lit(1000))
    zero = F.struct(text.alias("text"), F.lit(True).alias("more"))

    def step(s: Column, n: Column) -> Column:
        after = F.regexp_replace(s["text"], pattern, new)
        over = (n == most) | (F.length(after) > 16 * most)
        more = after.rlike(pattern)
        failed = F.raise_error(F.lit("replacement doesn't come to an end")).cast("boolean")
        return F.when(s["more"], F.struct(after.alias("text"), F.when(more & over, failed).otherwise(more).alias("more"))).otherwise(s)

    rest = F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["text"])
    return F.when(text.rlike(pattern), rest).otherwise(text)


def split_tokens(text: Column, sep: str) -> Column:
    """Tokens between separators, without an empty one at the end."""
    parts = F.split(text, rf"\Q{sep}\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def newline_count(text: Column) -> Column:
    """Number of line feeds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def locate_sep(text: Column, sep: str) -> Column:
    """Characters before the first separator; -1 if there is none."""
    return F.locate(sep, text) - 1


def locate_closing(text: Column, opening: str = "(", closing: str = ")") -> Column:
    """Characters up to and with the mark that closes the first opening one; -1 if it stays open or there is none."""
    marks = F.regexp_extract_all(text, F.lit(rf"[^\{opening}\{closing}]++|[\{opening}\{closing}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(-1).alias("end"))

    def step(s: Column, x: Column) -> Column:
        now = s["open"] + F.when(x == opening, 1).when((x == closing) & (s["open"] > 0), -1).otherwise(0)
        at = s["at"] + F.length(x)
        return F.struct(at.alias("at"), now.alias("open"), F.when((s["end"] < 0) & (s["open"] == 1) & (now == 0), at).otherwise(s["end"]).alias("end"))

    return F.aggregate(marks, zero, step, lambda s: s["end"])


def format_duration(milliseconds: Column) -> Column:
    """Whole seconds, or milliseconds below one second; plural above 1."""
    seconds = F.floor(milliseconds / 1000)
    n, unit = F.when(seconds == 0, milliseconds).otherwise(seconds), F.when(seconds == 0, " millisecond").otherwise(" second")
    return F.concat(n.cast("string"), unit, F.when(n > 1, "s").otherwise(""))


def position_less(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether position a, (line, column), comes before b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def cmd_line_concat(args: Column) -> Column:
    """Each argument with a blank in front."""
    return F.array_join(F.transform(args, lambda a: F.concat(F.lit(" "), a)), "")


def rewrite_args(args: Column, root: str, dest: str, known: Column) -> Column:
    """Arguments with the root folder replaced: ``-I`` paths under it, and known paths under it. Both folders end in a slash."""

    def one(a: Column) -> Column:
        include = a.startswith(f"-I{root}")
        path = ~a.startswith("-") & a.startswith(root) & F.array_contains(known, a)
        return F.when(include, F.concat(F.lit(f"-I{dest}"), F.substr(a, F.lit(len(root) + 3)))).when(path, F.concat(F.lit(dest), F.substr(a, F.lit(len(root) + 1)))).otherwise(a)

    return F.transform(args, one)


def insert_before_first_match(text: Column, pattern: str, new: str) -> Column:
    """The lines of a text, with one line put in before the first that matches; unchanged if none does."""
    parts = F.split(text, "\n")
    at = F.array_position(F.transform(parts, lambda x: x.rlike(pattern)), True)
    return F.when(at > 0, F.array_insert(parts, F.greatest(at, F.lit(1)).cast("int"), F.lit(new))).otherwise(parts)


def without_words(text: Column, *words: str) -> Column:
    """The text without these words where they stand alone, each with the blanks around it made one; by default ``constexpr`` and ``noexcept``."""
    for w in words or ("constexpr", "noexcept"):
        text = F.regexp_replace(text, rf"[ \t]*\b{w}\b[ \t]*", " ")
    return F.regexp_replace(text, r"^ +| +\z", "")


def line_edits(text: Column, edits: Column) -> Column:
    """An array of edits (start, end, text) by offset as edits (start_line, replaced, inserted, text) by line, counted from 1."""

    def one(e: Column) -> Column:
        before = F.substr(text, F.lit(1), e["start"])
        gone = F.substr(text, e["start"] + 1, e["end"] - e["start"])
        return F.struct((newline_count(before) + 1).alias("start_line"), newline_count(gone).alias("replaced"), newline_count(e["text"]).alias("inserted"), e["text"].alias("text"))

    return F.transform(edits, one)


def first_match_line(text: Column, pattern: str) -> Column:
    """The number, from 1, of the first line that matches; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(F.split(text, "\n"), lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")


def edit_order(edits: DataFrame) -> DataFrame:
    """Each edit with its place within its file: by start, end, and text descending."""
    order = [F.col("start_line"), F.col("start_line") + F.col("lines_replaced"), F.desc("replacement_text"), F.col("id")]
    return running(edits, "file_id", order, {"place": ("sum", F.lit(1))}).select("id", "file_id", F.col("place").cast("int").alias("place"))


def edit_bounds(edits: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, valid) of edits (id, file_id, start, end) and lengths (file_id, length): start at 0 or above, end no less than start and no more than the length of the text; invalid for an unknown text."""
    e = edits.join(lengths, "file_id", "left")
    ok = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("length"))
    return e.select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


def edit_overlap(edits: DataFrame) -> DataFrame:
    """Ids of edits (id, file_id, start, end, text) that begin before an earlier one of their file ends."""
    order = [F.col(c) for c in ("start", "end", "text", "id")]
    return running(edits, "file_id", order, {"reach": ("max", F.col("end"))}, inclusive=False).where(F.col("start") < F.col("reach")).select("id")


def interval_places(edits: DataFrame) -> DataFrame:
    """Each edit (id, file_id, start, end, text) with its place within its file: by start, end, text ascending."""
    order = [F.col(c) for c in ("start", "end", "text", "id")]
    return running(edits, "file_id", order, {"place": ("sum", F.lit(1))}).select("id", "file_id", F.col("place").cast("int").alias("place"))


def interval_order(edits: Column) -> Column:
    """An array of edits (start, end, text) in order."""
    return F.sort_array(edits)


#: Characters of the blocks that a text is cut into, so that a stretch is found without going through all before it.
_BLOCK = 1024


def _stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, counted from 0, of a text in blocks."""
    first = F.floor(start / _BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
    return F.substr(some, start - first * _BLOCK + 1, end - start)


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with an array of edits (start, end, text) spliced in; offsets count from 0. Fails if edits overlap or leave the text.

    Each edit gives the stretch before it and its own text, and these are joined once. A stretch is cut from the few blocks it lies in, so the work is in proportion
    to text and edits and doesn't grow with their product.
    """
    e = interval_order(edits)
    size = F.length(text)
    # One more edit that does nothing at the end brings the rest.
    more = F.array_append(e, F.struct(size.alias("start"), size.alias("end"), F.lit("").alias("text")))
    starts = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["end"]))
    # Values that lambdas look into are bound once by the outer lambda; written into them they would be made anew for every edit.
    whole = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)).alias("blocks"), size.alias("size"), F.arrays_zip(more.alias("e"), starts.alias("at")).alias("pairs"))

    def spliced(o: Column) -> Column:
        bad = F.exists(o["pairs"], lambda x: (x["e"]["start"] < x["at"]) | (x["e"]["end"] < x["e"]["start"]) | (x["e"]["end"] > o["size"]))
        out = F.array_join(F.transform(o["pairs"], lambda x: F.concat(_stretch(o["blocks"], x["at"], x["e"]["start"]), x["e"]["text"])), "")
        return F.when(bad, F.raise_error(F.lit("overlapping or invalid edits")).cast("string")).otherwise(out)

    done = F.get(F.transform(F.array(whole), spliced), 0)
    return F.when(text.isNull() | edits.isNull(), F.lit(None).cast("string")).when(F.size(edits) == 0, text).otherwise(done)


def edit_size_delta(edits: DataFrame) -> DataFrame:
    """(file_id, delta): by how many characters the edits (start, end, text) of a file change its length."""
    return edits.groupBy("file_id").agg(F.sum(F.length("text") - (F.col("end") - F.col("start"))).alias("delta"))
