"""Several values packed in one field: splitting by delimiter skeletons."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import written
from weftline.skew import BROADCAST_KEYS

#: A stretch of ordinary characters; a backslash that escapes nothing is one of them.
_PLAIN = r"""(?:[^\s;|"'\\]|\\(?!["' ]))++"""
#: Such a stretch, a run of separators, an escape, or a quote mark.
_PIECE = _PLAIN + r"""|[\s;|]++|\\["' ]|["']"""
#: Rules of at most so many skeletons, the most frequent ones of at most so many pieces, are broadcast: some 20 MB whatever the data.
FREQUENT, FREQUENT_PIECES = 4096, 256
# What an extracted piece gives: all of it, its second character, or its first.
_WHOLE, _SECOND, _FIRST = range(3)


def skeleton(text: Column) -> Column:
    """One letter per piece of a field: p ordinary characters, s separators, D and S quote marks, d, q and b escapes of a double quote, a quote and a blank."""
    shape = F.regexp_replace(text, _PLAIN, "p")
    for escape, letter in (('\\"', "d"), ("\\'", "q"), ("\\ ", "b")):
        shape = F.replace(shape, F.lit(escape), F.lit(letter))
    return F.translate(F.regexp_replace(shape, r"[\s;|]++", "s"), "\"'", "DS")


def rule(shape: str) -> list[list[int]]:
    """Where the arguments of a field with this skeleton stand: for each argument its pieces, as 4 * place + what the piece gives.

    A quote that never ends holds the rest of the field. Within single quotes a backslash before the mark is literal and the mark ends the quote.
    """
    out: list[list[int]] = []
    now: list[int] | None = None
    quote = ""
    for i, x in enumerate(shape):
        if not quote and x == "s":
            if now is not None:
                out.append(now)
            now = None
            continue
        now = [] if now is None else now
        if not quote:
            if x in "DS":
                quote = x
            else:
                now.append(4 * i + (_WHOLE if x == "p" else _SECOND))
        elif x == quote:
            quote = ""
        elif quote == "S" and x == "q":
            now.append(4 * i + _FIRST)
            quote = ""
        else:
            now.append(4 * i + (_SECOND if quote == "D" and x == "d" else _WHOLE))
    return out if now is None else [*out, now]


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"shape": b["shape"], "places": [rule(s) for s in b["shape"]]})


def _resolved(shapes: DataFrame) -> DataFrame:
    return shapes.select("shape").mapInPandas(_resolve, "shape string, places array<array<int>>")


def _extracted(parts: Column, places: Column) -> Column:
    """The arguments that stand at these places."""

    def piece(code: Column) -> Column:
        x, how = F.get(parts, F.shiftright(code, 2)), code.bitwiseAND(3)
        return F.when(how == _WHOLE, x).otherwise(F.substring(x, F.when(how == _SECOND, 2).otherwise(1), F.lit(1)))

    return F.transform(places, lambda a: F.when(F.size(a) == 1, piece(F.get(a, 0))).otherwise(F.array_join(F.transform(a, piece), "")))


def unrepeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of a table whose rows are mostly unique by ``keys``: only those that share a key are compared as a whole.

    Keys alone are shuffled and counted; rows with a key of their own go on where they are.
    """
    again = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]), "again", {"n": F.count(F.lit(1))})
    side = F.broadcast(again) if again.observed["n"] <= BROADCAST_KEYS else again.hint("merge")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(side, on, "left_anti").unionByName(df.join(side, on, "left_semi").distinct())


def split_packed(df: DataFrame, text: str, keys: list[str], frequent: int = FREQUENT) -> DataFrame:
    """(keys, pos from 1, value): each argument of column ``text`` as a row of its own.

    Separators outside quotes are white space, semicolons and vertical bars. Ordinary characters are masked, which leaves the field's skeleton of
    separators, quotes and escapes. Each distinct skeleton's rule, the places of the arguments' pieces, is resolved once. The rules of the ``frequent``
    most frequent skeletons are broadcast, which takes care of hot ones; rows of the others, of which none can be hot, meet theirs by shuffle.
    Pieces are then taken by position. Null, empty and all-separator fields give no rows. Columns other than ``keys`` don't come along,
    so their names cannot clash.
    """
    shaped = written(df.where(F.col(text).isNotNull()).select(F.struct(*keys).alias("row"), F.col(text).alias("text"), skeleton(F.col(text)).alias("shape")), "shapes")
    counts = shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.length("shape") <= FREQUENT_PIECES).orderBy(F.desc("n"), "shape").limit(frequent)
    often = F.broadcast(written(_resolved(top), "rules"))
    seldom = shaped.join(often, "shape", "left_anti")
    rare = seldom.join(_resolved(seldom.select("shape").distinct()).hint("merge"), "shape")
    found = shaped.join(often, "shape").unionByName(rare)
    parts = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
    cut = found.select("row", "places", parts.alias("parts")).select("row", F.posexplode(_extracted(F.col("parts"), F.col("places"))).alias("pos", "value"))
    return cut.select(*[F.col("row")[k].alias(k) for k in keys], (F.col("pos") + 1).alias("pos"), "value")
