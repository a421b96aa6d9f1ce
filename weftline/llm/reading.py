"""Reading level of each document: share of unfamiliar words plus average sentence length."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.shared import release, written

# Headings of the parts of a document, and frequent function words of each language.
PROSE_HEADS = ("abstract", "description", "zusammenfassung", "beschreibung", "abrégé", "resumen", "descripción")
CLAIM_HEADS = ("claims", "ansprüche", "patentansprüche", "revendications", "reivindicaciones")
FUNCTION_WORDS = {
    "en": ("the", "this", "each", "said", "and", "of", "is", "which"),
    "de": ("der", "die", "das", "jede", "diese", "ein", "und", "eine"),
    "fr": ("le", "la", "chaque", "ce", "un", "une", "dans", "et"),
    "es": ("el", "la", "cada", "este", "un", "una", "los", "y"),
}
#: Share of sentences left out at either end of a document, which keeps foreign passages, formulas and damage out of its means.
TRIM = 0.25
#: A document counts by this power of the share of its language's documents with sentences at least as long, so plain documents count most and all count.
PLAINER = 4
#: Weights are whole numbers of this unit, so their sums don't depend on the order.
UNIT = 1_000_000
#: A word is familiar if documents with at least this share of all weight have it.
FAMILIAR = 0.10
#: Sentence lengths are ranked in steps of half a word up to this many steps.
STEPS = 800
#: Familiar words are broadcast as a list; a word that holds FAMILIAR of documents with at most so many distinct words each bounds it.
MAX_LIST = 200_000
LEVELS = (1, 2, 3, 4)

_CLAIMS = re.compile(r"^[^\w\n]*(?:" + "|".join(CLAIM_HEADS) + r")[^\w\n]*$", re.M | re.I)
_HEADS = re.compile(r"^[^\w\n]*(?:" + "|".join(PROSE_HEADS) + r")[^\w\n]*$", re.M | re.I)
_JOIN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
_STOP = re.compile(r"[.!?]+(?=\s|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_TWICE = re.compile("[ÃÂ][\x80-\xbf€-™]")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a document's abstract and description; of all text before the claims if it has no such heading."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _TWICE.sub(lambda m: m[0].encode("cp1252", "ignore").decode("utf8", "ignore") or m[0], text))
    if m := _CLAIMS.search(text):
        text = text[: m.start()]
    if m := _HEADS.search(text):
        text = _HEADS.sub(".", text[m.end() :])
    text = _JOIN.sub("", text).lower()
    return [w for s in _STOP.split(text) if (w := _WORDS.findall(s))]


def trimmed(values: np.ndarray) -> float:
    """Mean without the share TRIM of values at either end; of no values, 0."""
    k = int(len(values) * TRIM)
    v = np.sort(values)[k : len(values) - k]
    return float(v.mean()) if len(v) else 0.0


def profiles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, lang, length, vocabulary, codes, sizes) of each non-empty text: language by function words, trimmed mean sentence length, distinct words, and the sentences as codes of them."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                parts = sentences(t)
                voc: dict[str, int] = {}
                codes = np.array([voc.setdefault(w, len(voc)) for s in parts for w in s], np.int32)
                sizes = np.array([len(s) for s in parts], np.int32)
                n = np.bincount(codes, minlength=len(voc))
                score = {g: sum(int(n[voc[w]]) for w in ws if w in voc) for g, ws in FUNCTION_WORDS.items()}
                lang = max(score, key=score.get)
                for col, v in zip(rows, (k, lang if score[lang] else "und", trimmed(sizes), list(voc), codes.tobytes(), sizes.tobytes()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["d", "l", "n", "v", "c", "s"])

    cols = df.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    return cols.mapInArrow(profile, "doc long, lang string, length double, vocabulary array<string>, codes binary, sizes binary")


def familiar_words(prof: DataFrame) -> DataFrame:
    """(lang, word): the words of highest document frequency in each language, over all its documents.

    Each document counts with (1 - q) ** PLAINER, q being the share of the language's documents with shorter sentences, from a histogram over all documents
    in steps of half a word. Unweighted frequencies don't tell plain words from hard ones where most documents are hard.
    """
    read = prof.where(F.col("length") > 0).withColumn("step", F.least(F.floor(F.col("length") * 2), F.lit(STEPS)))
    steps = read.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("lang")
    ranked = steps.withColumns({"below": F.sum("n").over(w.orderBy("step")) - F.col("n"), "all": F.sum("n").over(w)})
    weight = F.round(F.pow(1 - F.col("below") / F.col("all"), F.lit(PLAINER)) * UNIT).cast("long")
    weights = ranked.select("lang", "step", "n", weight.alias("weight"))
    total = weights.groupBy("lang").agg(F.sum(F.col("weight") * F.col("n")).alias("total"))
    counted = read.join(F.broadcast(weights.where("weight > 0").drop("n")), ["lang", "step"]).select("lang", "weight", F.explode("vocabulary").alias("word"))
    df = counted.groupBy("lang", "word").agg(F.sum("weight").alias("df"))
    return df.join(F.broadcast(total), "lang").where(F.col("df") >= F.col("total") * FAMILIAR).select("lang", "word")


def features(prof: DataFrame, familiar: dict[str, set[str]]) -> DataFrame:
    """(doc, length, unfamiliar): trimmed mean over sentences of the share of words outside the list."""
    shared = prof.sparkSession.sparkContext.broadcast(familiar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, voc, codes, sizes in zip(*[b.column(i).to_pylist() for i in (1, 3, 4, 5)], strict=True):
                known = shared.value.get(lang, set())
                strange = np.array([w not in known for w in voc], np.float64)
                n = np.frombuffer(sizes, np.int32)
                if not len(n):
                    out.append(0.0)
                    continue
                cuts = np.concatenate([[0], np.cumsum(n)[:-1]])
                out.append(trimmed(np.add.reduceat(strange[np.frombuffer(codes, np.int32)], cuts) / n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64())], names=["a", "b", "c"])

    return prof.mapInArrow(measure, "doc long, length double, unfamiliar double")


def fitted(feats: DataFrame, labels: DataFrame) -> tuple[list[float], list[float]]:
    """(weights of 1, length and unfamiliar; three cuts), from sums over all labels and a histogram of scores by level.

    Weights are the least squares for the labelled level; each cut is where the fewest labels fall on the wrong side.
    Without labels, or with labels of one kind, the formula is sentence length with cuts at 10.5, 18 and 26.5 words.
    """
    both = feats.join(labels.where(F.col("level").isin(*LEVELS)).select(F.col("doc_id").alias("doc"), F.col("level").cast("double").alias("y")), "doc").where(F.col("length") > 0)
    x = {"one": F.lit(1.0), "length": F.col("length"), "unfamiliar": F.col("unfamiliar")}
    names = list(x)
    sums = both.agg(
        *[F.sum(x[a] * x[b]).alias(f"{a}_{b}") for a in names for b in names], *[F.sum(x[a] * F.col("y")).alias(f"{a}_y") for a in names], F.count_distinct("y").alias("kinds")
    ).first()
    if (sums["kinds"] or 0) < 2:
        return [0.0, 1.0, 0.0], [10.5, 18.0, 26.5]
    a = np.array([[sums[f"{p}_{q}"] for q in names] for p in names])
    weights = np.linalg.lstsq(a, np.array([sums[f"{p}_y"] for p in names]), rcond=None)[0].tolist()
    step = 0.01
    # Scores beyond the ends, far from any cut between levels 1 and 4, count in the first and the last bin.
    bin_ = F.greatest(F.least(F.floor(_score(weights) / step), F.lit(1500)), F.lit(-500))
    rows = both.groupBy(bin_.alias("at"), F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    at, y, n = (np.array([r[k] for r in rows], np.int64) for k in ("at", "y", "n"))
    edges = np.arange(-500, 1502)
    cuts = []
    for level in LEVELS[:-1]:
        upper = np.bincount(at[y > level] + 500, n[y > level], len(edges))
        lower = np.bincount(at[y <= level] + 500, n[y <= level], len(edges))
        wrong = np.concatenate([[0], np.cumsum(upper)[:-1]]) + lower.sum() - np.concatenate([[0], np.cumsum(lower)[:-1]])
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(float(edges[best[len(best) // 2]] * step))
    return weights, sorted(cuts)


def _score(weights: list[float]) -> Column:
    return F.lit(weights[0]) + F.lit(weights[1]) * F.col("length") + F.lit(weights[2]) * F.col("unfamiliar")


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, level, score, length, unfamiliar) of every document with a non-empty text.

    The text is read once; its profile, a few bytes a word, is kept in the shared folder until document frequencies and shares have come from it.
    The fit uses the shares of labelled documents. Texts without words in their prose get level 1. A repeated document comes out once per row.
    """
    prof = written(profiles(docs, key, text), "profiles")
    words: dict[str, set[str]] = {}
    listed = familiar_words(prof).limit(MAX_LIST + 1).collect()
    if len(listed) > MAX_LIST:
        raise ValueError("the list of familiar words is longer than MAX_LIST")
    for lang, word in listed:
        words.setdefault(lang, set()).add(word)
    feats = written(features(prof, words), "features")
    release(prof)
    weights, cuts = fitted(feats, labels)
    s = feats.withColumn("score", _score(weights))
    level = sum((F.when(F.col("score") >= c, 1).otherwise(0) for c in cuts), F.lit(1))
    return s.select("doc", F.when(F.col("length") > 0, level).otherwise(1).cast("int").alias("level"), "score", "length", "unfamiliar")


def level_profile(levels: DataFrame, docs: DataFrame, by: str = "source") -> DataFrame:
    """Documents, mean sentence length and mean unfamiliar share per value of ``by`` and level."""
    d = levels.join(docs.select(F.col("doc_id").alias("doc"), by), "doc")
    return d.groupBy(by, "level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"), F.avg("unfamiliar").alias("mean_unfamiliar"))
