"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three
letters, words padded by a blank), counted over all its training texts.  A document's
own list is compared with each profile by out-of-place distance: the sum over its
n-grams of the difference in rank, or PROFILE where the profile lacks it.  n-grams are
exact 63-bit codes of their code points, so nothing is hashed.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import batch

#: n-grams in a profile and in a document's list.
PROFILE = 400
#: Symbols counted at once, and distinct n-grams a training task holds before it passes them on.
PIECE, HELD = 1 << 18, 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2 (no id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> np.ndarray:
    """Letters of the lower-cased text, with one blank around and between runs of them; nothing for a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    clean = np.where(letter, points, np.uint32(32))[keep]
    if not len(clean):
        return np.zeros(0, np.int64)
    return np.concatenate([[32], clean, [32] if clean[-1] != 32 else []]).astype(np.int64)


def gram_counts(*texts: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of all texts; none reaches from one text into the next."""
    x = np.concatenate([_symbols(t) for t in texts]) if len(texts) != 1 else _symbols(texts[0])
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), PIECE):
        y = x[max(at - 2, 0) : at + PIECE]
        new = y[at - max(at - 2, 0) :]
        apart = (y[:-1] == 32) & (y[1:] == 32)  # where one text ends and the next begins
        two = (y[:-1] << 21) | y[1:]
        three = ((two[:-1] << 21) | y[2:])[~(apart[:-1] | apart[1:])]
        skip = 1 if at else 0
        codes = np.concatenate([new[new != 32], two[skip:][~apart[skip:]], three])
        found.append(np.unique(codes, return_counts=True))
    return merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = defaultdict(list)

    def out():
        for lang, found in held.items():
            codes, k = merged(found)
            yield batch(["lang", "gram", "k"], [pa.array([lang] * len(codes), pa.string()), codes, k])
        held.clear()

    for b in batches:
        for at in range(0, b.num_rows, 256):
            texts = defaultdict(list)
            for lang, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, some in texts.items():
                held[lang].append(gram_counts(*some))
                if len(held[lang]) >= 16:
                    held[lang] = [merged(held[lang])]
        if sum(len(c) for found in held.values() for c, _ in found) > HELD:
            yield from out()
    yield from out()


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the ``size`` most frequent n-grams of each language of (text, lang); ties by code."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_train, "lang string, gram long, k long").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    first = Window.partitionBy("lang").orderBy(F.col("k").desc(), "gram")
    ranked = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= size)  # compared as it is, so that each task keeps its own first ``size`` before the shuffle
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Predictor:
    """Languages by out-of-place distance to learned profiles."""

    def __init__(self, names: list[str], grams: np.ndarray, ranks: np.ndarray, size: int):
        self.names, self.grams, self.ranks, self.size = names, grams, ranks, size

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and fit of one text."""
        size, names = self.size, self.names
        codes, k = gram_counts(text) if text else ((), ())
        if not len(codes) or not names:
            return UNKNOWN, 0.0, 0.0
        if len(k) > size:
            least = np.partition(k, len(k) - size)[len(k) - size]
            codes, k = codes[k >= least], k[k >= least]
        top = codes[np.lexsort((codes, -k))][:size]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        far = np.where(known[:, None], np.abs(self.ranks[at] - np.arange(len(top))[:, None]), size)
        d = np.minimum(far, size).sum(0)
        order = np.argsort(d, kind="stable")
        best = d[order[0]]
        second = d[order[1]] if len(names) > 1 else size * len(top)
        return names[order[0]], float(second / (best + second)) if best + second else 0.5, float(1 - best / (size * len(top)))

    def column(self, texts: pa.Array) -> pa.Array:
        found = [self(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "score", "fit"])


def learn(docs: DataFrame, size: int = PROFILE) -> Predictor:
    """A predictor learned from the rows of docs (doc_id, text, lang) that aren't held out and have a lang."""
    learned = profiles(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), size).collect()  # at most ``size`` rows a language
    names = sorted({r.lang for r in learned})
    grams = np.unique(np.array([r.gram for r in learned], np.int64))
    ranks = np.full((len(grams), len(names)), 3 * size, np.int64)  # so far out of place that it counts as ``size`` against any rank
    for r in learned:
        ranks[np.searchsorted(grams, r.gram), names.index(r.lang)] = r["rank"]
    return Predictor(names, grams, ranks, size)


def language_of(text: Column, predictor: Predictor) -> Column:
    """Struct (lang, score, fit) of each text; only texts travel to Python, the rows stay where they are."""

    @F.arrow_udf("lang string, score double, fit double")
    def predict(texts: pa.Array) -> pa.Array:
        return predictor.column(texts)

    return predict.asNondeterministic()(text)  # else a filter on it would have it computed twice


def identify_languages(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, fit of each row of docs (doc_id, text, lang).

    Profiles are learned from rows that aren't held out and have a lang; a prediction
    sees the text alone.  lang_pred is a learned language, or ``und`` where the text is
    null or has no letter (or no language was learned); ties go to the language that
    sorts first.  score is second / (best + second) of the two smallest distances (with
    one language, second is the largest possible), from 0.5 (a tie) to 1; fit is 1 minus the best distance over the largest possible one.
    Repeated rows are predicted each; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = rows.select("doc_id", "held_out", language_of(F.col("text"), learn(rows, size)).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score", "x.fit")


def in_a_language(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Rows of docs whose text is in a learned language; a null lang becomes the prediction.

    Rejected are texts without any letter (null, empty, only signs) and texts of which no
    profile holds an n-gram (fit 0, as in a script that wasn't learned); all columns stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # a column of docs may have any name
    rows = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    found = rows.withColumn("x", language_of(F.col(at["text"]).cast("string"), learn(docs, size)))
    kept = found.where((F.col("x.lang") != UNKNOWN) & (F.col("x.fit") > 0))
    return kept.select(*[(F.coalesce(F.col(n), F.col("x.lang")) if c == "lang" else F.col(n)).alias(c) for c, n in at.items()])
