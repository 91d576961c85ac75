"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the most frequent character n-grams of a language's texts, most frequent first. A
document's own profile is compared with each: an n-gram counts the difference of its two ranks,
or the profile's length when the language lacks it; the nearest language wins, and the score is
1 minus the distance as a part of the largest possible one. Words are runs of letters, lower case,
between two marks of a word's ends; n-grams lie inside words. Profiles are learned from a bounded
sample of the documents that have a language and are not held out: about ``FIT_ROWS`` of each language, or all
of one that has fewer, so rare languages are learned as well.

Cases: a text that is null, empty or without letters is ``und`` with score 0, and so is every
text when nothing could be learned; n-grams of equal frequency rank by code points, languages of
equal distance likewise; repeated rows get the same answer; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, fold, unwrapped, wrapped

#: The longest n-gram: three characters of 21 bits fill a 63-bit number.
LONGEST, BITS = 3, 21
LENGTH = 300
FIT_ROWS = 1000
UNKNOWN = "und"

Profile = tuple[np.ndarray, np.ndarray]


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def packed(text: str) -> np.ndarray:
    """Every n-gram of a text as a number: code points plus 2 (1 marks a word's end), 21 bits each."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.where(_letters()[codes], codes.astype(np.int64) + 2, 1)
    signs = np.concatenate([[1], signs, [1]])
    signs = signs[np.append(True, (signs[1:] != 1) | (signs[:-1] != 1))]
    if len(signs) < 3:
        return np.empty(0, np.int64)
    pairs = signs[:-1] << BITS | signs[1:]
    triples = (pairs[:-1] << BITS | signs[2:])[signs[1:-1] != 1]
    return np.concatenate([signs[signs != 1], pairs, triples])


def gram(key: int) -> str:
    """The n-gram of a number, with _ for a word's end."""
    parts = [key >> BITS * i & (1 << BITS) - 1 for i in range(LONGEST)]
    return "".join("_" if x == 1 else chr(x - 2) for x in reversed(parts) if x)


def ranked(keys: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams, by frequency, then by number (shorter first, then by code points)."""
    if len(keys) > length:
        most = counts >= np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[most], counts[most]
    return keys[np.lexsort((keys, -counts))[:length]]


def distance(profile: np.ndarray, language: Profile, length: int = LENGTH) -> float:
    """The out-of-place distance to a language, as a part of the largest possible one."""
    keys, ranks = language
    at = np.minimum(np.searchsorted(keys, profile), len(keys) - 1)
    there = keys[at] == profile
    places = np.arange(len(profile))
    return float(np.where(there, np.abs(places - ranks[at]), length).sum()) / (length * len(profile))


def predict(text: str | None, languages: dict[str, Profile]) -> tuple[str, float]:
    """(language, score) of a text."""
    keys = packed(text) if text else ()
    if not len(keys) or not languages:
        return UNKNOWN, 0.0
    profile = ranked(*np.unique(keys, return_counts=True))
    far = {k: distance(profile, v) for k, v in languages.items()}
    lang = min(far, key=lambda k: (far[k], k))
    return lang, 1.0 - far[lang]


def picked(doc_id: Column, most: int, n: Column | int) -> Column:
    """True for about ``most`` of ``n`` rows, by a hash of doc_id; for all where there are no more. The share is a part of 2^63, so
    it doesn't vanish however many rows there are."""
    part = F.least(F.lit(float(most)) / n, F.lit(1.0)) * F.lit(2.0**63)
    return F.shiftrightunsigned(F.xxhash64(doc_id), 1).cast("double") < part


def sample(rows: DataFrame, most: int) -> DataFrame:
    """All of ``rows`` if there are at most ``most``, else about ``most`` picked by a hash of doc_id."""
    n = rows.count()
    return rows if n <= most else rows.where(picked(F.col("doc_id"), most, n))


def by_language(rows: DataFrame, most: int, counts: dict[str, int] | None = None) -> DataFrame:
    """About ``most`` rows of each language (all where there are no more), picked by a hash of doc_id; ``counts`` are the rows of
    languages that have more, counted here if not given."""
    if counts is None:
        counts = dict(map(tuple, rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()))
    keep = F.lit(True)
    for lang, n in counts.items():
        keep = F.when(F.col("lang") == lang, picked(F.col("doc_id"), most, n)).otherwise(keep)
    return rows.where(keep)


def fit(docs: DataFrame, most: int = FIT_ROWS, length: int = LENGTH) -> dict[str, Profile]:
    """language -> (n-grams in order of their numbers, their ranks), learned from at most about
    ``most`` rows of each that are not held out. The driver gets ``length`` n-grams for each language.
    """
    rows = by_language(bounded(docs).select("doc_id", "text", "lang").where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 1), most)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                keys, counts = np.unique(np.concatenate([packed(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("r", order).where(F.col("r") <= length).collect()
    out: dict[str, list] = {}
    for row in top:
        out.setdefault(row.lang, []).append((row.gram, row.r - 1))
    return {k: tuple(np.array(sorted(v), np.int64).T.copy()) for k, v in out.items()}


def identified(rows: DataFrame, languages: dict[str, Profile]) -> DataFrame:
    """``rows`` (with a column text) and the struct ``guess`` (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, languages) for t in texts], columns=["lang_pred", "score"])

    return bounded(rows).withColumn("guess", guess("text"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    rows = identified(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "guess.lang_pred", "guess.score")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language could be told."""
    return unwrapped(identified(wrapped(docs, "text"), fit(docs)).where(F.col("guess.lang_pred") != UNKNOWN))
