"""Pairwise metrics of texts: built-in expressions where they can say it, Arrow functions where they can't."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import text as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def set_scores(expected: Column, found: Column) -> Column:
    """(precision, recall, f1, hits, extra, missed) of two word lists, as sets."""
    hits = F.size(F.array_intersect(expected, found))
    extra, missed = F.size(F.array_except(found, expected)), F.size(F.array_except(expected, found))
    p, r = ratio(hits, hits + extra), ratio(hits, hits + missed)
    return F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), hits.alias("hits"), extra.alias("extra"), missed.alias("missed"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(1 - edit_distance(a, b) / longest, F.lit(0.0)))


def ngram_overlap(expected: Column, found: Column, n: int) -> Column:
    """Distinct shared n-grams per expected n-gram; 0 if either list is shorter than n."""

    def grams(words: Column) -> Column:
        return T.let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))

    shared = F.size(F.array_intersect(grams(expected), grams(found)))
    return F.when((F.size(expected) < n) | (F.size(found) < n), F.lit(0.0)).otherwise(shared / (F.size(expected) - (n - 1)))


def character_edits(a: str, b: str) -> int:
    """Edit distance of two texts; a column of its table is two whole numbers with a bit for each character (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    full, last, at = (1 << len(a)) - 1, 1 << len(a) - 1, {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, total = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        flat = ((same & up) + up ^ up) | same
        right, left = down | full & ~(flat | up), up & flat
        total += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        up, down = (left << 1 | ~(same | down | right)) & full, right & (same | down) & full
    return total


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two long texts, null for null. ``levenshtein`` fills a table of both lengths one by one."""
    return pd.Series([None if x is None or y is None else character_edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of normalised transcripts per reference character, 0 for an empty reference."""
    a, b = T.normal_transcript(reference), T.normal_transcript(hypothesis)
    return ratio(edit_distance(a, b), F.length(a))


def position_accuracy(expected: Column, found: Column) -> Column:
    """Share of expected words that stand at the same place."""
    same = F.size(F.filter(F.zip_with(expected, found, lambda a, b: a == b), lambda x: x))
    return F.when((F.size(expected) == 0) & (F.size(found) == 0), F.lit(1.0)).when((F.size(expected) == 0) | (F.size(found) == 0), F.lit(0.0)).otherwise(same / F.size(expected))


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in x], np.int64) for x in (a, b))


def edit_table(a: list[str], b: list[str]) -> np.ndarray:
    """All edit distances of beginnings of two word lists, a row at a time."""
    x, y = _codes(a, b)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    table[0] = steps = np.arange(len(y) + 1)
    for i in range(1, len(x) + 1):
        row = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (y != x[i - 1]))
        table[i] = np.minimum.accumulate(np.concatenate([[i], row]) - steps) + steps
    return table


def word_errors(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions), going back from the end by match, substitution, insertion, deletion."""
    d = edit_table(reference, hypothesis)
    i, j, s, dels, ins = len(reference), len(hypothesis), 0, 0, 0
    while i and j:
        if reference[i - 1] == hypothesis[j - 1]:
            i, j = i - 1, j - 1
        elif d[i, j] == d[i - 1, j - 1] + 1:
            i, j, s = i - 1, j - 1, s + 1
        elif d[i, j] == d[i, j - 1] + 1:
            j, ins = j - 1, ins + 1
        else:
            i, dels = i - 1, dels + 1
    return s, dels + i, ins + j


def common_subsequence(a: list[str], b: list[str]) -> int:
    x, y = _codes(a, b)
    row = np.zeros(len(y) + 1, np.int32)
    for code in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == code)))
    return int(row[-1]) if len(row) else 0


@F.pandas_udf(StructType([StructField("wer", DoubleType())] + [StructField(c, IntegerType()) for c in ("substitutions", "deletions", "insertions", "errors")]))
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Of normalised transcripts; 0 for an empty reference."""
    rows = []
    for a, b in zip(reference, hypothesis, strict=True):
        x, y = (a or "").split(), (b or "").split()
        s, d, i = word_errors(x, y)
        rows.append(((s + d + i) / len(x) if x else 0.0, s, d, i, s + d + i))
    return pd.DataFrame(rows, columns=["wer", "substitutions", "deletions", "insertions", "errors"])


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("wer", "lcs_ratio", "edit")]))
def order_scores(expected: pd.Series, found: pd.Series) -> pd.DataFrame:
    """Word edit distance by expected words, longest common subsequence, and edit distance by the longer list."""
    rows = []
    for a, b in zip(expected, found, strict=True):
        a, b = list(a), list(b)
        if not a and not b:
            rows.append((0.0, 1.0, 0.0))
        elif not a or not b:
            rows.append((1.0, 0.0, 1.0))
        else:
            e = int(edit_table(a, b)[-1, -1])
            rows.append((e / len(a), common_subsequence(a, b) / len(a), e / max(len(a), len(b))))
    return pd.DataFrame(rows, columns=["wer", "lcs_ratio", "edit"])


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of the standard library, its treatment of popular characters included."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
