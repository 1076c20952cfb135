"""What the operators of this subpackage share: cutting lineage, word hashing, batch slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, drop, shared_dir

__all__ = ["cut", "drop", "hash_strings", "hot_keys", "in_parts", "letters_only", "meet", "mix", "parted", "partitions", "shared_dir", "shingles", "slices", "space_words", "translated"]

#: Rows from which on a join key is hot, and parts that a hot key is joined in.
HELD, PARTS = 1024, 64


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than HELD rows have, written: Spark knows the size of what it then joins with."""
    return cut(rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > HELD).select(*keys))


def _all_parts() -> Column:
    return F.sequence(F.lit(0), F.lit(PARTS - 1))


def parted(rows: DataFrame, hot: DataFrame, keys: list[str], by: str, part: str = "part") -> DataFrame:
    """``rows`` with their ``part``: -1, or one of PARTS by the hash of ``by`` where the keys are ``hot``. The marks
    themselves come in parts, so that no task sees all rows of a key."""
    marks = hot.select(*keys, F.explode(_all_parts()).alias(part), F.lit(True).alias("is_hot"))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).join(marks, [*keys, part], "left")
    return dealt.withColumn(part, F.when(F.col("is_hot"), F.col(part)).otherwise(-1)).drop("is_hot")


def in_parts(table: DataFrame, hot: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """The other side of a join with ``parted`` rows: every row for part -1, those of ``hot`` keys for all parts too."""
    copies = table.join(hot, keys, "left_semi").withColumn(part, F.explode(_all_parts()))
    return table.withColumn(part, F.lit(-1)).unionByName(copies)


def meet(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with the one row that ``table`` has for their key, which says how many rows ask for it (``held``):
    a hot key is joined in parts by the hash of ``by``."""
    several = F.when(F.col("held") > HELD, _all_parts()).otherwise(F.array(F.lit(-1)))
    whole = table.withColumn("part", F.explode(several)).drop("held")
    return parted(rows, table.where(F.col("held") > HELD), [key], by).join(whole, [key, "part"]).drop("part")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most_rows`` at most whose ``column`` holds about ``most_bytes`` of text, one row
    at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = min(at + most_rows, max(at + 1, int(np.searchsorted(total, base + most_bytes, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the machine: a worker stays for later tasks, and it would stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux; others need none
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def space_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of every text, split at ASCII white space, A-Z lower-cased; and bounds[i]:bounds[i+1] of text i."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full).dictionary_encode(), kept[ends]


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside a text (shorter texts: one run of all words), with bounds."""
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words to the text's end
    for k in range(width):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
        term = mix(words[k:] * factor + np.uint64(k + 1)) if n > k else words[:0]
        rolled[: n - k] += np.where(left[: n - k] > k, term, np.uint64(0))
    rolled = mix(rolled)
    counts = np.diff(bounds)
    keep = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(keep)])
    picked = np.repeat(bounds[:-1] - starts[:-1], keep) + np.arange(starts[-1])
    return rolled[picked], starts


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte below 0x80 put through ``table``, which maps ASCII to ASCII; null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(table[raw].tobytes()))


def letters_only(digits: bool = False) -> np.ndarray:
    """A table for ``translated``: A-Z to lower case, ASCII other than letters (and digits, if asked) to spaces."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() or (digits and c.isdigit()) else 32
    return table
