"""Phrases of words that stand together oftener than their parts would: substrings counted by suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, hash_strings, mix, slices

#: Text of a shard, over which one automaton is built; a longer document is a shard of its own.
SHARD_BYTES = 6 << 20
#: A set of frequent phrases is a bitmap of about eight bits to a phrase, in these limits. Where there are more, it lets
#: more of the rare ones through, which are then counted for nothing.
LEAST_BITS, MOST_BITS = 15, 29


class Automaton:
    """A suffix automaton of the substrings of ``depth`` letters at most of many pieces, built level by level in arrays.

    letters[i] is the i-th word as a number, pieces[i] the piece it stands in. A substring is known by its length m and a
    number; ends[m][i] is that of the one of m letters that ends at i (-1: none, or one that was left out). Substrings
    that end at the same places are one state: a substring and its suffix are exactly when both end as often, so a state
    is given by its longest member, and the link of a state leads to the longest suffix that ends at more places.
    """

    def __init__(self, letters: np.ndarray, pieces: np.ndarray) -> None:
        self.letters = letters
        n = len(letters)
        self.room = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate([[True], pieces[1:] != pieces[:-1]])[:n], np.arange(n), 0)) + 1  # letters of the piece up to here
        self.ends: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.last: list[np.ndarray] = [np.zeros(0, np.int64)]  # a place where each substring ends
        self.count: list[np.ndarray] = [np.zeros(0, np.int64)]  # at how many it ends
        self.suffix: list[np.ndarray] = [np.zeros(0, np.int64)]  # the substring without its first letter
        self.depth = 0
        self._level(letters.astype(np.int64), np.ones(n, bool))

    def _level(self, key: np.ndarray, there: np.ndarray) -> None:
        at = np.flatnonzero(there)
        _, first, number, count = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
        ends = np.full(len(self.letters), -1, np.int64)
        ends[at] = number
        self.suffix.append(self.ends[-1][at[first]] if self.depth else np.zeros(len(first), np.int64))
        self.ends.append(ends)
        self.last.append(at[first])
        self.count.append(count)
        self.depth += 1

    def keep(self, wanted: np.ndarray) -> None:
        """Leaves out substrings of the last level, and so all that hold them."""
        ends = self.ends[-1]
        if len(wanted):  # else no substring is left as it is
            self.ends[-1] = np.where((ends >= 0) & wanted[ends], ends, -1)

    def deepen(self) -> None:
        """The next level: a substring is its suffix and the letter before it, and its prefix must be kept too."""
        m = self.depth
        ends, n = self.ends[m], len(self.letters)
        there = (self.room > m) & (ends >= 0)
        there[1:] &= ends[:-1] >= 0
        first = np.zeros(n, np.int64)
        first[m:] = self.letters[: n - m] if m < n else first[m:]
        self._level(ends * (int(self.letters.max(initial=0)) + 1) + first, there)

    def states(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the kept substrings of length m that are the longest of their state: their numbers, and how many letters the
        shortest of the state has. A state ends where a letter before its longest member makes one that ends less often."""
        kept = np.zeros(len(self.count[m]), bool)
        kept[self.ends[m][self.ends[m] >= 0]] = True
        if m < self.depth:
            above = np.unique(self.ends[m + 1][self.ends[m + 1] >= 0])
            below = self.suffix[m + 1][above]
            kept[below[self.count[m + 1][above] == self.count[m][below]]] = False
        top = np.flatnonzero(kept)
        shortest = np.full(len(top), m)
        at = top
        for k in range(m, 1, -1):  # along the suffixes, while they end as often
            at = self.suffix[k][at]
            shortest[(self.count[k - 1][at] == self.count[m][top]) & (shortest == k)] = k - 1
        return top, shortest


_WORD, _BLANK, _MARK = 0, 1, 2
_CLASS, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_CLASS[list(b" \t")] = _BLANK
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _MARK
_LOWER[ord("A") : ord("Z") + 1] += 32


class Shard:
    """Words of some documents: letters[i] of the i-th one, its piece, and each letter's word, language and hash. The same
    word in two languages is two letters."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        kind = _CLASS[raw]
        inside = kind == _WORD
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(raw))]  # documents end there, whatever the bytes
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        length = np.concatenate([[0], np.cumsum(end - start, dtype=np.int64)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(length.tobytes()), pa.py_buffer(_LOWER[raw[inside]].tobytes())).dictionary_encode()
        document = np.searchsorted(bounds, start, side="right")  # empty documents share an edge, which makes no difference
        self.pieces = np.cumsum(kind == _MARK, dtype=np.int64)[start] + document
        languages = pc.fill_null(langs, "und").dictionary_encode()
        language = languages.indices.to_numpy(zero_copy_only=False)[document - 1].astype(np.int64)
        size = max(1, len(words.dictionary))
        pairs, letters = np.unique(language * size + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.letters = letters.astype(np.int64)
        self.words, self.langs = words.dictionary.take(pa.array(pairs % size)), languages.dictionary.take(pa.array(pairs // size))
        tongue = mix(hash_strings(languages.dictionary) + np.uint64(1))[pairs // size]
        self.hashes = mix(hash_strings(words.dictionary)[pairs % size] ^ tongue)

    def keys(self, machine: Automaton, m: int) -> np.ndarray:
        """64-bit hashes of the automaton's substrings of length m."""
        out = np.zeros(len(machine.last[m]), np.uint64)
        for k in range(m - 1, -1, -1):
            out = mix(out + self.hashes[self.letters[machine.last[m] - k]])
        return out

    def phrases(self, machine: Automaton, m: int, numbers: np.ndarray) -> pa.Array:
        own = [self.words.take(pa.array(self.letters[machine.last[m][numbers] - k])) for k in range(m - 1, -1, -1)]
        return pc.binary_join_element_wise(*own, pa.scalar(" ", pa.large_string()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in slices(batches, "text", SHARD_BYTES):
        yield Shard(batch.column("lang"), batch.column("text"))


def _has(bitmap: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    bits, width = bitmap
    at = (keys >> np.uint64(64 - width)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _pruned(shard: Shard, depth: int, bitmaps: list[tuple[np.ndarray, int]]) -> Automaton:
    """The shard's automaton down to ``depth``, of phrases of which each bitmap (of one word, two words, ...) has all parts."""
    machine = Automaton(shard.letters, shard.pieces)
    for m in range(1, depth + 1):
        if m > 1:
            machine.deepen()
        if m <= len(bitmaps):
            machine.keep(_has(bitmaps[m - 1], shard.keys(machine, m)))
    return machine


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        yield pa.record_batch({"lang": shard.langs.cast(pa.string()), "phrase": shard.words.cast(pa.string()), "key": pa.array(mix(shard.hashes).view(np.int64)), "f": pa.array(np.bincount(shard.letters, minlength=len(shard.words)).astype(np.int64))})


def _count_keys(batches: Iterator[pa.RecordBatch], depth: int, bitmaps: object) -> Iterator[pa.RecordBatch]:
    """(key, f) of phrases of ``depth`` words whose parts are all in the bitmaps."""
    for shard in _shards(batches):
        machine = _pruned(shard, depth, bitmaps.value)
        yield pa.record_batch({"key": pa.array(shard.keys(machine, depth).view(np.int64)), "f": pa.array(machine.count[depth].astype(np.int64))})


def _count_phrases(batches: Iterator[pa.RecordBatch], depth: int, bitmaps: object) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, shortest, f): the automaton's states, each by its longest phrase and how many words its shortest has;
    all of a state's phrases end it alike and stand ``f`` times."""
    for shard in _shards(batches):
        machine = _pruned(shard, depth, bitmaps.value)
        for m in range(2, depth + 1):
            numbers, shortest = machine.states(m)
            langs = shard.langs.take(pa.array(shard.letters[machine.last[m][numbers]]))
            yield pa.record_batch({"lang": langs.cast(pa.string()), "phrase": shard.phrases(machine, m, numbers).cast(pa.string()), "shortest": pa.array(np.maximum(shortest, 2).astype(np.int32)), "f": pa.array(machine.count[m][numbers].astype(np.int64))})


def _bitmap(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap of the first bits of ``key``, about eight bits to a key; made in blocks of 4 KB, of which there are 2^14 at most."""
    width = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(8 * keys.count() + 1)))))
    bit = F.shiftrightunsigned("key", 64 - width) + 1  # Spark's bitmaps begin at 1
    blocks = keys.groupBy(F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    bits = np.zeros((1 << width) // 8, np.uint8)
    for block, own in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        bits[(block - 1) * 4096 : block * 4096] = np.frombuffer(own, np.uint8)
    return bits, width


def phrase_counts(documents: DataFrame, depth: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, f): of all single words, and of phrases of 2 to ``depth`` words that stand ``least`` times.

    A phrase can only be frequent where all its parts are. So words are counted first, then phrases of two words by a
    hash, then of three, ...: each time only those whose parts were frequent, by a bitmap of bounded size that may let
    rare ones through but leaves out none. Last, the phrases that all bitmaps have are counted as they are. In every pass
    a task builds automata over shards of its texts and gives out sums, so no phrase is a hot key.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_count_words, "lang string, phrase string, key long, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.first("key").alias("key"))
    words = cut(words)
    bitmaps = [_bitmap(words.where(F.col("f") >= least).select("key"))]
    for m in range(2, depth + 1):
        sent = spark.sparkContext.broadcast(bitmaps)
        keys = rows.mapInArrow(lambda it, m=m, sent=sent: _count_keys(it, m, sent), "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("key")
        keys = cut(keys)
        bitmaps.append(_bitmap(keys))
        drop(keys)
        sent.unpersist()
    sent = spark.sparkContext.broadcast(bitmaps)
    states = rows.mapInArrow(lambda it: _count_phrases(it, depth, sent), "lang string, phrase string, shortest int, f long")
    spelt = states.select("lang", "f", F.split("phrase", " ").alias("ws"), "shortest")
    each = spelt.select("lang", "f", "ws", F.explode(F.sequence("shortest", F.size("ws"))).alias("m")).select("lang", F.array_join(F.slice("ws", -F.col("m"), F.col("m")), " ").alias("phrase"), "f")
    phrases = cut(each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return words.select("lang", "phrase", "f"), phrases


def collocations(documents: DataFrame, depth: int = 4, least: int = 30, scale: int = 2_000_000, inside_percent: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of 2 to ``depth`` words that stand ``least`` times in a language's texts.

    Texts have A-Z in lower case and are split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into
    words; a null text is empty, a null lang is "und", doc_id is not looked at and other columns are left out; repeated
    rows count each time; an empty table gives no rows. a is how often the phrase stands inside pieces, overlaps included,
    n the number of all words of the language. A phrase cut in two gives l and r, how often the parts stand, and the score
    floor(scale * a / (l + r)); the cut with the lowest score counts, of equal ones the first. Arithmetic is in whole
    decimals of 38 digits.

    A phrase goes where a longer one holds it and stands at least ``inside_percent`` percent as often. Any longer phrase
    that does so holds one of just one word more that does, so each phrase is laid against those that it is the suffix
    of (the links of the automata's substrings) or the prefix of.
    """
    words, phrases = phrase_counts(documents, depth, least)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ws = F.split("phrase", " ")
    held = phrases.select("lang", F.col("f").alias("longer"), ws.alias("ws")).where(F.size("ws") > 2)
    n = F.size("ws")
    inside = held.select("lang", "longer", F.explode(F.array(F.slice("ws", 1, n - 1), F.slice("ws", 2, n - 1))).alias("part")).groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    free = phrases.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside_percent} * f").select("lang", "phrase", F.col("f").alias("a"))
    cuts = free.select("lang", "phrase", "a", ws.alias("ws")).select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    sides = F.inline(F.array(F.struct(F.lit(True).alias("left"), F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("part")), F.struct(F.lit(False).alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, n), " ").alias("part"))))
    counts = words.where(F.col("f") >= least).unionByName(phrases).select("lang", F.col("phrase").alias("part"), "f")
    met = cuts.select("lang", "phrase", "a", "k", sides).join(counts, ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    scored = both.withColumn("score", F.expr(f"cast(a as decimal(25, 0)) * cast({scale} as decimal(12, 0)) div cast(l + r as decimal(20, 0))"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return least_cut.join(F.broadcast(total) if _few(total) else total, "lang").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def _few(table: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has so few rows that every task can have them."""
    return table.limit(most + 1).count() <= most


def top_collocations(found: DataFrame, most: int = 2000) -> DataFrame:
    """rank 1 to ``most`` of each language, by score, then a, then the phrase's bytes. Tasks first keep their own best, so
    only ``most`` rows of each come together."""
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
