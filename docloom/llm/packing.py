"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_strings, partitions, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers, in about 50 MB; when there are more it starts anew
#: with those of the texts at hand, all of them even if they are more.
REMEMBER = 1_500_000
#: Words encoded at once: an encoding takes about a kilobyte until its ids are taken from it.
ENCODE = 4096


class _Words:
    """Ids of words between spaces and line ends, in flat arrays by the words' hashes. The tokenizer drops white space
    and never joins across it, so a text's ids are those of its words in turn."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads hold more memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros((0, 2), np.int64)  # first and number of ids, by key
        self.data, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        if not len(words):
            return
        ids, lengths = [], []
        for at in range(0, len(words), ENCODE):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(at, ENCODE).to_pylist(), add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
            lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        new, sizes = np.concatenate(ids), np.concatenate(lengths)
        if self.used + len(new) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(len(self.data), len(new)), np.uint32)])
        self.data[self.used : self.used + len(new)] = new
        place = np.column_stack([self.used + np.cumsum(sizes) - sizes, sizes])
        self.used += len(new)
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.place = np.insert(self.place, at, place[order], axis=0)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and bounds."""
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        hashes = hash_strings(words.dictionary)
        known = self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        if len(self.keys) + (~known).sum() > REMEMBER:
            self.forget()  # and then learn all words of these texts, however many
            known[:] = False
        self.learn(words.dictionary.filter(pa.array(~known)), hashes[~known])
        codes = words.indices.to_numpy(zero_copy_only=False)
        first, size = self.place[np.searchsorted(self.keys, hashes)].T
        first, size = first[codes], size[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return out, ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]


_LOADED: dict[str, _Words] = {}


def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer: str, most: int) -> Iterator[pa.RecordBatch]:
    if tokenizer not in _LOADED:
        _LOADED[tokenizer] = _Words(tokenizer)
    words = _LOADED[tokenizer]
    end = b"\0\0\0\0"
    for batch in slices(batches, "text", 2 << 20):
        texts = pc.fill_null(batch.column("text"), "")
        odd = pc.match_substring(texts, "<|").to_pylist()  # it may spell a special token, whose case counts
        ids, bounds = words.ids(texts)
        rows = []
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            own = ids[bounds[i] : bounds[i + 1]].tobytes() if not odd[i] else np.array(words.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32).tobytes()
            own += end
            n = len(own) // 4
            rows += [(doc, k, at, min(most, n - at), zlib.crc32(own[4 * at : 4 * (at + most)])) for k, at in enumerate(range(0, n, most))]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many alike, {length: pieces in each}), for ``counts`` pieces of each length 1..size.

    Every bin starts with the longest piece left. A bitset of reachable sums over the lengths left then finds the
    fullest combination that fits beside it, and that bin is taken as often as the pieces allow. The work depends
    on the lengths there are, not on how many pieces have them.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    bins = []
    while left:
        top = max(left)
        room = size - top
        rest = sorted((n for n in left if n <= room), reverse=True)
        reach, mask, seen = 1, (1 << (room + 1)) - 1, []
        for n in rest:
            free = left[n] - (n == top)
            took = []
            step = 1
            while free > 0 and step * n <= room:  # 1, 2, 4, ... pieces at once
                k = min(step, free)
                grown = (reach | (reach << (k * n))) & mask
                took.append((k, reach))
                reach, free, step = grown, free - k, 2 * step
            seen.append((n, took))
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        inside = {top: 1}
        for n, took in reversed(seen):
            for k, before in reversed(took):
                if not before >> total & 1:
                    inside[n] = inside.get(n, 0) + k
                    total -= k * n
        times = min(left[n] // c for n, c in inside.items())
        bins.append((times, inside))
        for n, c in inside.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return bins


def pack(documents: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's tokens, in sequences of ``size``.

    Tokens are the tokenizer's ids of the whole text, without special ones, then id 0; a null text is empty, so
    it is one token. Only longer documents are cut, every ``size`` tokens. Rows without doc_id are left out;
    each row that repeats a doc_id is packed as a document of its own.

    Pieces of one length are alike to the packer, so it plans on their counts: at most ``size`` numbers reach the
    driver, and a plan of at most as many bin patterns as lengths allow goes back. Pieces then take the plan's
    slots by their number among equals. They are numbered within salted groups whose totals are summed up before,
    so a length that a third of all pieces share is dealt over all partitions.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    pieces = cut(rows.mapInArrow(lambda it: _tokenize(it, tokenizer, size), PIECES))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("held")))
    plan = minimum_bin_slack({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("held")).collect()}, size)

    slots, first_bin, taken = [], 0, {}
    for times, inside in plan:
        offset = 0
        for n, each in sorted(inside.items(), reverse=True):
            slots.append((n, taken.get(n, 0), first_bin, each, offset))
            taken[n] = taken.get(n, 0) + times * each
            offset += n * each
        first_bin += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]
    plan_b = spark.sparkContext.broadcast((table, keys))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, keys = plan_b.value
        for pdf in batches:
            rank, n = pdf.pop("rank").to_numpy(), pdf.length.to_numpy()
            row = table[np.searchsorted(keys, (n << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pdf.assign(sequence_id=row[:, 2] + nth // row[:, 3], offset=row[:, 4] + nth % row[:, 3] * n)

    before = counts.selectExpr("length", "salt", "sum(held) over (partition by length order by salt rows between unbounded preceding and current row) - held as base")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, start) - 1 as nth")
    numbered = ranked.join(before, ["length", "salt"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "base + nth as rank")
    return numbered.mapInPandas(place, PIECES + ", sequence_id long, offset long")
