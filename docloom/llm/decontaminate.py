"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_strings, letters_only, shingles, slices, translated

_TABLE = letters_only(digits=True)
WIDTH = 5
#: Windows start STEPS times within their length.
STEPS = 8
#: Shingles whose votes are summed up at a time, and the longest window whose votes 16 bits hold.
STRETCH, SHORT = 1 << 14, 6000
#: Bytes of texts taken together.
SLICE = 2 << 20
#: Windows by items that are compared at once.
PAIRS = 1 << 20
#: Items and characters of a block of the benchmark that one pass holds in memory.
ITEMS, CHARS = 20_000, 1 << 24
FOUND = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (letters and digits, lower case), with bounds."""
    lists = pc.ascii_split_whitespace(translated(pc.utf8_lower(texts), _TABLE))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    words = flat.filter(full).dictionary_encode()
    hashes = hash_strings(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    return hashes, kept[ends]


def _shingled(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed shingles of every text, their weights (how many different words each has) and bounds; a text of fewer than
    ``width`` words has none."""
    words, bounds = _words(texts)
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), starts
    at = np.repeat(bounds[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    hashes, _ = shingles(words, np.array([0, len(words)]), width)
    distinct = np.ones(len(hashes), np.uint8)
    for j in range(1, width):
        repeated = np.zeros(len(hashes), bool)
        for i in range(j):
            repeated |= words[j : j + len(hashes)] == words[i : i + len(hashes)]
        distinct += ~repeated
    return hashes[at], distinct[at], starts


def _running(values: np.ndarray, longest: int) -> np.ndarray:
    """Sums of the rows before each row and after the last, in whole numbers that may wrap around; their
    differences over ``longest`` rows or fewer don't."""
    n = -(-len(values) // 16) * 16
    total = np.zeros((n + 1, values.shape[1]), np.int16 if longest <= SHORT else np.int32)
    total[1 : len(values) + 1] = values
    own = total[1:].reshape(n // 16, 16, -1)
    for i in range(1, 16):
        own[:, i] += own[:, i - 1]
    own[1:] += np.cumsum(own[:-1, 15], axis=0, dtype=total.dtype)[:, None]
    return total


def fingerprints(hashes: np.ndarray, weights: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """64-bit SimHash of the shingles from each start to its end, for each (starts, ends), starts in order.

    Votes are summed up over a stretch of the text and the longest window, so a text of any length takes the memory
    of one stretch. Where windows are short, sums of 16 bits do, as only differences count.
    """
    out = [np.zeros(len(s), np.uint64) for s, _ in windows]
    for base in range(0, len(hashes), STRETCH):
        cuts = [np.searchsorted(s, (base, base + STRETCH)) for s, _ in windows]
        stop = max((int(e[a:b].max()) for (_, e), (a, b) in zip(windows, cuts, strict=True) if b > a), default=0)
        if not stop:
            continue
        bits = np.unpackbits(hashes[base:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits *= weights[base:stop, None]
        longest = max(int((e[a:b] - s[a:b]).max()) for (s, e), (a, b) in zip(windows, cuts, strict=True) if b > a)
        total, mass = _running(bits, longest), np.concatenate([[0], np.cumsum(weights[base:stop], dtype=np.int64)])
        for (s, e), (a, b), prints in zip(windows, cuts, out, strict=True):
            for c in range(a, b, 4096):
                i, j = s[c : min(b, c + 4096)] - base, e[c : min(b, c + 4096)] - base
                half = ((mass[j] - mass[i]) >> 1).astype(total.dtype)
                votes = total[j]
                votes -= total[i]
                prints[c : c + len(i)] = np.packbits(votes > half[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


class HammingIndex:
    """Fingerprints by four blocks of 16 bits: two within ``radius`` differ in radius // 4 bits at most in one of them.

    For each block a table of all 65,536 values says whether some fingerprint's block lies so near; what no table
    knows is out without a comparison, the rest is compared whole, in blocks of bounded size. Tables of many
    fingerprints know most values, so the caller also says which ones are worth it.
    """

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        values = np.arange(1 << 16, dtype=np.uint16)
        self.tables = []
        for b in range(4):
            near = np.zeros(1 << 16, bool)
            for v in np.unique(self._block(prints, b)):
                near |= np.bitwise_count(values ^ v) <= radius // 4
            self.tables.append(np.packbits(near, bitorder="little"))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(16 * b)).astype(np.uint16)

    def near(self, prints: np.ndarray, worth: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, index) of all pairs within the radius, of prints that are worth it."""
        may = np.zeros(len(prints), bool)
        for b, table in enumerate(self.tables):
            value = self._block(prints, b)
            may |= (table[value >> 3] >> (value & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(may & worth)
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        each = max(1, PAIRS // len(self.prints))
        for first in range(0, len(at), each):
            own = at[first : first + each]
            row, item = np.nonzero(np.bitwise_count(prints[own][:, None] ^ self.prints[None]) <= self.radius)
            rows.append(own[row])
            items.append(item)
        return np.concatenate(rows), np.concatenate(items)


class Bag:
    """Shingles of an item with counts and weights, sorted."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        self.hashes, first, self.counts = np.unique(hashes, return_index=True, return_counts=True)
        self.weights = weights[first].astype(np.int64)
        self.total = int((self.counts * self.weights).sum())

    def similarity(self, hashes: np.ndarray, total: int) -> float:
        """Weighted Jaccard similarity with a window's shingles, whose weights add up to ``total``."""
        found, counts = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        same = self.hashes[at] == found
        both = int((np.minimum(counts, self.counts[at]) * self.weights[at])[same].sum())
        return both / (self.total + total - both)


class Group:
    """Items of about the same length, which windows of one size stand for."""

    def __init__(self, sizes: np.ndarray, prints: np.ndarray, items: list[int], bags: list[Bag], radius: int) -> None:
        self.sizes, self.items, self.bags = sizes, items, bags  # sizes in shingles
        self.window = max(1, round(float(np.sqrt(sizes.min() * sizes.max()))))
        self.step = max(1, self.window // STEPS)
        self.index = HammingIndex(prints, radius)
        self.totals = np.array([b.total for b in bags])

    def windows(self, bounds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text) of all windows: at every step, and one at the end of each text. Texts too short to be
        like any item have none."""
        held = np.diff(bounds)
        some = np.flatnonzero((held > 0) & (held * WIDTH >= least * self.sizes.min()))  # weights lie between 1 and the width
        spare = np.maximum(held[some] - self.window, 0)
        each = spare // self.step + 1 + (spare % self.step > 0)
        ends = np.cumsum(each)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each)
        text = np.repeat(some, each)
        starts = np.minimum(nth * self.step, np.repeat(spare, each)) + bounds[text]
        return starts, np.minimum(starts + self.window, bounds[text + 1]), text


    def reachable(self, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, bounds: np.ndarray, shared: np.ndarray, least: float) -> np.ndarray:
        """Whether the exact windows that each window stands for have enough of all items' shingles together, whose weights
        are summed up in ``shared``, to be like the lightest item."""
        longest = int(self.sizes.max())
        reach = self.step + int(np.abs(self.window - self.sizes).max()) // 2 + 1
        lo = np.maximum((starts + ends) // 2 - longest // 2 - 1 - reach, bounds[text])
        stop = np.minimum((starts + ends) // 2 + reach + longest + 1, bounds[text + 1])
        return shared[np.maximum(stop, lo)] - shared[lo] >= least * self.totals.min()


class Items:
    """Benchmark items in groups of lengths that differ by a quarter at most."""

    def __init__(self, rows: list[tuple[int, str]], radius: int) -> None:
        self.groups: dict[int, list[Group]] = {}
        self.known: dict[int, np.ndarray] = {}  # width: all shingles of its items, sorted
        texts = pa.array([t for _, t in rows], pa.string())
        _, bounds = _words(texts)
        words = np.diff(bounds)
        for width in sorted({min(WIDTH, int(n)) for n in words if n}):
            hashes, weights, starts = _shingled(texts, width)
            own = np.flatnonzero((words == width) | ((words > width) & (width == WIDTH)))
            prints = fingerprints(hashes, weights, [(starts[own], starts[own + 1])])[0]
            sizes = words[own] - width + 1
            order, at = np.argsort(sizes, kind="stable"), 0
            self.groups[width] = []
            while at < len(order):
                end = int(np.searchsorted(sizes[order], 1.25 * sizes[order[at]], side="right"))
                g = order[at:end]
                bags = [Bag(hashes[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]]) for i in own[g]]
                self.groups[width].append(Group(sizes[g], prints[g], [rows[i][0] for i in own[g]], bags, radius))
                at = end
            self.known[width] = np.unique(np.concatenate([hashes[starts[i] : starts[i + 1]] for i in own]))

    def matches(self, texts: pa.Array, least: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """(row, item): (similarity, start, words, distance) of its best window, the first one of equals."""
        out: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for width, groups in self.groups.items():
            hashes, weights, bounds = _shingled(texts, width)
            if not len(hashes):
                continue
            mass = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
            at = np.minimum(np.searchsorted(self.known[width], hashes), len(self.known[width]) - 1)
            shared = np.concatenate([[0], np.cumsum(np.where(self.known[width][at] == hashes, weights, 0), dtype=np.int64)])
            windows = [g.windows(bounds, least) for g in groups]
            for g, (starts, ends, text), prints in zip(groups, windows, fingerprints(hashes, weights, [w[:2] for w in windows]), strict=True):
                place, item = g.index.near(prints, g.reachable(starts, ends, text, bounds, shared, least))
                # the exact windows that this one stands for: as long as the item, about the same middle
                size, first, end = g.sizes[item], bounds[text[place]], bounds[text[place] + 1]
                middle, reach = (starts + ends)[place] // 2 - size // 2, g.step + np.abs(g.window - size) // 2 + 1
                lo = np.clip(middle - reach, first, np.maximum(first, end - size))
                hi = np.clip(middle + reach, first, np.maximum(first, end - size))
                stop = np.minimum(hi + size, end)
                may = shared[stop] - shared[lo] >= least * g.totals[item]  # a bound on what any of them can share
                for row, i, a, b, f, e in zip(*(x[may].tolist() for x in (text[place], item, lo, hi, first, end)), strict=True):
                    for at in range(a, b + 1):
                        to = min(at + int(g.sizes[i]), e)
                        s = g.bags[i].similarity(hashes[at:to], int(mass[to] - mass[at]))
                        old = out.get((row, g.items[i]))
                        if s >= least and (old is None or (s, f - at) > (old[0], -old[1])):
                            own = fingerprints(hashes[at:to], weights[at:to], [(np.array([0]), np.array([to - at]))])[0][0]
                            out[row, g.items[i]] = (s, at - f, to - at + width - 1, int(np.bitwise_count(own ^ g.index.prints[i])))
        return out


def _blocks(benchmark: DataFrame, radius: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks, bounded in items and characters, and whether it is the last; one empty block if there is
    no item."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-chars // CHARS))
    for b in range(blocks):
        yield Items([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()], radius), b == blocks - 1


def find_passages(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.75, radius: int = 21) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): each item's best window in each document.

    documents: (doc_id, text); benchmark: (item_id, text). Words are runs of letters, digits and other non-ASCII
    characters in lower case. A window has as many words as the item, or is the whole document where that is shorter.
    Items whose lengths differ by a quarter at most form a group. For each, windows of its middle length, starting at every
    eighth of it and at the end, are fingerprinted by SimHash over their five-word shingles, each weighing as many as
    its different words. Where a fingerprint lies within ``radius`` bits of an item's, the windows of the item's length
    up to both neighbours are compared exactly: one counts from a weighted Jaccard similarity of ``similarity`` on; of
    equal ones the first. hamming is the distance of that window. The index finds every fingerprint within the radius;
    at a similarity of 0.75 about two passages in a hundred lie beyond it, at 0.85 practically none. Items under five words are one shingle. Null or wordless texts match
    nothing; rows without an id are left out; repeated rows give repeated rows, a repeated item_id its best window
    of any of its texts. A text of any length takes the memory of a stretch of it and its words' hashes.

    The benchmark is the query set: blocks of it, bounded in items and characters, each pass over all documents, one
    block in memory at a time. Documents aren't shuffled at all.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    passes = []
    for items, last in _blocks(benchmark, radius):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        found = rows.mapInArrow(_finder(shared, similarity), FOUND)
        passes.append(found if last else cut(found))
        if not last:
            shared.unpersist()
    return reduce(DataFrame.unionByName, passes)


def without_passages(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.75, radius: int = 21) -> DataFrame:
    """The documents, with all their columns, in which ``find_passages`` finds nothing; also those without an id."""
    for items, last in _blocks(benchmark, radius):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        documents = documents.mapInArrow(_dropper(shared, similarity), documents.schema)
        if not last:
            documents = cut(documents)
            shared.unpersist()
    return documents


def _finder(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = shared.value.matches(batch.column("text"), least)
            docs = batch.column("doc_id").to_pylist()
            cols = [[docs[i] for i, _ in out], [item for _, item in out], *([x[k] for x in out.values()] for k in (1, 2, 3, 0))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

    return run


def _dropper(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _ in shared.value.matches(batch.column("text"), least)]] = False
            yield batch.filter(pa.array(keep))

    return run
