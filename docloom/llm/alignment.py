"""Alignment of two tokenizers' tokens over the bytes that they share."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Id pairs whose counts are in memory at once, 13 bytes each.
PAIR_BLOCK = 4_000_000
#: Links that a task counts before it gives the sums out.
COUNT_BLOCK = 4_000_000
#: Bits of a pair's number that the B id takes; A's is above.
B_BITS = 24
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for symbols from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class _Side:
    """A tokenizer's tokens as bytes, one after the other, and its ids as decimal digits."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int32)
        self.first = np.cumsum(self.length, dtype=np.int64) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        digits = len(str(len(tokens)))
        self.digits = np.zeros((len(tokens), digits + 1), np.uint8)  # the last is for the separator
        for i in range(len(tokens)):
            own = str(i).encode()
            self.digits[i, : len(own)] = np.frombuffer(own, np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size, dtype=np.int64)
        return self.data[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class _ByteLevel(_Side):
    """A byte-level BPE file. Its merges are in order of the ids they make, so the ids serve as ranks for the quicker of
    two encoders; where a file's are not, or a text has runs that its pattern could not take, the other one encodes."""

    RUN = re.compile(r"\s{500}|\S{2000}")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None  # loaded for the first text that needs it
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        own = byte_of_symbol()
        ids = described["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *special]) + 1)
        for text, i in ids.items():
            tokens[i] = special.get(i) or bytes(own[c] for c in text)
        super().__init__(tokens)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        made = [ids[a + b] for a, b in pairs]
        ranks = {tokens[i]: i for i in ids.values() if i not in special}
        self.quick = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or self.RUN.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.quick.encode_ordinary(text), np.int32)


class _Pieces(_Side):
    """A sentence-piece model; encoding puts a space before the text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


_LOADED: dict[tuple[str, str], tuple[_ByteLevel, _Pieces]] = {}


def _sides(a: str, b: str) -> tuple[_ByteLevel, _Pieces]:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = _ByteLevel(a), _Pieces(b)
    return _LOADED[a, b]


def owners(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two token rows over the same bytes, given the tokens' lengths.

    Every byte is given the number of the A token and of the B token that hold it. Each change of the two from a byte to
    the next begins a link between the tokens that overlap there; where both change at once, both have ended, and a new
    group begins. Returns the links' A and B tokens, and the groups' first A and B tokens.
    """
    a = np.repeat(np.arange(len(a_lengths), dtype=np.int32), a_lengths)
    b = np.repeat(np.arange(len(b_lengths), dtype=np.int32), b_lengths)
    new_a, new_b = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)], np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]
    link, group = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
    return a[link], b[link], a[group], b[group]


def group_text(a: _Side, b: _Side, a_ids: np.ndarray, b_ids: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> bytes:
    """Groups as "a1,a2|b1;a3|b2,b3": ids separated by commas, A from B by a bar, groups by semicolons."""
    n_a, n_b = len(a_ids), len(b_ids)
    parts = []
    for side, ids, first, last_mark in ((a, a_ids, a_first, ord("|")), (b, b_ids, b_first, ord(";"))):
        rows = side.digits[ids].copy()
        rows[:, -1] = ord(",")
        rows[np.concatenate([first[1:], [len(ids)]]) - 1, -1] = last_mark
        parts.append(rows)
    # place of a token in the text: A tokens of a group come after the B tokens of those before
    a_at = np.arange(n_a) + np.repeat(b_first, np.diff(np.concatenate([a_first, [n_a]])))
    b_at = np.arange(n_b) + np.repeat(np.concatenate([a_first[1:], [n_a]]), np.diff(np.concatenate([b_first, [n_b]])))
    wide = max(p.shape[1] for p in parts)
    text = np.zeros((n_a + n_b, wide), np.uint8)
    text[a_at, : parts[0].shape[1]], text[b_at, : parts[1].shape[1]] = parts
    flat = text.ravel()
    return flat[flat != 0][:-1].tobytes()


def align(a: _ByteLevel, b: _Pieces, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both sides and what ``owners`` says of them; all empty where there is no text or where a side's bytes are
    not a space and the text."""
    none = np.zeros(0, np.int32)
    if not text:
        return (none,) * 6
    raw = np.frombuffer(b" " + text.encode(), np.uint8)
    a_ids, b_ids = a.encode(" " + text), b.encode(text)
    for side, ids in ((a, a_ids), (b, b_ids)):
        if side.length[ids].sum(dtype=np.int64) != len(raw) or not np.array_equal(side.bytes_of(ids), raw):
            return (none,) * 6
    return (a_ids, b_ids, *owners(a.length[a_ids], b.length[b_ids]))


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    a, b = _sides(a_path, b_path)
    for batch in slices(batches, "text", 1 << 20):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            a_ids, b_ids, link_a, link_b, first_a, first_b = align(a, b, text)
            digest = hashlib.sha256(group_text(a, b, a_ids, b_ids, first_a, first_b)).hexdigest() if len(a_ids) else ""
            pairs = np.stack([a_ids[link_a], b_ids[link_b]]).astype(np.int32)
            # ids of 24 bits at most: three planes of bytes, as the upper ones are alike and pack well
            planes = pairs.ravel().view(np.uint8).reshape(-1, 4)[:, :3].T
            rows.append((doc, len(a_ids), len(b_ids), len(first_a), len(link_a), digest, planes.tobytes()))
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ALIGNED.split(", ")])


def _keys(packed: bytes) -> np.ndarray:
    """A number for each link of a document: A's id above B's."""
    planes = np.frombuffer(packed, np.uint8).reshape(3, -1)
    ids = np.zeros((planes.shape[1], 4), np.uint8)
    ids[:, :3] = planes.T
    pair = ids.view(np.int32).reshape(2, -1).astype(np.int64)
    return (pair[0] << B_BITS) | pair[1]


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    return each, np.bincount(at, np.concatenate(counts), len(each)).astype(np.int64)


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, links), summed over as much of a task's rows as ``COUNT_BLOCK`` allows."""
    known, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _totals([known, *waiting], [held, *[np.ones(len(w), np.int64) for w in waiting]])

    for batch in batches:
        for packed in batch.column("pairs").to_pylist():
            if packed:
                waiting.append(_keys(packed))
                size += len(waiting[-1])
            if size > COUNT_BLOCK:
                (known, held), waiting, size = merged(), [], 0
                if len(known) > COUNT_BLOCK:
                    yield pa.record_batch([pa.array(known), pa.array(held)], ["pair", "links"])
                    known, held = known[:0], held[:0]
    known, held = merged() if waiting else (known, held)
    if len(known):
        yield pa.record_batch([pa.array(known), pa.array(held)], ["pair", "links"])


def _scored(batches: Iterator[pa.RecordBatch], block: object) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum grow by those of the block's pairs."""
    keys, counts, best = block.value
    for batch in batches:
        n_best, total = batch.column("n_best").to_pylist(), batch.column("count_sum").to_pylist()
        for i, packed in enumerate(batch.column("pairs").to_pylist()):
            if packed and len(keys):
                own = _keys(packed)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                n_best[i] += int(best[at[hit]].sum())
                total[i] += int(counts[at[hit]].sum())
        columns = {name: batch.column(name) for name in batch.schema.names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        yield pa.record_batch(list(columns.values()), list(columns))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of all documents hold an id pair; best where no pair of its B id has more."""
    counts = aligned.select("pairs").mapInArrow(_count_links, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counts = cut(counts)
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return cut(counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def align_tokenizers(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document's whole text.

    A is a byte-level BPE file, which encodes a space and the text; B a sentence-piece model, which puts the space there
    itself; neither with special tokens, whose spellings in a text are plain text. Where the tokens' bytes of a side are
    not just a space and the text (B may fold characters), and for null or empty texts, there are no tokens: zeros and
    an empty digest. Groups end where tokens of both sides end; links are the pairs of tokens that share bytes. A pair's
    count is how many links of all documents hold its two ids; n_best are links whose pair has its B id's highest
    count, ties too, and count_sum is the sum of all links' counts. Rows without doc_id are left out; each row that
    repeats a doc_id stands for itself; other columns of the caller's are left out; an empty table gives no rows.

    Texts are encoded once and their links written as packed ids. Counting and scoring read these. The pairs' counts
    meet the documents in blocks of ``PAIR_BLOCK`` pairs, sent to all tasks one at a time, so that what is sent is
    bounded however many pairs there are; nothing is grouped by document, and pairs are summed up within tasks first,
    so one that a third of all links hold is no hot key. A text longer than a batch takes memory for some 40 times its
    own size.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    aligned = cut(rows.mapInArrow(lambda it: _aligned(it, a_path, b_path), ALIGNED))
    pairs = pair_counts(aligned)
    blocks = max(1, -(-pairs.count() // PAIR_BLOCK) * 5 // 4)  # blocks are even within a few hundredths
    zero = F.lit(0).cast("long")
    scored = aligned.withColumns({"n_best": zero, "count_sum": zero})
    for i in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow().sort_by("pair")
        block = spark.sparkContext.broadcast(tuple(own.column(c).to_numpy() for c in ("pair", "links", "best")))
        scored = scored.mapInArrow(lambda it, block=block: _scored(it, block), scored.schema)
        if i + 1 < blocks:
            scored = cut(scored)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
