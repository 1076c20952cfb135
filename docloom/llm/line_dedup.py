"""Repeated lines across documents: range-partitioned hashes, streamed in order, kept as bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, partitions, slices

BLANK = " \t\n\x0b\x0c\r"
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LINES = "hi long, lo long, doc_id long, pos int"


def _hash_lines(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        digests, docs, pos = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for i, line in enumerate((text or "").split("\n")):
                line = line.strip(BLANK)
                if len(line) >= least_chars:
                    digests.append(hashlib.blake2b(line.encode().translate(UPPER), digest_size=16).digest())
                    docs.append(doc)
                    pos.append(i)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs, pa.int64()), pa.array(pos, pa.int32())], ["hi", "lo", "doc_id", "pos"])


def _stream(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Lines to drop, and lines of groups that reach the partition's edge, which other partitions may share.

    Rows come by key, larger doc_id first, then position: of a group's lines those of the document met first stay.
    Only the two ends of a partition can belong to a group that was cut; their rows go out as open, and first
    marks the first row of a document in them.
    """
    group = 0
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_()), ("first", pa.bool_())])
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carry = table if carry is None else pa.concat_tables([carry, table])
        hi, lo = carry.column("hi").to_numpy(), carry.column("lo").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        for out in _decide(carry.slice(0, int(starts[-1])), starts[:-1], group == 0, least_docs, schema) if len(starts) > 1 else ():
            yield out
        group += len(starts) - 1
        carry = carry.slice(int(starts[-1])).combine_chunks()
        if carry.num_rows > 200_000:  # one key alone: its rows are open and needn't be held
            docs = carry.column("doc_id").to_numpy()
            end = int(np.flatnonzero(docs != docs[-1])[-1]) + 1 if (docs != docs[-1]).any() else 0
            if end:
                yield from _open(carry.slice(0, end), schema)
                carry, group = carry.slice(end).combine_chunks(), 0
    if carry is not None and carry.num_rows:
        yield from _open(carry, schema)
    give_back()


def _open(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    docs = table.column("doc_id").to_numpy()
    first = np.concatenate([[True], docs[1:] != docs[:-1]])
    full = table.append_column("open", pa.array(np.ones(len(docs), bool))).append_column("first", pa.array(first)).cast(schema)
    yield from full.to_batches()


def _decide(table: pa.Table, starts: np.ndarray, edge: bool, least_docs: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    docs = table.column("doc_id").to_numpy()
    sizes = np.diff(np.concatenate([starts, [n]]))
    head = np.zeros(n, bool)
    head[starts] = True
    first = head | np.concatenate([[True], docs[1:] != docs[:-1]])
    met = np.add.reduceat(first.astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    keeper = docs[starts][group] == docs
    drop = (met[group] >= least_docs) & ~keeper
    if edge:
        drop[: sizes[0]] = False
    picked = table.filter(pa.array(drop))
    k = picked.num_rows
    yield from picked.append_column("open", pa.array(np.zeros(k, bool))).append_column("first", pa.array(np.zeros(k, bool))).cast(schema).to_batches()
    if edge:
        yield from _open(table.slice(0, int(sizes[0])), schema)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit i of a document's bitmap is set where line i stays; compressed. It ends with the last line that goes."""
    for batch in batches:
        packed = []
        for pos in batch.column("pos").to_pylist():
            bits = np.ones(-(-(max(pos) + 1) // 8) * 8, np.uint8)
            bits[pos] = 0
            packed.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "keep_bitmap"])


def repeated_lines(documents: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, keep_bitmap) of documents that lose lines; a bitmap is a zlib-packed bit per line, set where it stays, up to
    the last line that goes. Lines after it, and all those of documents without a bitmap, stay.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code
    points at least that stand in ``least_docs`` documents at least lose every line but those of the largest
    doc_id holding them. Null texts are one empty line. Rows without doc_id are left out; rows that repeat a
    doc_id count as one document, and lose the same line numbers.

    Only hashes travel: they are dealt by ranges of (key, document), so a key that a third of all lines share
    spreads over many partitions; each partition streams its keys in order. A key that may go on in a
    neighbouring partition is decided from the per-key totals of such edges, at most two keys a partition. Both read
    the streamed rows as they were written once, as ranges dealt anew could lie elsewhere.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    lines = rows.mapInArrow(lambda it: _hash_lines(it, least_chars), LINES)
    dealt = lines.repartitionByRange(partitions(spark), F.col("hi"), F.col("lo"), F.col("doc_id").desc()).sortWithinPartitions(F.col("hi"), F.col("lo"), F.col("doc_id").desc(), F.col("pos"))
    decided = cut(dealt.mapInArrow(lambda it: _stream(it, least_docs), LINES + ", open boolean, first boolean"))
    edges = decided.where("open").groupBy("hi", "lo").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("doc_id").alias("keeper"))
    gone = decided.join(F.broadcast(edges.where(F.col("docs") >= least_docs)), ["hi", "lo"], "left").where("not open or doc_id <> keeper")
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc_id long, keep_bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        total, dropped, kept = [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n = len(lines)
            if packed is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[:n]
                lines = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
            total.append(n)
            dropped.append(n - len(lines))
            kept.append("\n".join(lines))
        if digest:
            kept = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
        arrays = {"n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256" if digest else "kept_text": pa.array(kept, pa.string())}
        for i, name in enumerate(batch.schema.names):
            if name not in ("text", "keep_bitmap"):
                arrays[name] = batch.column(i)
        yield pa.record_batch(list(arrays.values()), list(arrays))


def kept_lines(documents: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """Documents with n_lines, n_dropped and kept_text, or kept_sha256 in its place, after ``repeated_lines``.

    These columns take the place of the caller's own of such names, text goes, other columns stay. Rows come back one for
    one; those without doc_id lose no line, null texts are one empty line.
    """
    rest = [f.name for f in documents.schema if f.name not in ("text", "n_lines", "n_dropped", "kept_text", "kept_sha256", "keep_bitmap")]
    both = documents.select(*rest, F.col("text").cast("string").alias("text")).join(bitmaps, "doc_id", "left").select(*rest, "text", "keep_bitmap")
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return both.mapInArrow(lambda it: _apply(it, digest), f"n_lines long, n_dropped long, {'kept_sha256' if digest else 'kept_text'} string, {kinds}")
