"""Chunkers: text columns to arrays of (span_start, span_end, text), and tables of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Chunker = Callable[[Column], Column]


def _spans(text: Column, starts: Column, ends: Callable[[Column], Column]) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("span_start"), ends(s).cast("int").alias("span_end"), F.substring(text, s + 1, ends(s) - s).alias("text")))


def char_windows(text: Column, size: int, overlap: int, keep_blank: bool = False) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before, up to the first that
    reaches the end. Blank ones go unless asked for."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap

    def windows(n: Column) -> Column:
        last = F.greatest(F.ceil((n - size) / stride).cast("int"), F.lit(0)) * stride
        starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return _spans(text, starts, lambda s: F.least(s + size, n))

    out = T.let(F.length(text), windows)
    return out if keep_blank else F.filter(out, lambda c: c.text.rlike(r"(?U)\S"))


def paragraphs(text: Column) -> Column:
    """Runs cut before every newline that follows a newline, so later ones start with that newline; blank ones go.

    Offsets come from one pass over the pieces, whose lengths are summed up with the newline dropped between them.
    """
    pieces = F.split(text, "\n(?=\n)", -1)
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<span_start:int,span_end:int,text:string>>").alias("out")),
        lambda acc, p: F.struct((acc.at + F.length(p) + 1).cast("int").alias("at"), F.concat(acc.out, F.array(F.struct(acc.at.alias("span_start"), (acc.at + F.length(p)).cast("int").alias("span_end"), p.alias("text")))).alias("out")),
        lambda acc: acc.out,
    )
    return F.filter(placed, lambda c: c.text.rlike(r"(?U)\S"))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` white-space tokens as character spans, from the first token's start to the last one's end.

    Token offsets need a scan with memory, which no built-in gives in linear time; an Arrow function does it.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap

    @F.udf("array<struct<span_start:int,span_end:int,text:string>>", useArrow=False)  # a hundred rows at a time
    def cut(text: str | None) -> list[dict]:
        return list(_windows(text or "", size, stride))

    return cut(text)


def _windows(text: str, size: int, stride: int) -> Iterator[dict]:
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    for first in range(0, len(spans), stride):
        last = min(first + size, len(spans)) - 1
        start, end = spans[first][0], spans[last][1]
        yield {"span_start": start, "span_end": end, "text": text[start:end]}
        if last + 1 == len(spans):
            return


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark; trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: s != "")


def chunk_table(items: DataFrame, chunker: Chunker) -> DataFrame:
    """(item_id, catalog_pos, chunk_pos, span_start, span_end, text) of items (item_id, catalog_pos, text)."""
    return items.select("item_id", "catalog_pos", F.posexplode(chunker(F.col("text"))).alias("chunk_pos", "c")).select("item_id", "catalog_pos", "chunk_pos", "c.span_start", "c.span_end", "c.text")


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id 0, 1, ... over all items in catalog order.

    Ids are a running sum of chunk counts, taken in two levels: within blocks of items, then over the blocks, so no
    single task ever orders all chunks or all items.
    """
    counts = chunks.groupBy("catalog_pos").agg(F.count("*").alias("n")).withColumn("block", (F.col("catalog_pos") / 4096).cast("long"))
    inner = counts.selectExpr("catalog_pos", "block", "sum(n) over (partition by block order by catalog_pos) - n as inside")
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).withColumn("outer", (F.col("block") / 4096).cast("long"))
    outer = blocks.groupBy("outer").agg(F.sum("n").alias("m")).selectExpr("outer", "sum(m) over (order by outer) - m as far")
    base = blocks.selectExpr("block", "outer", "sum(n) over (partition by outer order by block) - n as near").join(outer, "outer")
    first = inner.join(base, "block").selectExpr("catalog_pos", "inside + near + far as first")
    return chunks.join(first, "catalog_pos").withColumn("chunk_id", F.col("first") + F.col("chunk_pos")).drop("first")
