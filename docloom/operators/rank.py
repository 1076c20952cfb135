"""Ranking, budgets, reranking and filters over evidence (query_id, item_id, source_uri, score, text, ...)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fold import fold_groups
from .lineage import cut, drop


@dataclass(frozen=True)
class QueryBudget:
    """How much evidence a query may return."""

    max_total_items: int
    offset: int = 0
    maximum_total_characters: int | None = None
    max_items_per_source: int | None = None

    def __post_init__(self) -> None:
        if self.max_total_items < 1 or self.offset < 0:
            raise ValueError("max_total_items must be at least 1 and offset at least 0")


def rank_by_score(df: DataFrame, *tie: str | Column) -> DataFrame:
    """rank 1, 2, ... in each query by falling score, ties by the columns given (item_id)."""
    order = [F.col("score").desc(), *(tie or ("item_id",))]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rank_in_ranges(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """rank 1, 2, ... in each group of ``keys`` (none: of all rows) by ``order``, which should leave no ties.

    Rows are written, dealt by ranges of (keys, order) and written again; so neither a large group nor a table without
    groups lies in one task. A row's rank is its place in its range and how many rows of its group the ranges before hold:
    a sum over one number for each (range, group). Null keys are a group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    rows = cut(df)  # or the ranges' sample would compute it once more
    dealt = cut(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    drop(rows)
    piece = F.shiftright("_at", 33)  # monotonically_increasing_id() has the partition above its lower 33 bits
    held = dealt.groupBy(piece.alias("_piece"), *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_piece", *[F.col(k).alias(f"_{k}") for k in keys], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], piece == F.col("_piece"))
    return dealt.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"))


def apply_budget(ranked: DataFrame, budget: QueryBudget) -> DataFrame:
    """Evidence that fits the budget, ranks renumbered.

    In rank order: the first ``offset`` are skipped, then what would exceed a source's share or the characters left
    is skipped too (not stopped at), until ``max_total_items`` are kept. Without a character limit two row numbers
    decide it; with one, see ``fit_budget``, which needs no ranks.
    A column ``characters`` stands for the text's length, so that ranks can be given without moving the texts.
    """
    source = F.coalesce("source_uri", "item_id")
    by_query = Window.partitionBy("query_id").orderBy("rank")
    df = ranked.where(F.col("rank") > budget.offset)
    if budget.maximum_total_characters is None:
        if budget.max_items_per_source is not None:
            own = Window.partitionBy("query_id", source).orderBy("rank")
            df = df.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= budget.max_items_per_source).drop("nth")
        return df.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= budget.max_total_items)
    n = F.col("characters") if "characters" in df.columns else F.length(F.coalesce("text", F.lit("")))
    rows = df.select("query_id", "rank", source.alias("source"), n.cast("long").alias("characters"))
    kept = _fitting(_useful(rows.withColumn("at", F.struct("rank")), budget.max_total_items, budget.max_items_per_source, 0), replace(budget, offset=0))
    return df.withColumnRenamed("rank", "old").join(kept.select("query_id", F.col("at.rank").alias("old"), "rank"), ["query_id", "old"]).drop("old")


def fit_budget(scored: DataFrame, budget: QueryBudget) -> DataFrame:
    """(query_id, item_id, score, rank) of what ``apply_budget`` keeps of scored candidates (query_id, item_id, source_uri,
    score, characters), without ranking them all: ties go by item_id, null characters count as none.

    An item can only be taken if all earlier ones that are no longer were taken, or had no place for their source; so it
    is of no use once as many sources as items are wanted have an earlier and no longer one, or its own source has as
    many as it may give. Tasks leave such rows out of what they read, and again out of what is left of each query: a few
    rows for every power of e, unless ranks and lengths fall together. The rest is walked in order.
    """
    source = F.coalesce("source_uri", "item_id")
    rows = scored.select("query_id", F.struct((-F.col("score")).alias("less"), "item_id").alias("at"), source.alias("source"), F.coalesce("characters", F.lit(0)).cast("long").alias("characters"))
    kept = _fitting(_useful(rows, budget.max_total_items, budget.max_items_per_source, budget.offset), budget)
    return kept.select("query_id", "at.item_id", (-F.col("at.less")).alias("score"), "rank")


def _useful(rows: DataFrame, most: int, share: int | None, offset: int) -> DataFrame:
    """Rows (query_id, at, source, characters) that a budget may take, or skip as its offset; ``at`` is their order."""
    shape = rows.select("query_id", "at", "source", "characters")

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.assign(order=[tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in pdf["at"]]).sort_values(["query_id", "order"], kind="stable")
            keep = np.concatenate([[True] * 0, *[useful_rows(own.characters.to_numpy(), own.source.to_numpy(), most, share, offset) for _, own in pdf.groupby("query_id", sort=False, dropna=False)]]).astype(bool)
            yield pdf[keep].drop(columns="order")

    local = shape.mapInPandas(prune, shape.schema)
    return local.repartition("query_id").sortWithinPartitions("query_id", "at").mapInPandas(prune, shape.schema)


def useful_rows(characters: np.ndarray, sources: np.ndarray, most: int, share: int | None, offset: int) -> np.ndarray:
    """Of one query's rows in order: which may be taken. ``shortest`` holds the lengths of each source's shortest row so far,
    as far as they are among the ``most`` + ``offset`` least."""
    limit, own_limit = most + offset, None if share is None else share + offset
    keep, shortest, of_source = np.zeros(len(characters), bool), [], {}
    for i, (n, source) in enumerate(zip(characters, sources, strict=True)):
        mine = of_source.setdefault(source, []) if share is not None else None
        if i < offset or bisect_right(shortest, n) < limit and (mine is None or bisect_right(mine, n) < own_limit):
            keep[i] = True
        if mine is None:
            insort(shortest, n)
        else:
            if not mine or n < mine[0]:
                if mine and (at := bisect_left(shortest, mine[0])) < len(shortest) and shortest[at] == mine[0]:
                    shortest.pop(at)
                insort(shortest, n)
            insort(mine, n)
            del mine[own_limit:]
        del shortest[limit + 1 :]
    return keep


def _fitting(rows: DataFrame, budget: QueryBudget) -> DataFrame:
    """(query_id, at, rank) of the rows that are taken, each query walked in order of ``at``."""
    most, share, offset = budget.maximum_total_characters, budget.max_items_per_source, budget.offset

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        met, taken, used, sources = state
        n, source = row["characters"] or 0, row["source"]
        if met < offset or taken == budget.max_total_items or most is not None and used + n > most or share is not None and sources.get(source, 0) >= share:
            return (met + 1, taken, used, sources), []
        return (met + 1, taken + 1, used + n, sources | {source: sources.get(source, 0) + 1}), [{"query_id": row["query_id"], "at": row["at"], "rank": taken + 1}]

    kinds = dict(rows.dtypes)
    return fold_groups(rows, "query_id", ["at"], lambda: (0, 0, 0, {}), step, lambda *_: [], f"query_id {kinds['query_id']}, at {kinds['at']}, rank int")


def minimum_score(df: DataFrame, least: float) -> DataFrame:
    if least < 0:
        raise ValueError("the minimum score must not be negative")
    return df.where(F.col("score") >= least)


def longest_first(df: DataFrame) -> DataFrame:
    """position 1, 2, ... by falling length of the trimmed text, then item_id; rank stays as it was.

    A column ``trimmed`` stands for that length, so that positions can be given without moving the texts. Positions come
    from ranges over many tasks.
    """
    known = "trimmed" in df.columns
    rows = df if known else df.withColumn("trimmed", trimmed_length(F.col("text")))
    rows = rows.withColumnRenamed("rank", "_rank") if "rank" in df.columns else rows
    placed = rank_in_ranges(rows, ["query_id"], F.col("trimmed").desc(), "item_id").withColumn("position", F.col("rank").cast("int"))
    return placed.select(*[F.col("_rank").alias("rank") if c == "rank" else c for c in df.columns], "position")


def trimmed_length(text: Column) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit(""))))


def rerank_by_terms(ranked: DataFrame, tokens: Column, top_k: int) -> DataFrame:
    """The first ``top_k`` scored anew by how many distinct query tokens they contain; the rest goes. stage_scores
    keeps both scores."""
    low = F.lower("text")
    hits = F.size(F.filter(F.array_distinct(tokens), lambda t: F.contains(low, F.lower(t)))).cast("double")
    df = ranked.where(F.col("rank") <= top_k).withColumn("stage_scores", F.create_map(F.lit("retrieve"), F.col("score").cast("double"), F.lit("rerank"), hits)).withColumn("score", hits)
    return rank_by_score(df.drop("rank"))
