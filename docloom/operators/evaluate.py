"""Aggregated evaluation of retrieval, extraction, recognition and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metrics import ratio
from .lineage import cut, drop


def retrieval_metrics(ranks: DataFrame, max_total_items: int) -> DataFrame:
    """One row from (query_id, first), first the rank of the first relevant evidence or null; zeros without queries."""
    n = F.greatest(F.count("*"), F.lit(1))
    hits = F.count("first")
    return ranks.agg(F.count("*").alias("queries"), (hits / n).alias("hit_rate"), (hits / (n * max_total_items)).alias("precision_at_max_total_items"), F.round(F.coalesce(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)) / n, 9).alias("mean_reciprocal_rank"))


def values_at(rows: DataFrame, column: str, places: Callable[[int], list[int]]) -> list[float | None]:
    """The column's values at places of its sorted order, from 0, given by how many there are; nulls don't count.

    Values are sorted by ranges, which are written and counted, and only the range of a place is looked into; so no task
    holds all of them.
    """
    ranges = rows.select(column).where(F.col(column).isNotNull()).repartitionByRange(column).withColumn("part", F.spark_partition_id())
    ranges = cut(ranges)
    counts = {r.part: r.n for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()}
    out: list[float | None] = []
    for place in places(sum(counts.values())):
        found = None
        for part in sorted(counts):
            if 0 <= place < counts[part]:
                met = ranges.where(F.col("part") == part).groupBy(column).agg(F.count("*").alias("n"))  # equal values as one
                upto = met.withColumn("upto", F.sum("n").over(Window.orderBy(column)))
                found = upto.where(F.col("upto") > place).agg(F.min(column)).first()[0]
                break
            place -= counts[part]
        out.append(found)
    drop(ranges)
    return out


def latency_metrics(latencies: DataFrame) -> DataFrame:
    """Mean and 95th percentile of seconds, in milliseconds; the percentile's place is rounded half to even."""
    at = values_at(latencies, "seconds", lambda n: [round(0.95 * (n - 1)) if n else 0])[0]
    return latencies.agg(F.coalesce(F.avg("seconds") * 1000, F.lit(0.0)).alias("average"), F.lit(0.0 if at is None else at * 1000.0).alias("percentile_95"))


def spread(rows: DataFrame, column: str, upper: bool) -> DataFrame:
    """avg, median (the upper middle value, or the mean of the middle ones), min and max of a column; nulls for no rows."""
    rows = cut(rows.select(column))  # or the ranges' sample, the ranges and the other sums would each compute it again
    middle = values_at(rows, column, lambda n: [n // 2] if upper else [(n - 1) // 2, n // 2])
    median = None if middle[0] is None else sum(middle) / len(middle)
    return rows.agg(F.round(F.avg(column), 9).alias(f"avg_{column}"), F.lit(median).cast("double").alias(f"median_{column}"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def extraction_metrics(pairs: DataFrame) -> DataFrame:
    """present, empty, missing, processable_fraction of (expected_text, extracted_text, similarity)."""
    got = F.col("extracted_text")
    full = got.isNotNull() & (~T.blank(F.coalesce(got, F.lit(""))))
    return pairs.agg(
        F.count("*").alias("total"), F.count_if(full).alias("present"), F.count_if(got.isNotNull() & ~full).alias("empty"), F.count_if(got.isNull()).alias("missing"),
        ratio(F.count_if(full), F.count("*")).alias("processable_fraction"), F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 9).alias("mean_similarity"),
    )


def resolve_labels(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Labels (label_id, expected_item_id, expected_source_uri) with the item they mean: by id, else the first item
    in catalog order of that source; ``found`` is false where there is none."""
    by_id = items.select(F.col("item_id").alias("expected_item_id"), F.col("item_id").alias("a"))
    by_source = items.groupBy(F.col("source_uri").alias("expected_source_uri")).agg(F.min_by("item_id", "catalog_pos").alias("b"))
    both = labels.join(by_id, "expected_item_id", "left").join(by_source, "expected_source_uri", "left")
    return both.select("label_id", F.coalesce("a", "b").alias("item_id"), F.coalesce("a", "b").isNotNull().alias("found"))


def entity_f1(entities: DataFrame) -> DataFrame:
    """Per kind and over all (kind null) from (kind, expected, found): two values that differ are both an extra one
    and a missed one."""
    e, f = (T.normal_entity(F.col(c), F.col("kind")) for c in ("expected", "found"))
    hit = (e != "") & (e == f)
    rows = entities.select("kind", hit.alias("hit"), ((f != "") & ~hit).alias("extra"), ((e != "") & ~hit).alias("missed"))
    tp, fp, fn = (F.count_if(c) for c in ("hit", "extra", "missed"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.rollup("kind").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"))


def weighted_best(scores: DataFrame) -> DataFrame:
    """Weighted mean over categories of each one's best score, from (category, pipeline, score, weight), and who won."""
    best = scores.groupBy("category").agg(F.max("score").alias("score"), F.first("weight").alias("weight"))
    return best.agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 9).alias("overall"))


def best_by_metric(scores: DataFrame) -> DataFrame:
    """(category, pipeline, score): the best pipeline of each category, ties to the smaller name."""
    top = F.max(F.struct(F.col("score"), F.expr("-dense").alias("d"))).alias("top")
    ranked = scores.selectExpr("*", "dense_rank() over (partition by category order by pipeline) as dense")
    return ranked.join(ranked.groupBy("category").agg(top), "category").where("score = top.score and dense = -top.d").select("category", "pipeline", "score")
