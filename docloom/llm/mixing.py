"""Mixing sources to target weights: nested budget thresholds from histograms of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import rank_in_ranges
from .common import cut, drop

#: Bits of a document's hash, and of them those that a histogram tells apart in each round.
HASH_BITS, ROUND_BITS = 60, 10
#: Up to so many sources their targets are sent to all tasks; more of them are joined.
FEW_SOURCES = 10_000
SALTS = 32


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """``HASH_BITS`` bits of the md5 of doc_id, or of the text where there is none."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source_key, source_size, target) of sources (source_key, source_size): shares of ``percent`` of all sizes.

    Sources take the weights in turn, in order of their keys. A target stops at ``most`` times its source's size, and the
    excess is shared anew by weight until no target is above. Every round sums, over all sources, sizes and weights of
    those that stop; only these sums and no source reach the driver. Sums are whole numbers, so a target is rounded once.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    table = cut(rank_in_ranges(sources, [], "source_key").select("source_key", "source_size", turn.alias("weight")))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = total or 0, weight or 0
    wide = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")
    share, per, stopped = percent * total, 100 * weight, -1
    while per:
        above = wide(F.col("weight")) * wide(share) > wide(F.col("source_size") * most) * wide(per)
        size, own, count = table.where(above).agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
        if count == stopped:
            break
        share, per, stopped = percent * total - 100 * most * (size or 0), 100 * (weight - (own or 0)), count
    full = (F.col("source_size") * most).cast("double")
    if not per:  # all of them stop
        return table.select("source_key", "source_size", full.alias("target"))
    own = (wide(F.col("weight")) * wide(share)).cast("double") / F.lit(float(per))
    return table.select("source_key", "source_size", F.when(above, full).otherwise(own).alias("target"))


def budget_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_key, level, below): rows whose hash is less than ``below`` have a size, summed up, next to the budget.

    rows (source_key, hash, size) and budgets (source_key, level, budget), several to a source if wished: thresholds of
    larger budgets are never smaller, so what they take is nested. Sizes are summed by source and the hash's first bits;
    the bucket in which a budget ends is the only one whose rows are looked at again, by their next bits, until it holds
    a single hash. Rows of that hash are taken if this comes nearer to the budget than to leave them. Nothing is sorted.
    A budget that no bucket exceeds takes all rows.
    """
    everything = F.lit(1 << HASH_BITS)
    part, found, old = rows, None, None
    ends = budgets.select("source_key", "level", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for used in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        bucket = F.shiftright("hash", HASH_BITS - used)
        held = part.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("size").alias("held"), F.min("hash").alias("least"), F.max("hash").alias("largest"))
        held = held.withColumn("prefix", F.shiftright("bucket", ROUND_BITS))
        to_here = Window.partitionBy("source_key", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row for each of 1,024 buckets
        held = held.withColumn("after", F.sum("held").over(to_here))
        last = held.join(ends, ["source_key", "prefix"]).withColumn("after", F.col("before") + F.col("after")).withColumn("before", F.col("after") - F.col("held"))
        last = cut(last.where("before <= budget and budget < after").select("source_key", "level", "budget", "before", "after", F.col("bucket").alias("prefix"), "least", "largest"))
        nearer = F.when(F.col("after") - F.col("budget") < F.col("budget") - F.col("before"), F.col("least") + 1).otherwise(F.col("least"))
        one = last.where("least = largest").select("source_key", "level", nearer.alias("below"))
        found = one if found is None else found.unionByName(one)
        ends = last.where("least < largest").select("source_key", "level", "budget", "before", "prefix")
        if ends.isEmpty():
            break
        wanted = ends.select("source_key", F.col("prefix").alias("bucket")).distinct()
        part = cut(part.withColumn("bucket", bucket).join(wanted, ["source_key", "bucket"]).select("source_key", "hash", "size"))
        if old is not None:
            drop(old)
        old = part
    return budgets.join(found, ["source_key", "level"], "left").select("source_key", "level", F.coalesce("below", everything).alias("below"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document.

    A document's size is its number of words (null text: 0). Sources, by code point and null last, get targets from
    ``source_targets``. A target of more than its source's size takes every document, and then again those whose hash is
    below the threshold of what is left, up to ``most`` times; one of less takes those below its threshold. Documents
    are taken whole, so a source's taken words differ from its target by half of its largest document at most (where a
    doc_id is repeated: of the rows that have it, which are taken or left together). The hash is of doc_id alone, so
    reruns agree, and smaller targets take part of what larger ones take. Rows without doc_id are hashed by their text;
    all rows come back; an empty table gives none. Other columns of the caller's are left out.

    Texts are read once. Sources may be few and one of them may hold most rows: sums are made before each shuffle, and
    targets go to all tasks while there are at most ``FEW_SOURCES``; beyond, they are joined with salted keys.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))  # null comes last
    rows = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("source_key"), word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash")))
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, percent, most))
    levels = F.posexplode(F.sequence(F.lit(0), F.lit(most - 1))).alias("level", "_")
    budgets = targets.select("source_key", "source_size", "target", levels).selectExpr("source_key", "level", "target - level * source_size as budget").where("budget > 0")
    below = budget_thresholds(rows.select("source_key", "hash", "size"), budgets).groupBy("source_key").agg(F.collect_list("below").alias("below"))
    plan = cut(targets.join(below, "source_key", "left").select("source_key", "source_size", "target", F.coalesce("below", F.array().cast("array<bigint>")).alias("below")))
    if plan.count() <= FEW_SOURCES:
        both = rows.join(F.broadcast(plan), "source_key")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", (F.col("hash") % SALTS).cast("int")).join(salted, ["source_key", "salt"])
    copies = F.size(F.filter("below", lambda b: F.col("hash") < b))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
