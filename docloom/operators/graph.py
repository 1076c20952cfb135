"""Graphs of text: word co-occurrence, simple entities, and keyed upserts of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cooccurrences(items: DataFrame, window: int = 4, least: int = 1) -> DataFrame:
    """(item_id, a, b, n): how many windows of ``window`` words hold both a < b, one window from every word on, each
    pair once in a window.

    Texts are dealt by item_id, and what counts their pairs stays in that deal, so no pair is shuffled. A window is a row
    of ``window`` columns, null behind the last word and where a word stands in it before; its pairs are at most
    window^2 / 2.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    placed = items.select("item_id", "text").repartition(n, "item_id").select("item_id", words.alias("w")).where("size(w) > 1").select("item_id", "w", F.explode(F.expr("sequence(0, size(w) - 2)")).alias("i"))
    own = placed.select("item_id", *[F.get("w", F.col("i") + k).alias(f"w{k}") for k in range(window)])
    once = own.select("item_id", *[F.when(F.coalesce(reduce(Column.__or__, [F.col(f"w{k}") == F.col(f"w{j}") for j in range(k)], F.lit(False)), F.lit(False)), None).otherwise(F.col(f"w{k}")).alias(f"u{k}") for k in range(window)])
    both = [F.struct(F.col(f"u{j}").alias("x"), F.col(f"u{k}").alias("y")) for k in range(window) for j in range(k)]
    pairs = once.select("item_id", F.explode(F.array(*both)).alias("p")).where("p.x is not null and p.y is not null")
    return pairs.groupBy("item_id", F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def canonical(label: Column) -> Column:
    low = F.lower(label)
    name = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", low).otherwise(name)


def sentence_entities(text: Column, most_words: int = 4, least: int = 3) -> Column:
    """Entities of each sentence: runs of capitalised words, and acronyms; each once in a sentence."""
    word = "[A-Z][a-z]+"
    phrase = rf"(?U)\b{word}(?:\s+{word}){{0,{most_words - 1}}}\b"
    pieces = F.split(text, "[.!?]+")
    return F.transform(pieces, lambda s: F.array_distinct(F.filter(F.concat(F.regexp_extract_all(s, F.lit(phrase), 0), F.regexp_extract_all(s, F.lit(r"(?U)\b[A-Z]{2,}\b"), 0)), lambda e: F.length(e) >= least)))


def mentions(items: DataFrame) -> DataFrame:
    """(item_id, entity, label, n): in how many sentences each label stands."""
    found = items.select("item_id", F.explode(F.flatten(sentence_entities(F.col("text")))).alias("label"))
    return found.groupBy("item_id", "label").agg(F.count("*").alias("n")).withColumn("entity", canonical(F.col("label")))


def relations(items: DataFrame) -> DataFrame:
    """(item_id, a, b, n): in how many sentences two entities a < b stand together. A sentence's pairs are made in
    place; its entities are few."""
    per = items.select("item_id", F.explode(sentence_entities(F.col("text"))).alias("es")).select("item_id", F.array_sort(F.array_distinct(F.transform("es", canonical))).alias("u"))
    pairs = F.expr("flatten(transform(u, (x, i) -> transform(slice(u, i + 2, size(u)), y -> struct(x as a, y as b))))")
    return per.select("item_id", F.explode(pairs).alias("p")).groupBy("item_id", "p.a", "p.b").agg(F.count("*").alias("n"))


def build(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of items (item_id, text), each item's graph on its own.

    nodes: (item_id, node_id, node_type, label, weight), entities with the first of their labels and the sentences they
    stand in, and the item itself; edges: (item_id, edge_id, src, dst, edge_type, weight), mentions by the item and
    relations of entities in a sentence. summary: one row of items, skipped (null or blank text), nodes and edges.
    An item without entities is a node alone. Rows that repeat an item_id make one graph.
    """
    full = items.where(~T.blank(F.col("text")))
    met = mentions(full).groupBy("item_id", "entity").agg(F.min("label").alias("label"), F.sum("n").alias("weight"))
    own = F.concat(F.lit("item:"), F.col("item_id").cast("string"))
    entity = lambda c: F.concat(F.lit("entity:"), F.col(c))
    nodes = met.select("item_id", entity("entity").alias("node_id"), F.lit("entity").alias("node_type"), "label", "weight")
    nodes = nodes.unionByName(full.select("item_id").distinct().select("item_id", own.alias("node_id"), F.lit("item").alias("node_type"), F.col("item_id").cast("string").alias("label"), F.lit(1).cast("long").alias("weight")))
    key = lambda kind: F.concat_ws("|", "src", F.lit(kind), "dst")
    said = met.select("item_id", own.alias("src"), entity("entity").alias("dst"), F.lit("mentions").alias("edge_type"), "weight").withColumn("edge_id", key("mentions"))
    tied = relations(full).select("item_id", entity("a").alias("src"), entity("b").alias("dst"), F.lit("related_to").alias("edge_type"), F.col("n").alias("weight")).withColumn("edge_id", key("related_to"))
    edges = said.unionByName(tied)
    blank = F.coalesce(T.blank(F.col("text")), F.lit(True))
    summary = items.agg(F.count("*").alias("items"), F.count_if(blank).alias("skipped")).crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # single rows
    return nodes, edges, summary


def of_language(items: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of items (item_id, read), ``read`` holding what a language model found: entities (text, kind) and
    relations (subject, verb, object); see ``sources.providers.analysed``.

    nodes: (item_id, node_id, node_type, label, entity_type), one for each label of ``least`` characters at least,
    stripped, with the kind of its last place, and one for the item. edges: (item_id, edge_id, src, dst, edge_type,
    predicate, weight): mentions of a label, weighing as many as its places, and related_to of subject and object, one of
    each (subject, object, verb); ends shorter than ``least`` are left out. Labels that differ in case or marks share
    their node_id; ``upsert`` keeps one of them. Null or empty ``read`` gives the item's node alone.
    """
    own = F.concat(F.lit("item:"), F.col("item_id").cast("string"))
    entity = lambda c: F.concat(F.lit("entity:"), canonical(c))
    placed = items.select("item_id", F.posexplode("read.entities").alias("i", "e")).select("item_id", "i", T.strip(F.col("e.text")).alias("label"), F.col("e.kind").alias("kind"))
    met = placed.where(F.length("label") >= least).groupBy("item_id", "label").agg(F.max_by("kind", "i").alias("entity_type"), F.count("*").cast("double").alias("weight"))
    none = F.lit(None).cast("string")
    nodes = met.select("item_id", entity(F.col("label")).alias("node_id"), F.lit("entity").alias("node_type"), "label", "entity_type")
    nodes = nodes.unionByName(items.select("item_id", own.alias("node_id"), F.lit("item").alias("node_type"), F.col("item_id").cast("string").alias("label"), none.alias("entity_type")).distinct())
    said = met.select("item_id", own.alias("src"), entity(F.col("label")).alias("dst"), F.lit("mentions").alias("edge_type"), none.alias("predicate"), "weight")
    said = said.withColumn("edge_id", F.concat_ws("|", "src", "edge_type", "dst"))
    told = items.select("item_id", F.explode("read.relations").alias("r")).select("item_id", T.strip(F.col("r.subject")).alias("s"), T.strip(F.col("r.object")).alias("o"), F.col("r.verb").alias("v")).where((F.length("s") >= least) & (F.length("o") >= least))
    tied = told.select("item_id", entity(F.col("s")).alias("src"), entity(F.col("o")).alias("dst"), F.lit("related_to").alias("edge_type"), canonical(F.col("v")).alias("predicate"), F.lit(1.0).alias("weight"))
    tied = tied.withColumn("edge_id", F.concat_ws("|", "src", "edge_type", "dst", "predicate")).distinct()
    return nodes, said.unionByName(tied)


def upsert(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each node_id and edge_id, the last by ``version``; edges only where both ends are nodes."""
    last = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct(*df.columns), "version").alias("r")).select("r.*")
    kept = last(nodes, "node_id")
    ids = kept.select("node_id")
    ends = last(edges, "edge_id").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, ends
