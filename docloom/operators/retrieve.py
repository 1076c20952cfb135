"""Retrievers: substring scan, term-frequency cosine, BM25 over chunks, vectors, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .rank import QueryBudget, apply_budget, rank_by_score


#: Queries that meet all rows at a time.
QUERY_BLOCK = 1024
#: Pairs of a query and a vector whose scores a task holds at once, and rows that it gives out at once.
SCORES, OUT_ROWS = 1 << 20, 1 << 16


def scan(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of (item_id, text) for each query (query_id, query_text): how often its tokens stand in the text.

    Queries are a stated set; each block of them, of bounded size, is written into the plan, so that items are
    neither shuffled nor joined.
    """
    blocks, parts = max(1, -(-queries.count() // QUERY_BLOCK)), []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", T.scan_tokens(F.col("query_text")).alias("tokens")).collect()
        table = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens")) for r in own])
        asked = items.select("*", F.inline(table)) if own else items.select("*", F.lit("").alias("query_id"), F.array().cast("array<string>").alias("tokens")).limit(0)
        score = T.let(F.lower("text"), lambda low: F.aggregate("tokens", F.lit(0), lambda a, t: a + T.substring_count(low, t))).cast("double")
        parts.append(asked.withColumn("score", score).where("score > 0"))
    return reduce(DataFrame.unionByName, parts)


def term_frequencies(items: DataFrame, key: str = "item_id", tokens: Column | None = None) -> DataFrame:
    """(key, term, tf): the table that term retrievers share; worth writing once for many queries."""
    tokens = T.term_tokens(F.col("text")) if tokens is None else tokens
    return items.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_cosine(tf: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score): cosine of raw term counts, no idf; only scores above 0, rounded to 9 places.

    Queries are a stated set: their terms are written into the plan, so an item's length and the few counts that meet a
    query come from one pass over ``tf``.
    """
    q = queries.select("query_id", F.explode(T.term_tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qf") * F.col("qf"))).alias("qnorm"))
    wanted = [r.term for r in q.select("term").distinct().collect()]
    hit = F.when(F.col("term").isin(*wanted) if wanted else F.lit(False), F.struct("term", "tf"))
    met = tf.groupBy("item_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("inorm"), F.collect_list(hit).alias("hits")).where(F.size("hits") > 0)
    dots = met.select("item_id", "inorm", F.inline("hits")).join(q, "term").groupBy("query_id", "item_id", "inorm").agg(F.sum(F.col("tf") * F.col("qf")).alias("dot"))
    return dots.join(norm, "query_id").select("query_id", "item_id", F.round(F.col("dot") / (F.col("inorm") * F.col("qnorm")), 9).alias("score")).where("score > 0")


def query_terms(queries: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, terms): different terms of each query, runs of letters and digits with case and accents folded."""
    spelt = T.query_tokens(F.col("query_text"))
    spelt = T.without_stop_words(spelt, stop_words) if stop_words else spelt
    return queries.select("query_id", F.array_distinct(F.flatten(F.transform(spelt, T.folded_tokens))).alias("terms"))


def chunk_index(chunks: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, ``keep``, len, hits) of chunks (chunk_id, text): how many words a chunk has, and those that some query
    (query_id, terms) asks for; written once for all that reads it.

    Queries are a stated set: their different terms are written into the plan, so other words are never exploded.
    """
    wanted = [r[0] for r in terms.select(F.explode("terms")).distinct().collect()]
    tokens = T.folded_tokens(F.col("text"))
    hits = F.filter("tokens", lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")
    return cut(chunks.select("chunk_id", *keep, tokens.alias("tokens")).select("chunk_id", *keep, F.size("tokens").alias("len"), hits.alias("hits")))


def bm25_scores(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of a ``chunk_index``: see ``bm25``."""
    q = terms.select("query_id", F.size("terms").alias("needed"), F.explode("terms").alias("term"))
    whole = index.agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    tf = index.select("chunk_id", "len", F.explode("hits").alias("term")).groupBy("chunk_id", "len", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    met = tf.join(df, "term").crossJoin(F.broadcast(whole)).join(q, "term")  # whole is one row
    scored = met.groupBy("query_id", "chunk_id", "needed").agg(F.count("*").alias("held"), F.sum(part).alias("score")).where("held = needed")
    return scored.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def bm25(chunks: DataFrame, queries: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, score) of chunks (chunk_id, text) that hold every query term; k1 1.2, b 0.75.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Chunk lengths, document frequencies and matches all come from
    one index of the chunks, made in one pass over their texts.
    """
    terms = query_terms(queries, stop_words)
    return bm25_scores(chunk_index(chunks, terms), terms)


def candidate_limit(budget: QueryBudget, factor: int) -> int:
    """How many candidates a retriever ranks before the budget is applied."""
    return factor * (budget.max_total_items + budget.offset)


def unit(vector: Column) -> Column:
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return T.let(vector, lambda v: T.let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_candidates(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``limit`` best dot products with each unit query vector, negatives too,
    ties by vec_id. Vectors (vec_id long, embedding); null ones take no part.

    Queries (query_id, vector) are a stated set; each block of them, of bounded size, is sent to all vectors. A batch of
    vectors meets it as a matrix, and only its best rows for each query go on to be ranked.
    """
    asked = queries.select("query_id", unit(F.col("vector").cast("array<double>")).alias("vector")).where("vector is not null")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("embedding is not null")
    kind, tops = dict(asked.dtypes)["query_id"], []
    for b in range(blocks):
        own = sorted((r.query_id, r.vector) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect())
        names, matrix = [x for x, _ in own], np.array([v for _, v in own], float)
        tops.append(rows.mapInPandas(partial(_best_of_batch, names=names, matrix=matrix, limit=limit), f"query_id {kind}, vec_id long, score double"))
    return rank_by_score(reduce(DataFrame.unionByName, tops), "vec_id").where(F.col("rank") <= limit)


def _best_of_batch(frames: Iterator[pd.DataFrame], names: list, matrix: np.ndarray, limit: int) -> Iterator[pd.DataFrame]:
    """Each query's ``limit`` best of a task's rows; a task keeps these and the scores of ``SCORES`` pairs."""
    query, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows = max(1, SCORES // max(1, len(names)))
    for pdf in frames if len(names) else ():
        for at in range(0, len(pdf), rows):
            part = pdf.iloc[at : at + rows]
            own = np.round(np.stack(part.embedding.to_numpy()) @ matrix.T, 6)
            if limit < len(own):  # what ties with a query's last one too
                row, col = np.nonzero(own >= np.partition(own, len(own) - limit, axis=0)[len(own) - limit])
            else:
                row, col = np.divmod(np.arange(own.size), len(names))
            query, ids, scores = np.concatenate([query, col]), np.concatenate([ids, part.vec_id.to_numpy()[row]]), np.concatenate([scores, own[row, col]])
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < limit
            query, ids, scores = query[best], ids[best], scores[best]
    for at in range(0, len(query), OUT_ROWS):
        span = slice(at, at + OUT_ROWS)
        yield pd.DataFrame({"query_id": np.array(names, object)[query[span]], "vec_id": ids[span], "score": scores[span]})


def hash_embedding(text: Column, dimensions: int, seed: str = "fixture") -> Column:
    """Unit vector of bytes of sha256("seed:counter:text"), each byte b as 2 b / 255 - 1.

    Whole numbers 2 b - 255 have the same direction and an exact norm, so a component is rounded once.
    """
    blocks = -(-dimensions // 32)
    digest = F.concat(*[F.sha2(F.concat(F.lit(f"{seed}:{i}:"), text), 256) for i in range(blocks)])
    raw = T.let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(d, i * 2 + 1, 2), 16, 10).cast("double") * 2 - 255))
    return unit(raw)


def fuse(lexical: DataFrame, vectors: DataFrame, lexical_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """(query_id, item_id, score, stage_scores) of two ranked lists (query_id, item_id, rank, score).

    Raw scores are weighted and added, a missing side is 0. Of an item's chunks each side gives the last in rank.
    """
    if abs(lexical_weight + vector_weight - 1) > 1e-6:
        raise ValueError("weights must sum to 1")

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id", "item_id").agg(F.max_by("score", "rank").alias(name))

    both = last(lexical, "lex").join(last(vectors, "vec"), ["query_id", "item_id"], "full").fillna(0.0, ["lex", "vec"])
    score = F.round(lexical_weight * F.col("lex") + vector_weight * F.col("vec"), 6)
    return rank_by_score(both.select("query_id", "item_id", score.alias("score"), F.create_map(F.lit("lexical"), "lex", F.lit("embedding"), "vec").alias("stage_scores")))


def retrieve(candidates: DataFrame, items: DataFrame, budget: QueryBudget, stage: str) -> DataFrame:
    """Evidence of scored candidates (query_id, item_id, score): ranked, joined with its item, held to the budget."""
    top = rank_by_score(candidates)
    if budget.max_items_per_source is None and budget.maximum_total_characters is None:
        top = top.where(F.col("rank") <= budget.offset + budget.max_total_items)
    full = top.join(items.select("item_id", "source_uri", "media_type", "text"), "item_id")
    return apply_budget(full, budget).withColumn("stage", F.lit(stage)).withColumn("hash", F.sha2("text", 256))


def materialised(df: DataFrame, path: str) -> DataFrame:
    """Write an index (terms, chunks, vectors) and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def first_relevant(evidence: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first): smallest rank of evidence that matches the expected item or source; null without one.

    Two equi-joins united stand for the disjunction, so neither side is compared row by row.
    """
    item = evidence.join(expected.where("expected_item_id is not null"), "query_id").where("item_id = expected_item_id")
    source = evidence.join(expected.where("expected_source_uri is not null"), "query_id").where("source_uri = expected_source_uri")
    hits = item.select("query_id", "rank").union(source.select("query_id", "rank")).groupBy("query_id").agg(F.min("rank").alias("first"))
    return expected.select("query_id").join(hits, "query_id", "left")


