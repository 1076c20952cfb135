"""Retrieval over all documents: benchmark passages and short word lists as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import index as X
from ..operators import rank as K
from ..operators import retrieve as R
from ..operators.lineage import cut, drop, scratch
from .registry import query, spread, table

#: (query_id, query_text)
QUERIES = (("q0", "the and that"), ("q1", "idiot clown"), ("q2", "license apache"), ("q3", "der die und"), ("q4", "que les"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("catalog_pos"), F.col("source").alias("source_uri"), F.lit("text/plain").alias("media_type"), "text"))


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id string, query_text string")


_Q = "q(query_id, query_text) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUERIES) + ")"
_SCAN = f"""
{_Q}, t AS (SELECT query_id, unnest(string_split(lower(query_text), ' ')) AS w FROM q),
s AS (SELECT query_id, doc_id::VARCHAR AS item_id, source AS source_uri, text,
  sum((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w))::DOUBLE AS score FROM documents, t GROUP BY ALL HAVING score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s)"""


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """All hits with their ranks, for those who take the first few: Spark cuts each task's rows at their limit."""
    return K.rank_by_score(R.scan(items(spark, d), queries(spark)))


def scan_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, item_id, source_uri, empty, score, rank) of all hits: every query's in ranges over many tasks."""
    found = R.scan(items(spark, d), queries(spark)).select("query_id", "item_id", "source_uri", T.blank(F.col("text")).alias("empty"), "score")
    return K.rank_in_ranges(found, ["query_id"], F.col("score").desc(), "item_id").withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {_SCAN} SELECT query_id, item_id, score, rank FROM r")
def ret_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan_ranks(spark, d).select("query_id", "item_id", "score", "rank")


_TF = f"""
{_Q}, f AS (SELECT doc_id::VARCHAR AS item_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
g AS (SELECT query_id, w, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS w FROM q) GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM f GROUP BY ALL), m AS (SELECT query_id, sqrt(sum(qf * qf)) AS m FROM g GROUP BY ALL),
s AS (SELECT query_id, item_id, round(sum(tf * qf) / (n * m), 9) AS score FROM f JOIN g USING (w) JOIN n USING (item_id) JOIN m USING (query_id) GROUP BY query_id, item_id, n, m)"""


@query(f"WITH {_TF} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s WHERE score > 0")
def ret_tf(spark: SparkSession, d: str) -> DataFrame:
    found = R.tf_cosine(R.term_frequencies(items(spark, d)), queries(spark))
    return K.rank_in_ranges(found, ["query_id"], F.col("score").desc(), "item_id").withColumn("rank", F.col("rank").cast("int"))


_CHUNKS = """
c0 AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 800) / 600.0)::BIGINT + 1 END)) * 600 AS a FROM documents),
c AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id, a) - 1)::BIGINT AS chunk_id, text[a + 1 : least(a + 800, length(text))] AS t FROM c0)"""
_BM25 = rf"""
{_Q}, {_CHUNKS}, k AS (SELECT doc_id, chunk_id, regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+') AS ts FROM c),
z AS (SELECT count(*) AS total, avg(len(ts)) AS mean FROM k),
g AS (SELECT query_id, unnest(list_distinct(string_split(query_text, ' '))) AS w FROM q), h AS (SELECT query_id, count(*) AS needed FROM g GROUP BY ALL),
f AS (SELECT chunk_id, l, w, count(*) AS f FROM (SELECT chunk_id, len(ts) AS l, unnest(ts) AS w FROM k) WHERE w IN (SELECT w FROM g) GROUP BY ALL),
n AS (SELECT w, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM f JOIN n USING (w) JOIN g USING (w) JOIN h USING (query_id), z GROUP BY query_id, chunk_id, needed HAVING count(*) = needed)"""


def _fts_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.with_chunk_ids(C.chunk_table(items(spark, d), lambda t: C.char_windows(t, 800, 200, keep_blank=True)))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score FROM s")
def ret_fts(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_fts_chunks(spark, d), queries(spark))


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 20")
def ret_fts_stored(spark: SparkSession, d: str) -> DataFrame:
    """The best hits from a stored index that has every third item's chunks first and then all others."""
    chunks = cut(_fts_chunks(spark, d).select("chunk_id", "item_id", "text"))
    index = X.TextIndex(spark, scratch(spark))
    index.add(chunks.where("cast(item_id as long) % 3 = 0").select("chunk_id", "text"))
    index.add(chunks.select("chunk_id", "text"))
    drop(chunks)
    return K.rank_by_score(index.bm25(R.query_terms(queries(spark)), 20), "chunk_id")


@query(f"""WITH {_SCAN}, k AS (SELECT query_id, item_id, rank, (SELECT count(DISTINCT w) FROM t WHERE t.query_id = r.query_id AND contains(lower(r.text), w))::DOUBLE AS score, score AS first FROM r WHERE rank <= 25)
SELECT query_id, item_id, score, first, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM k""")
def rerank_terms(spark: SparkSession, d: str) -> DataFrame:
    top = K.rerank_by_terms(_scanned(spark, d), F.col("tokens"), 25)
    return top.select("query_id", "item_id", "score", F.col("stage_scores")["retrieve"].alias("first"), "rank")


@query(f"WITH {_SCAN}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_uri ORDER BY rank) AS nth FROM r WHERE rank > 2), p AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank FROM o WHERE nth <= 2) SELECT * FROM p WHERE rank <= 20")
def w_budget(spark: SparkSession, d: str) -> DataFrame:
    return K.apply_budget(_scanned(spark, d), K.QueryBudget(20, offset=2, max_items_per_source=2)).select("query_id", "item_id", "rank")


def budget_sql(most: int, chars: int, where: str = "") -> str:
    """CTEs up to ``kept`` (query_id, item_id, rank): in rank order what still fits, by one join for every item taken."""
    rounds = [f"k0 AS (SELECT query_id, 0 AS rank, 0 AS used FROM q {where})"]
    for i in range(1, most + 1):
        rounds.append(f"k{i} AS (SELECT c.query_id, min(c.rank) AS rank, any_value(k.used) + arg_min(c.n, c.rank) AS used FROM k{i - 1} k JOIN c ON c.query_id = k.query_id AND c.rank > k.rank AND k.used + c.n <= {chars} GROUP BY c.query_id)")
    taken = " UNION ALL ".join(f"SELECT query_id, rank AS old, {i}::INTEGER AS rank FROM k{i}" for i in range(1, most + 1))
    return f"{_SCAN}, c AS MATERIALIZED (SELECT query_id, item_id, rank, length(text) AS n FROM r), {', '.join(rounds)}, kept AS (SELECT c.query_id, c.item_id, t.rank FROM ({taken}) t JOIN c ON c.query_id = t.query_id AND c.rank = t.old)"


@query(f"WITH {budget_sql(10, 20000)} SELECT * FROM kept")
def w_budget_chars(spark: SparkSession, d: str) -> DataFrame:
    found = R.scan(items(spark, d), queries(spark)).select("query_id", "item_id", "source_uri", "score", F.length("text").alias("characters"))
    return K.fit_budget(found, K.QueryBudget(10, maximum_total_characters=20000)).select("query_id", "item_id", "rank")


@query(f"WITH {_SCAN} SELECT query_id, item_id, score FROM r WHERE score >= 5")
def f_minscore(spark: SparkSession, d: str) -> DataFrame:
    return K.minimum_score(_scanned(spark, d), 5.0).select("query_id", "item_id", "score")


@query(f"WITH {_SCAN} SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY length(trim(text)) DESC, item_id)::INTEGER AS position FROM r")
def s_longest(spark: SparkSession, d: str) -> DataFrame:
    found = R.scan(items(spark, d), queries(spark)).select("query_id", "item_id", "score", K.trimmed_length(F.col("text")).alias("trimmed"))
    ranked = K.rank_in_ranges(found, ["query_id"], F.col("score").desc(), "item_id").withColumn("rank", F.col("rank").cast("int"))
    return K.longest_first(ranked).select("query_id", "item_id", "rank", "position")


@query(f"WITH {_SCAN} SELECT query_id, item_id, source_uri, 'text/plain' AS media_type, rank, 'scan' AS stage, sha256(text) AS hash FROM r WHERE rank <= 10")
def p_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = R.retrieve(_scanned(spark, d).select("query_id", "item_id", "score"), items(spark, d), K.QueryBudget(10), "scan")
    return found.select("query_id", "item_id", "source_uri", "media_type", "rank", "stage", "hash")


_VEC = """
q AS (SELECT vec_id::VARCHAR AS query_id, [x / sqrt(list_sum([y * y for y in embedding::DOUBLE[]])) for x in embedding::DOUBLE[]] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_sum([a * b for a, b in zip(embedding, v)]), 6) AS score FROM embeddings, q)"""
_VEC = _VEC.replace("list_sum([a * b for a, b in zip(embedding, v)])", "list_dot_product(embedding::DOUBLE[], v)")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 50", "emb_mem")
def emb_mem(spark: SparkSession, d: str) -> DataFrame:
    limit = R.candidate_limit(K.QueryBudget(5), 10)
    return R.vector_candidates(table(spark, d, "embeddings").select("vec_id", "embedding"), _vector_queries(spark, d), limit)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "cos")
def cos(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")).join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return pairs.select("a", "b", F.round(R.cosine(F.col("x"), F.col("y")), 6).alias("score"))


_HASH = "[('0x' || substr(sha256('fixture:0:' || text), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE * 2 - 1 for i in range(16)]"


_WHOLE = "[2 * ('0x' || substr(sha256('fixture:0:' || text), 2 * i + 1, 2))::INTEGER - 255 for i in range(16)]"


@query(f"WITH r AS (SELECT doc_id, {_WHOLE} AS v FROM documents), s AS (SELECT doc_id, v, sqrt(list_sum([y * y for y in v])) AS n FROM r) SELECT doc_id, [round(x * 1e6 / n) / 1e6 for x in v] AS vector FROM s")
def emb_hash(spark: SparkSession, d: str) -> DataFrame:
    v = R.hash_embedding(F.col("text"), 16)
    return table(spark, d, "documents").select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("vector"))


_QV = _HASH.replace("text", "query_text")


@query(f"""WITH {_BM25}, v0 AS (SELECT doc_id, chunk_id, {_HASH.replace('|| text', '|| t')} AS v FROM c), w0 AS (SELECT query_id, {_QV} AS w FROM q),
e AS (SELECT query_id, doc_id, chunk_id, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)), 6) AS score FROM v0, w0),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM e),
lr AS (SELECT s.*, k.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.chunk_id) AS rank FROM s JOIN k USING (chunk_id)),
x AS (SELECT query_id, doc_id, arg_max(score, rank) AS lex FROM lr WHERE rank <= 25 GROUP BY ALL), y AS (SELECT query_id, doc_id, arg_max(score, rank) AS vec FROM er WHERE rank <= 25 GROUP BY ALL),
u AS (SELECT query_id, doc_id::VARCHAR AS item_id, round(0.6 * coalesce(lex, 0) + 0.4 * coalesce(vec, 0), 6) AS score FROM x FULL JOIN y USING (query_id, doc_id))
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM u""")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    chunks, q, limit = _fts_chunks(spark, d), queries(spark), R.candidate_limit(K.QueryBudget(5), 5)
    terms = R.query_terms(q)
    index = R.chunk_index(chunks.withColumn("embedding", R.hash_embedding(F.col("text"), 16)), terms, "item_id", "embedding")
    lexical = K.rank_by_score(R.bm25_scores(index, terms), "chunk_id").where(F.col("rank") <= limit).join(index.select("chunk_id", "item_id"), "chunk_id")
    vectors = index.select(F.col("chunk_id").alias("vec_id"), "embedding")
    near = R.vector_candidates(vectors, q.select("query_id", R.hash_embedding(F.col("query_text"), 16).alias("vector")), limit)
    near = near.withColumnRenamed("vec_id", "chunk_id").join(index.select("chunk_id", "item_id"), "chunk_id")
    return R.fuse(lexical, near, 0.6, 0.4).drop("stage_scores")


@query("SELECT doc_id, sha256(text) AS text_hash, sha256('scan:' || '{\"source\":\"' || source || '\"}') AS configuration_id FROM documents", "hash_ids")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    config = F.concat(F.lit('scan:{"source":"'), F.col("source"), F.lit('"}'))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.sha2(config, 256).alias("configuration_id"))
