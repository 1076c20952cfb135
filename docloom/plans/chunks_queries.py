"""Chunkers over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C
from .registry import query, spread, table


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("catalog_pos"), "text"))


def _report(chunks: DataFrame) -> DataFrame:
    return C.with_chunk_ids(chunks).select("item_id", "chunk_id", "span_start", "span_end", F.md5("text").alias("digest"))


def _windows_sql(size: int, overlap: int, blank: bool) -> str:
    stride = size - overlap
    return f"""
WITH s AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE ceil((length(text) - {size}) / {stride}.0)::BIGINT + 1 END)) * {stride} AS a FROM documents),
c AS (SELECT doc_id, a, least(a + {size}, length(text)) AS b, text[a + 1 : least(a + {size}, length(text))] AS t FROM s),
k AS (SELECT * FROM c {'' if blank else "WHERE regexp_matches(t, '[^ \\n]')"})
SELECT doc_id::VARCHAR AS item_id, (row_number() OVER (ORDER BY doc_id, a) - 1)::BIGINT AS chunk_id, a::INTEGER AS span_start, b::INTEGER AS span_end, md5(t) AS digest FROM k
"""


@query(_windows_sql(400, 100, False))
def chunk_char(spark: SparkSession, d: str) -> DataFrame:
    return _report(C.chunk_table(_items(spark, d), lambda t: C.char_windows(t, 400, 100)))


@query(_windows_sql(800, 200, True))
def chunk_fts(spark: SparkSession, d: str) -> DataFrame:
    return _report(C.chunk_table(_items(spark, d), lambda t: C.char_windows(t, 800, 200, keep_blank=True)))


#: Documents here have no blank lines, so single newlines are doubled first.
@query(r"""
WITH p AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10), chr(1) || chr(10)), chr(1)) AS ps FROM documents)),
s AS (SELECT doc_id, t, i, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1)::INTEGER AS a FROM p),
k AS (SELECT * FROM s WHERE regexp_matches(t, '[^ \n]'))
SELECT doc_id::VARCHAR AS item_id, (row_number() OVER (ORDER BY doc_id, i) - 1)::BIGINT AS chunk_id, a AS span_start, (a + length(t))::INTEGER AS span_end, md5(t) AS digest FROM k
""")
def chunk_para(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _report(C.chunk_table(items, C.paragraphs))


@query(r"""
WITH t AS (SELECT doc_id, text, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS ts FROM documents),
w AS (SELECT doc_id, text, ts, unnest(range(0, CASE WHEN len(ts) = 0 THEN 0 WHEN len(ts) <= 50 THEN 1 ELSE ceil((len(ts) - 50) / 40.0)::BIGINT + 1 END)) * 40 AS a FROM t)
SELECT doc_id::VARCHAR AS item_id, (row_number() OVER (ORDER BY doc_id, a) - 1)::BIGINT AS chunk_id, md5(array_to_string(ts[a + 1 : least(a + 50, len(ts))], ' ')) AS words FROM w
""")
def chunk_tok(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.with_chunk_ids(C.chunk_table(_items(spark, d), lambda t: C.token_windows(t, 50, 10)))
    return chunks.select("item_id", "chunk_id", F.md5(F.array_join(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""), " ")).alias("words"))


@query("WITH c AS (SELECT doc_id, greatest(1, ceil((length(text) - 400) / 300.0) + 1)::BIGINT AS n FROM documents WHERE length(text) > 0) SELECT doc_id::VARCHAR AS item_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS first FROM c")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.with_chunk_ids(C.chunk_table(_items(spark, d), lambda t: C.char_windows(t, 400, 100, keep_blank=True)))
    return chunks.groupBy("item_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


@query(r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)
SELECT doc_id, len([x for x in ps if trim(x) <> ''])::INTEGER AS n, md5(array_to_string([trim(x) for x in ps if trim(x) <> ''], '|')) AS digest FROM s
""")
def mk_seg_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))
