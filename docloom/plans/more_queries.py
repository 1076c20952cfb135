"""Joins, windows and projections that stages are made of, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank as K
from ..operators import retrieve as R
from . import retrieval_queries as RQ
from .registry import query, table

_EX = "e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE upper(lang) END AS extracted FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id))"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """Extracted texts, which the labelled documents have."""
    labelled = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").join(labelled, "doc_id", "left_semi").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.upper("lang")).alias("extracted"))


@query(f"WITH {_EX} SELECT d.doc_id, e.extracted FROM documents d LEFT JOIN e USING (doc_id)")
def j_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(_extracted(spark, d), "doc_id", "left")


@query(f"WITH {_EX} SELECT d.doc_id, md5(CASE WHEN trim(e.extracted) <> '' THEN e.extracted ELSE d.text END) AS digest FROM documents d LEFT JOIN e USING (doc_id)")
def text_pick(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "text").join(_extracted(spark, d), "doc_id", "left")
    return both.select("doc_id", F.md5(F.when(~T.blank(F.col("extracted")), F.col("extracted")).otherwise(F.col("text"))).alias("digest"))


@query(f"WITH {RQ._CHUNKS} SELECT c.chunk_id, d.source AS source_uri FROM c JOIN documents d USING (doc_id)")
def j_chunk(spark: SparkSession, d: str) -> DataFrame:
    items = RQ.items(spark, d).select("item_id", "source_uri")
    return RQ._fts_chunks(spark, d).select("chunk_id", "item_id").join(items, "item_id").select("chunk_id", "source_uri")


@query(f"WITH {RQ._Q}, f AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), g AS (SELECT query_id, unnest(string_split(query_text, ' ')) AS term FROM q) SELECT query_id, term, count(*) AS n FROM f JOIN g USING (term) GROUP BY ALL")
def j_terms(spark: SparkSession, d: str) -> DataFrame:
    asked = RQ.queries(spark).select("query_id", F.explode(F.split("query_text", " ")).alias("term"))
    wanted = [r.term for r in asked.select("term").distinct().collect()]  # the stated queries' terms; no other is counted
    tf = R.term_frequencies(RQ.items(spark, d), tokens=F.filter(T.term_tokens(F.col("text")), lambda t: t.isin(*wanted)))
    return tf.join(asked, "term").groupBy("query_id", "term").agg(F.sum("tf").alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS text_items, 16 AS dimensions FROM (" + "SELECT doc_id, unnest(range(0, greatest(1, ceil((length(text) - 800) / 600.0)::BIGINT + 1))) AS i FROM documents WHERE length(text) > 0)")
def emb_build(spark: SparkSession, d: str) -> DataFrame:
    vectors = RQ._fts_chunks(spark, d).select("item_id", R.hash_embedding(F.col("text"), 16).alias("v"))
    return vectors.agg(F.count("*").alias("chunks"), F.countDistinct("item_id").alias("text_items"), F.max(F.size("v")).alias("dimensions"))


@query(f"WITH {RQ._VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 30")
def emb_file(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.vector_candidates(vectors, RQ._vector_queries(spark, d), R.candidate_limit(K.QueryBudget(2, offset=1), 10)).select("query_id", "vec_id", "rank")


@query(f"WITH {RQ._VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id FROM r WHERE rank = 1")
def k_top(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_candidates(table(spark, d, "embeddings").select("vec_id", "embedding"), RQ._vector_queries(spark, d), 1).select("query_id", "vec_id")


@query("SELECT doc_id, lang AS lang, 'fixed' AS source FROM documents")
def p_meta(spark: SparkSession, d: str) -> DataFrame:
    own = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("other"), F.lit("x"))
    kept = F.map_filter(own, lambda k, v: k.isin("lang", "source"))
    merged = F.map_concat(F.map_filter(kept, lambda k, v: k != "source"), F.create_map(F.lit("source"), F.lit("fixed")))
    return table(spark, d, "documents").select("doc_id", merged["lang"].alias("lang"), merged["source"].alias("source"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), '|') AS frame FROM conversations")
def w_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 2)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), "|").alias("frame"))


@query(f"WITH {RQ._SCAN} SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY source_uri, rank)::INTEGER AS position FROM r WHERE trim(text) <> ''")
def s_ctx(spark: SparkSession, d: str) -> DataFrame:
    ranked = RQ.scan_ranks(spark, d).where("not empty").select("query_id", "source_uri", F.col("rank").alias("by_score"))
    placed = K.rank_in_ranges(ranked, ["query_id"], "source_uri", "by_score")
    return placed.select("query_id", F.col("by_score").alias("rank"), F.col("rank").cast("int").alias("position"))


@query(f"WITH {RQ._SCAN} SELECT query_id, item_id, rank FROM r")
def w_rank(spark: SparkSession, d: str) -> DataFrame:
    return RQ.scan_ranks(spark, d).select("query_id", "item_id", "rank")


@query("WITH s AS (SELECT conv_id, turn, md5(text) AS h FROM conversations), c AS (SELECT conv_id, turn, h, turn % 3 AS label FROM s JOIN conversations USING (conv_id, turn) WHERE role = 'user') SELECT s.conv_id, s.turn, coalesce(c.label, -1)::BIGINT AS label FROM s LEFT JOIN c USING (conv_id, turn, h)")
def mk_obs(spark: SparkSession, d: str) -> DataFrame:
    """Labels from a cache keyed by item, place and text hash; what it lacks would be asked of a provider."""
    s = table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"))
    cache = s.where("role = 'user'").drop("role").withColumn("label", F.col("turn") % 3)
    return s.drop("role").join(cache, ["conv_id", "turn", "h"], "left").select("conv_id", "turn", F.coalesce("label", F.lit(-1)).alias("label"))


@query("SELECT conv_id, turn, conv_id % 4 AS topic FROM conversations")
def j_topic(spark: SparkSession, d: str) -> DataFrame:
    """Every observation must have a topic: a missing one stops the query."""
    s = table(spark, d, "conversations").select("conv_id", "turn")
    topics = s.select("conv_id", "turn", (F.col("conv_id") % 4).alias("topic"))
    checked = F.when(F.col("topic").isNull(), F.raise_error(F.lit("an observation has no topic"))).otherwise(F.col("topic"))
    return s.join(topics, ["conv_id", "turn"], "left").select("conv_id", "turn", checked.cast("long").alias("topic"))


@query("SELECT * FROM (VALUES (1, 1, 'header'), (1, 2, 'body'), (2, 1, 'title'), (2, 2, 'left'), (2, 3, 'right'), (3, 1, 'title'), (3, 2, 'text'), (3, 3, 'table'), (3, 4, 'footer')) t(layout, ord, kind)")
def ext_layout(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for a layout detector: fixed regions of three kinds of page, in reading order."""
    fixed = {1: ("header", "body"), 2: ("title", "left", "right"), 3: ("title", "text", "table", "footer")}
    return spark.createDataFrame([(k, i, name) for k, names in fixed.items() for i, name in enumerate(names, 1)], "layout int, ord int, kind string")


@query(f"WITH {RQ.budget_sql(5, 50000)} SELECT item_id, rank FROM kept WHERE query_id = 'q1'")
def cp_kb(spark: SparkSession, d: str) -> DataFrame:
    from .workflow import KnowledgeBase

    return KnowledgeBase(RQ.items(spark, d), most_characters=50_000).query(spark, "idiot clown").select("item_id", "rank")


_PACK = r"p AS (SELECT query_id, rank, trim(d.text) AS t, sum(len([x for x in regexp_split_to_array(trim(d.text), '\s+') if x <> ''])) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM kept JOIN documents d ON d.doc_id::VARCHAR = item_id WHERE trim(d.text) <> '')"


@query(f"WITH {RQ.budget_sql(8, 6000)}, {_PACK} SELECT query_id, count(*) AS n_blocks, md5(string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS digest FROM p WHERE used <= 1500 GROUP BY query_id")
def cp_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """A budget of tokens alone, which stands for four characters each."""
    from .workflow import PackRequest, retrieve_pack

    items = RQ.items(spark, d)
    pack = retrieve_pack(R.scan(items, RQ.queries(spark)).select("query_id", "item_id", "score"), items, PackRequest(8, max_tokens=1500))
    return pack.select("query_id", "n_blocks", F.md5("text").alias("digest"))


def _halved_sql(most: int, levels: tuple[int, ...], tokens: int) -> str:
    """Packs of every level of characters, and of these the first level whose packs have ``tokens`` at most, or the last."""
    steps = ["k0 AS (SELECT query_id, ch, 0 AS rank, 0 AS used FROM q, l)"]
    for i in range(1, most + 1):
        steps.append(f"k{i} AS (SELECT k.query_id, k.ch, min(c.rank) AS rank, any_value(k.used) + arg_min(c.n, c.rank) AS used FROM k{i - 1} k JOIN c ON c.query_id = k.query_id AND c.rank > k.rank AND k.used + c.n <= k.ch GROUP BY k.query_id, k.ch)")
    taken = " UNION ALL ".join(f"SELECT query_id, ch, rank FROM k{i}" for i in range(1, most + 1))
    spaces = "".join(x for x in T.WHITE if not "\x1c" <= x <= "\x1f")
    return f"""WITH {RQ._SCAN}, c AS MATERIALIZED (SELECT query_id, item_id, rank, length(text) AS n FROM r), l AS (SELECT unnest({list(levels)}) AS ch), {", ".join(steps)},
p AS (SELECT query_id, ch, rank, trim(d.text, '{T.WHITE}') AS t FROM ({taken}) JOIN c USING (query_id, rank) JOIN documents d ON d.doc_id::VARCHAR = c.item_id WHERE trim(d.text, '{T.WHITE}') <> ''),
n AS (SELECT ch, query_id, sum(len([x for x in regexp_split_to_array(t, '[{spaces}]+') if x <> ''])) AS n FROM p GROUP BY ALL),
m AS (SELECT l.ch, coalesce(max(n), 0) AS n FROM l LEFT JOIN n USING (ch) GROUP BY l.ch), g AS (SELECT coalesce(max(ch) FILTER (n <= {tokens}), min(ch)) AS ch FROM m)
SELECT query_id, count(*) AS n_blocks, md5(string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS digest FROM p JOIN g USING (ch) GROUP BY query_id"""


@query(_halved_sql(8, (16000, 8000, 4000, 2000), 800))
def ce_rpack(spark: SparkSession, d: str) -> DataFrame:
    """Characters halved from 16,000 until every pack has 800 tokens at most, three times at most."""
    from .workflow import PackRequest, render_pack

    items = RQ.items(spark, d)
    pack, _ = render_pack(R.scan(items, RQ.queries(spark)).select("query_id", "item_id", "score"), items, PackRequest(8, maximum_total_characters=16000), 800)
    return pack.select("query_id", "n_blocks", F.md5("text").alias("digest"))
