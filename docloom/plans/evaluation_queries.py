"""Metrics and evaluation, on pairs made from conversations: each turn against itself with every seventh word gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import retrieve as R
from . import retrieval_queries as RQ
from .registry import query, spread, table

_PAIRS = r"""p AS (SELECT conv_id, turn, text AS a, array_to_string([x for x, i in string_split(text, ' ') if i % 7 <> 0], ' ') AS b FROM conversations)"""
_GRAM = "[array_to_string({0}[i : i + 1], ' ') for i in range(1, len({0}))]"
_NW = r"[y for y in [regexp_replace(x, '[^a-z0-9]', '', 'g') for x in regexp_split_to_array(lower({0}), '\s+')] if length(y) > 2]"
_NT = r"array_to_string([x for x in regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+') if x <> ''], ' ')"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, a, b): every turn, and what is left of it."""
    b = F.array_join(F.filter(F.split("text", " "), lambda x, i: (i + 1) % 7 != 0), " ")
    return spread(table(spark, d, "conversations")).select("conv_id", "turn", F.col("text").alias("a"), b.alias("b"))


_SETS = f"WITH {_PAIRS}, w AS (SELECT conv_id, turn, {_NW.format('a')} AS x, {_NW.format('b')} AS y FROM p), s AS (SELECT conv_id, turn, x, y, len(list_intersect(list_distinct(x), list_distinct(y))) AS h, len(list_distinct(x)) AS nx, len(list_distinct(y)) AS ny FROM w)"


@query(f"{_SETS} SELECT conv_id, turn, h::INTEGER AS hits, (ny - h)::INTEGER AS extra, (nx - h)::INTEGER AS missed, CASE WHEN ny > 0 THEN h / ny ELSE 0 END::DOUBLE AS precision, CASE WHEN nx > 0 THEN h / nx ELSE 0 END::DOUBLE AS recall FROM s")
def m_word(spark: SparkSession, d: str) -> DataFrame:
    s = M.set_scores(T.normal_words(F.col("a")), T.normal_words(F.col("b")))
    return pairs(spark, d).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.hits", "s.extra", "s.missed", "s.precision", "s.recall")


@query(f"WITH {_PAIRS}, n AS (SELECT conv_id, turn, {_NT.format('a')} AS x, {_NT.format('b')} AS y FROM p) SELECT conv_id, turn, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1 ELSE greatest(0, 1 - levenshtein(x, y) / greatest(length(x), length(y))) END, 9)::DOUBLE AS similarity FROM n")
def m_char(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("conv_id", "turn", F.round(M.edit_similarity(T.normal_transcript(F.col("a")), T.normal_transcript(F.col("b"))), 9).alias("similarity"))


@query()
def m_order(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.normal_words(F.col("a")), T.normal_words(F.col("b"))
    return pairs(spark, d).select("conv_id", "turn", M.order_scores(a, b).alias("s"), M.position_accuracy(a, b).alias("sequence_accuracy")).select("conv_id", "turn", "s.*", "sequence_accuracy")


@query(f"""{_SETS} SELECT conv_id, turn, CASE WHEN len(x) < 2 OR len(y) < 2 THEN 0 ELSE round(len(list_intersect(list_distinct({_GRAM.format('x')}), list_distinct({_GRAM.format('y')}))) / (len(x) - 1), 9) END::DOUBLE AS overlap FROM s""")
def m_ngram(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("conv_id", "turn", F.round(M.ngram_overlap(T.normal_words(F.col("a")), T.normal_words(F.col("b")), 2), 9).alias("overlap"))


@query()
def m_wer(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("conv_id", "turn", M.word_error_rate(T.normal_transcript(F.col("a")), T.normal_transcript(F.col("b"))).alias("s")).select("conv_id", "turn", "s.*")


@query(f"WITH {_PAIRS}, n AS (SELECT conv_id, turn, {_NT.format('a')} AS x, {_NT.format('b')} AS y FROM p) SELECT conv_id, turn, round(CASE WHEN length(x) = 0 THEN 0 ELSE levenshtein(x, y) / length(x) END, 9)::DOUBLE AS cer FROM n")
def m_cer(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("conv_id", "turn", F.round(M.character_error_rate(F.col("a"), F.col("b")), 9).alias("cer"))


@query()
def m_sim(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("conv_id", "turn", M.sequence_similarity("a", "b").alias("similarity"))


@query("SELECT a.page_id AS page_id, round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 9)::DOUBLE AS similarity, 1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)) >= 0.8 AS fuzzy FROM pages a JOIN pages b ON b.page_id = a.page_id + 1", "m_entsim")
def m_entsim(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("x"))
    both = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("x").alias("y")), "page_id")
    s = M.edit_similarity(F.col("x"), F.col("y"))
    return both.select("page_id", F.round(s, 9).alias("similarity"), (s >= 0.8).alias("fuzzy"))


_EXPECTED = "(SELECT 'q' || i AS query_id, (i * 7)::VARCHAR AS expected_item_id, 'src' || i AS expected_source_uri FROM range(5) t(i))"


def _expected(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.col("id") * 7).cast("string").alias("expected_item_id"), F.concat(F.lit("src"), "id").alias("expected_source_uri"))


_FIRST = f"WITH {RQ._SCAN}, e AS {_EXPECTED}, f AS (SELECT e.query_id, min(r.rank) AS first FROM e LEFT JOIN r ON r.query_id = e.query_id AND (r.item_id = e.expected_item_id OR r.source_uri = e.expected_source_uri) AND r.rank <= 40 GROUP BY ALL)"


@query(f"{_FIRST} SELECT query_id, first FROM f", "j_expect")
def j_expect(spark: SparkSession, d: str) -> DataFrame:
    return R.first_relevant(RQ._scanned(spark, d).where("rank <= 40"), _expected(spark))


@query(f"{_FIRST} SELECT count(*) AS queries, count(first) / count(*) AS hit_rate, count(first) / (count(*) * 40) AS precision_at_max_total_items, round(sum(coalesce(1 / first, 0)) / count(*), 9) AS mean_reciprocal_rank FROM f", "agg_retr")
def agg_retr(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_metrics(R.first_relevant(RQ._scanned(spark, d).where("rank <= 40"), _expected(spark)), 40)


_CER = f"n AS (SELECT {_NT.format('a')} AS x, {_NT.format('b')} AS y FROM p), c AS (SELECT round(CASE WHEN length(x) = 0 THEN 0 ELSE levenshtein(x, y) / length(x) END, 9)::DOUBLE AS cer FROM n)"


def _cer(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.round(M.character_error_rate(F.col("a"), F.col("b")), 9).alias("cer"))


@query(f"WITH {_PAIRS}, {_CER} SELECT round(avg(cer), 9) AS avg_cer, list_sort(list(cer))[count(*) // 2 + 1] AS median_cer, min(cer) AS min_cer, max(cer) AS max_cer FROM c")
def agg_ocr(spark: SparkSession, d: str) -> DataFrame:
    return E.spread(_cer(spark, d), "cer", upper=True)


@query(f"WITH {_PAIRS}, {_CER} SELECT round(avg(cer), 9) AS avg_cer, median(cer) AS median_cer, min(cer) AS min_cer, max(cer) AS max_cer FROM c")
def agg_stt(spark: SparkSession, d: str) -> DataFrame:
    return E.spread(_cer(spark, d), "cer", upper=False)


_EXTR = "x AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN ' ' ELSE d.text END AS t FROM documents d)"


@query(f"WITH {_EXTR} SELECT count(*) AS total, count(*) FILTER (trim(t) <> '') AS present, count(*) FILTER (trim(t) = '') AS empty, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (trim(t) <> '') / count(*) AS processable_fraction, 0.5::DOUBLE AS mean_similarity FROM x")
def agg_extr(spark: SparkSession, d: str) -> DataFrame:
    got = F.when(F.col("doc_id") % 10 == 1, " ").when(F.col("doc_id") % 10 != 0, F.col("text"))
    return E.extraction_metrics(table(spark, d, "documents").select(got.alias("extracted_text"), F.lit(0.5).alias("similarity")))


@query("WITH s AS (SELECT lang AS category, max(n_chars) AS score, 1 + length(lang) AS weight FROM documents GROUP BY lang) SELECT round(sum(score * weight) / sum(weight), 9)::DOUBLE AS overall FROM s")
def agg_bench(spark: SparkSession, d: str) -> DataFrame:
    return E.weighted_best(table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("source").alias("pipeline"), F.col("n_chars").cast("double").alias("score"), (1 + F.length("lang")).alias("weight")))


@query("SELECT category, min(pipeline) AS pipeline, score FROM (SELECT lang AS category, source AS pipeline, n_chars AS score, max(n_chars) OVER (PARTITION BY lang) AS m FROM documents) WHERE score = m GROUP BY ALL", "best_by_metric")
def best_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return E.best_by_metric(table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("source").alias("pipeline"), F.col("n_chars").alias("score"))).distinct()


_ENT = r"""e AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'total' ELSE 'name' END AS kind, CASE doc_id % 3 WHEN 0 THEN '2024/01/' || (doc_id % 28) WHEN 1 THEN 'Total: $' || doc_id || '.50' ELSE 'N ' || doc_id END AS x, doc_id FROM documents),
f AS (SELECT kind, x, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' WHEN 2 THEN upper(x) ELSE x END AS y FROM e),
n AS (SELECT kind, CASE kind WHEN 'date' THEN regexp_replace(lower(x), '[/.-]', '-', 'g') WHEN 'total' THEN regexp_extract(lower(x), '[\d,]+\.?\d*') ELSE lower(x) END AS x,
  CASE kind WHEN 'date' THEN regexp_replace(lower(y), '[/.-]', '-', 'g') WHEN 'total' THEN CASE WHEN y = 'other' THEN y ELSE regexp_extract(lower(y), '[\d,]+\.?\d*') END ELSE lower(y) END AS y FROM f)"""


@query(f"WITH {_ENT}, c AS (SELECT kind, count(*) FILTER (x <> '' AND x = y) AS tp, count(*) FILTER (y <> '' AND x <> y) AS fp, count(*) FILTER (x <> '' AND x <> y) AS fn FROM n GROUP BY ROLLUP (kind)) SELECT kind, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM c")
def agg_entity_f1(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    kind = F.when(k == 0, "date").when(k == 1, "total").otherwise("name")
    x = F.when(k == 0, F.concat(F.lit("2024/01/"), i % 28)).when(k == 1, F.concat(F.lit("Total: $"), i, F.lit(".50"))).otherwise(F.concat(F.lit("N "), i))
    y = F.when(i % 5 == 0, "").when(i % 5 == 1, "other").when(i % 5 == 2, F.upper(x)).otherwise(x)
    return E.entity_f1(table(spark, d, "documents").select(kind.alias("kind"), x.alias("expected"), y.alias("found")))


@query("WITH l AS (SELECT item_id AS label_id, CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR END AS i, CASE WHEN item_id % 2 = 1 THEN 'src' || item_id END AS s FROM benchmark), b AS (SELECT source, arg_min(doc_id, doc_id)::VARCHAR AS first FROM documents GROUP BY source) SELECT label_id, coalesce(d.doc_id::VARCHAR, b.first) AS item_id, coalesce(d.doc_id::VARCHAR, b.first) IS NOT NULL AS found FROM l LEFT JOIN documents d ON d.doc_id::VARCHAR = l.i LEFT JOIN b ON b.source = l.s", "j_eval")
def j_eval(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    labels = table(spark, d, "benchmark").select(i.alias("label_id"), F.when(i % 2 == 0, i.cast("string")).alias("expected_item_id"), F.when(i % 2 == 1, F.concat(F.lit("src"), i)).alias("expected_source_uri"))
    return E.resolve_labels(labels, RQ.items(spark, d))


@query("SELECT b.item_id, d.text AS extracted_text, b.text AS expected_text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id", "j_gt")
def j_gt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("expected_text")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("extracted_text")), "item_id")
