"""Outside models by their deterministic stand-ins, files and deletion, each over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyse as A
from ..operators import extract as E
from ..operators import graph as G
from ..operators import ingest as I
from ..operators.lineage import shared_dir
from ..sources import files as S
from ..sources import providers as P
from .analysis_queries import _TOPIC
from .graphs_queries import _CANONICAL
from .registry import query, table


def _read(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), P.analysed(F.col("text"), P.CapitalWords()).alias("read"))


_MET = f"""e AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS label FROM documents),
m AS (SELECT item_id, label, 'entity:' || {_CANONICAL.format('label')} AS node_id, count(*)::DOUBLE AS weight FROM e WHERE length(label) >= 3 GROUP BY ALL)"""


@query(f"""WITH {_MET} SELECT item_id, node_id, 'entity' AS node_type, label, CASE WHEN contains(label, ' ') THEN 'NAME' ELSE 'WORD' END AS entity_type FROM m
UNION ALL SELECT doc_id, 'item:' || doc_id, 'item', doc_id::VARCHAR, NULL FROM documents""")
def gr_ner(spark: SparkSession, d: str) -> DataFrame:
    return G.of_language(_read(spark, d))[0]


@query(f"""WITH {_MET}, r AS (SELECT doc_id AS item_id, string_split(unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+ [a-z]+')), ' ') AS r FROM documents),
t AS (SELECT DISTINCT item_id, 'entity:' || lower(r[1]) AS src, 'entity:' || r[3] AS dst, r[2] AS predicate FROM r WHERE length(r[1]) >= 3 AND length(r[3]) >= 3)
SELECT item_id, 'item:' || item_id AS src, node_id AS dst, 'mentions' AS edge_type, NULL AS predicate, weight, 'item:' || item_id || '|mentions|' || node_id AS edge_id FROM m
UNION ALL SELECT item_id, src, dst, 'related_to', predicate, 1.0::DOUBLE, src || '|related_to|' || dst || '|' || predicate FROM t""")
def gr_dep(spark: SparkSession, d: str) -> DataFrame:
    return G.of_language(_read(spark, d))[1]


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN len([x for x in string_split(text, chr(10)) if regexp_full_match(x, '\s*')]) > 0 THEN ''
ELSE regexp_replace(array_to_string(string_split(text, chr(10)), ' '), '^\s+|\s+$', '', 'g') END END AS transcript FROM documents""")
def ext_stt(spark: SparkSession, d: str) -> DataFrame:
    """Every second document taken as a recording; one with a blank line counts as silent."""
    kind = F.when(F.col("doc_id") % 2 == 0, "audio/wav").otherwise("image/png")
    heard = P.transcribed(F.encode("text", "UTF-8"), kind, P.LineSpeech(), 0.8)
    return table(spark, d, "documents").select("doc_id", heard.alias("transcript"))


_DIGEST = "[('0x' || substr(sha256('fixture:0:' || text), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE * 2 - 1 for i in range(16)]"


@query(f"WITH r AS (SELECT doc_id, {_DIGEST} AS v FROM documents) SELECT doc_id, [round((x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 6) for x in v] AS vector FROM r")
def emb_api(spark: SparkSession, d: str) -> DataFrame:
    rows = P.embed(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), P.HashEmbedding(16))
    return rows.select(F.col("key").alias("doc_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


_ITEMS = r"""s AS (SELECT item_id, unnest([y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(text, '. ')] if y <> '']) AS text FROM benchmark)"""


@query(f"WITH {_ITEMS} SELECT (SELECT count(*) FROM benchmark) AS input_documents, (SELECT count(*) FROM s) AS output_documents, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM s)) AS errors")
def tm_llm(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in that lists the sentences of a text."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return A.model_texts(items, lambda t: P.complete(t, P.EchoChat(), "list"), True)[1].select("input_documents", "output_documents", "errors")


class _FirstLine:
    """Stand-in: names a topic by its prompt's first line, but for those with the word de."""

    def complete(self, system: str, user: str) -> str:
        line = user.split("\n", 1)[0]
        return "" if "de" in line.split(", ") else f" {line} "


@query(_TOPIC.replace("SELECT * FROM r WHERE rank <= 10", ", k AS (SELECT topic, list(term ORDER BY rank) AS w FROM r WHERE rank <= 10 GROUP BY topic) SELECT topic, CASE WHEN list_contains(w[1:3], 'de') THEN w[1] ELSE array_to_string(w[1:3], ', ') END AS label, CASE WHEN list_contains(w[1:3], 'de') THEN 'keywords' ELSE 'llm' END AS label_source FROM k"))
def tm_llm_label(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("topic"), "doc_id", "text")
    words = A.topic_keywords(docs, 10).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("keywords"))  # ten rows for each
    named = A.model_labels(words.withColumn("label", F.get("keywords", F.lit(0))), docs, lambda p: P.complete(p, _FirstLine(), "name"), "{keywords}\n{documents}", 3, 2)
    return named.select("topic", "label", "label_source")


@query(r"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
r AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN 999 ELSE -i END AS o, [x for x in string_split(t, ' ') if trim(x) <> '' AND length(x) >= 4] AS ws FROM w WHERE i % 5 <> 0)
SELECT doc_id, coalesce(string_agg(array_to_string(ws, ' '), chr(10) || chr(10) ORDER BY o, i) FILTER (len(ws) > 0), '') AS text, count(*) FILTER (len(ws) > 0)::INTEGER AS regions_with_text FROM
(SELECT doc_id, i, o, ws FROM r UNION ALL SELECT doc_id, 0, 0, [] FROM documents) GROUP BY doc_id""")
def ext_ocr_layout(spark: SparkSession, d: str) -> DataFrame:
    """Lines as regions, last first but for every fourth, which has no place, and every fifth, which has no box; words
    of under four letters aren't sure."""
    words = lambda t: F.transform(F.split(t, " "), lambda w: F.struct(w.alias("text"), F.when(F.length(w) >= 4, 0.9).otherwise(0.2).alias("confidence")))
    box = lambda i: F.when((i + 1) % 5 != 0, F.array(*[F.lit(0.0)] * 4))
    regions = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.when((i + 1) % 4 != 0, -(i + 1)).alias("order"), box(i).alias("bbox"), words(t).alias("words")))
    return table(spark, d, "documents").select("doc_id", E.layout_text(regions, 0.5).alias("x")).select("doc_id", "x.text", "x.regions_with_text")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", I.streamed(F.encode("text", "UTF-8"), F.lit("text/plain")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def sink_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of JSON and back."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "text"), f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    S.write_jsonl(docs, path)
    return spark.read.schema(docs.schema).json(path).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> (SELECT min(lang) FROM documents)")
def purge(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot's folder deleted under a confirmation that names it; the others stay."""
    docs, path = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang"), f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    docs.write.partitionBy("lang").parquet(path)
    gone = f"lang={docs.agg(F.min('lang')).first()[0]}"
    I.purge(spark, f"{path}/{gone}", gone)
    return spark.read.schema(docs.schema).parquet(path)
