"""Extraction stages and selection over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from .registry import query, table

_KIND = "CASE doc_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' ELSE 'image/png' END"
_META = "'T' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'tags: ' || lang || ', x' ELSE '' END"
_OUT = f"o AS (SELECT doc_id, {_KIND} AS k, {_META} AS m, CASE WHEN doc_id % 3 < 2 THEN text END AS p, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 < 4 THEN lang END AS q FROM documents)"


def items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "text/markdown").when(i % 3 == 1, "text/plain").otherwise("image/png")
    tags = F.when(i % 2 == 0, F.array("lang", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", "text", "lang", kind.alias("media_type"), F.concat(F.lit("T"), i).alias("title"), tags.alias("tags"))


def _with(spark: SparkSession, d: str, *last: E.Stage) -> DataFrame:
    noisy = E.Stage("noisy", lambda: F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 < 4, F.col("lang")), lambda: (F.col("doc_id") % 10) / 10)
    return E.run_stages(items(spark, d), [E.Stage("metadata-text", E.metadata_text), E.Stage("pass-through-text", E.pass_through), noisy, *last])


def _final(spark: SparkSession, d: str, name: str, text) -> DataFrame:
    return _with(spark, d, E.Stage(name, text)).select("doc_id", "final_stage", F.md5("text_out").alias("digest"))


@query(f"WITH {_OUT} SELECT doc_id, CASE WHEN q IS NOT NULL THEN 2 WHEN p IS NOT NULL THEN 1 ELSE 0 END AS final_stage, md5(coalesce(q, p, m)) AS digest FROM o")
def ext_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d).select("doc_id", "final_stage", F.md5("text_out").alias("digest"))


@query(f"WITH {_OUT} SELECT count(*) AS items, count(*) AS extracted, 0::BIGINT AS skipped, count(*) FILTER (trim(coalesce(q, p, m)) = '') AS empty FROM o")
def ext_counters(spark: SparkSession, d: str) -> DataFrame:
    return E.counters(_with(spark, d))


@query(f"WITH {_OUT} SELECT doc_id, md5(p) AS passed, m AS meta FROM o", "ext_pass_meta")
def ext_pass_meta(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("doc_id", F.md5(E.pass_through()).alias("passed"), E.metadata_text().alias("meta"))


@query(f"WITH {_OUT}, h AS (SELECT doc_id, p, q, m, (SELECT sha256(text) FROM documents d WHERE d.doc_id = o.doc_id) AS s FROM o), l AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id::VARCHAR AS item_id, l.doc_id IS NOT NULL AND h.doc_id % 4 <> 0 AS reused, md5(CASE WHEN l.doc_id IS NOT NULL AND h.doc_id % 4 <> 0 THEN 'kept ' || s ELSE coalesce(q, p, m) END) AS digest FROM h LEFT JOIN l USING (doc_id)")
def ext_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents were extracted before, every fourth of them from another content, and all of them by another
    pipeline too."""
    wanted, other = E.snapshot_id([("metadata-text", {}), ("pass-through-text", {})]), E.snapshot_id([("pass-through-text", {})])
    hashed = items(spark, d).withColumn("item_id", F.col("doc_id").cast("string")).withColumn("sha256", F.sha2("text", 256))
    known = hashed.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    content = F.when(F.col("doc_id") % 4 == 0, F.lit("changed since")).otherwise(F.col("sha256"))
    stored = known.select(F.lit(wanted).alias("snapshot_id"), "item_id", content.alias("sha256"), F.concat(F.lit("kept "), "sha256").alias("text_out"))
    stored = stored.unionByName(known.select(F.lit(other).alias("snapshot_id"), "item_id", "sha256", F.lit("other").alias("text_out")))
    noisy = E.Stage("noisy", lambda: F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 < 4, F.col("lang")))
    stages = [E.Stage("metadata-text", E.metadata_text), E.Stage("pass-through-text", E.pass_through), noisy]
    done = E.reuse(hashed, stored, wanted, lambda missing: E.run_stages(missing, stages))
    return done.select("item_id", "reused", F.md5("text_out").alias("digest"))


@query(f"WITH {_OUT} SELECT doc_id, 3 AS final_stage, md5(m) AS digest FROM o")
def sel_first(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, "select-text", E.select_first)


@query(f"WITH {_OUT}, l AS (SELECT *, length(trim(m)) AS a, coalesce(length(trim(p)), -1) AS b, coalesce(length(trim(q)), -1) AS c FROM o) SELECT doc_id, 3 AS final_stage, md5(CASE WHEN a >= b AND a >= c THEN m WHEN b >= c THEN p ELSE q END) AS digest FROM l")
def sel_longest(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, "select-longest-text", E.select_longest)


@query(f"WITH {_OUT} SELECT doc_id, 3 AS final_stage, md5(CASE WHEN k LIKE 'image/%' THEN coalesce(q, p, m) ELSE m END) AS digest FROM o")
def sel_override(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, "select-override", lambda: E.select_override(("image/*",), True))


@query(f"WITH {_OUT}, g AS (SELECT *, coalesce(q, p, m) AS last, q IS NOT NULL AND length(trim(q)) >= 2 AND doc_id % 10 >= 5 AS ok FROM o) SELECT doc_id, 3 AS final_stage, md5(CASE WHEN k NOT LIKE 'text/%' OR ok OR (q IS NULL AND p IS NOT NULL AND length(trim(p)) >= 2) THEN last ELSE m END) AS digest FROM g")
def sel_smart(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, "select-smart-override", lambda: E.select_smart(("text/*",), 2, 0.5))


@query("WITH w AS (SELECT conv_id, turn, [x for x, i in string_split(text, ' ') if i % 3 > 0 AND x <> ''] AS k FROM conversations) SELECT conv_id, turn, md5(array_to_string(k, ' ')) AS digest, len(k)::INTEGER AS n FROM w", "ext_ocr_join")
def ext_ocr_join(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda x, i: F.struct(x.alias("text"), ((i + 1) % 3 / 3.0).cast("double").alias("confidence")))
    joined = E.join_confident(words, 0.3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(joined.text).alias("digest"), F.size(F.filter(F.split(joined.text, " "), lambda x: x != "")).alias("n"))


@query("SELECT conv_id, string_agg('Speaker ' || CASE WHEN role = 'user' THEN 0 ELSE 1 END || ': ' || trim(text), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id", "ext_dg_xform")
def ext_dg_xform(spark: SparkSession, d: str) -> DataFrame:
    said = F.struct(F.when(F.col("role") == "user", 0).otherwise(1).alias("speaker"), F.lit(0).alias("channel"), F.col("text").alias("transcript"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("u")))), lambda x: x.u).alias("utterances"))
    return talks.select("conv_id", E.transcript_text(F.to_json(F.struct("utterances"))).alias("said"))


def _shouted(text: str) -> str | None:
    """The first word in capitals; a short one is skipped, one with other letters than A-Z is an error."""
    word = text.split(" ")[0]
    if not word.isascii():
        raise ValueError(f"not ASCII: {word}")
    return word.upper() if len(word) > 6 else None


_TRIED = r"""w AS (SELECT doc_id, lang, string_split(text, ' ')[1] AS w FROM documents),
a AS (SELECT *, CASE WHEN NOT regexp_full_match(w, '[\x00-\x7F]*') THEN 'errored' WHEN length(w) > 6 THEN 'extracted' ELSE 'skipped' END AS s0, CASE WHEN doc_id % 5 = 0 THEN 'errored' WHEN doc_id % 3 = 0 THEN 'extracted' ELSE 'skipped' END AS s1 FROM w),
r AS (SELECT *, CASE WHEN s1 = 'extracted' THEN lang WHEN s0 = 'extracted' THEN upper(w) END AS t, CASE WHEN 'extracted' IN (s0, s1) THEN 'extracted' WHEN 'errored' IN (s0, s1) THEN 'errored' ELSE 'skipped' END AS status FROM a)"""


def _tried(spark: SparkSession, d: str) -> DataFrame:
    paged = E.Stage("paged", lambda: F.when(F.col("doc_id") % 3 == 0, F.col("lang")), error=lambda: F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no page "), "doc_id")), error_type="TimeoutError")
    return E.run_stages(items(spark, d), [E.python_stage("shouted", _shouted, "text"), paged])


@query(f"WITH {_TRIED} SELECT doc_id, status, s0 || ',' || s1 AS stages, md5(t) AS digest, CASE WHEN status = 'errored' THEN CASE WHEN s1 = 'errored' THEN 'TimeoutError' ELSE 'ValueError' END END AS error_type, CASE WHEN status = 'errored' THEN CASE WHEN s1 = 'errored' THEN 'no page ' || doc_id ELSE 'not ASCII: ' || w END END AS error_message FROM r")
def ext_errors(spark: SparkSession, d: str) -> DataFrame:
    """A stage that raises for some documents, and one that fails for others; each goes on with the next stage."""
    states = F.array_join(F.transform("outputs", lambda o: o.status), ",")
    return _tried(spark, d).select("doc_id", "status", states.alias("stages"), F.md5("text_out").alias("digest"), "error_type", "error_message")


@query(f"WITH {_TRIED}, k AS (SELECT r.*, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS is_text FROM r) SELECT count(*) AS total_items, sum(is_text)::BIGINT AS already_text_items, sum(1 - is_text)::BIGINT AS needs_extraction_items, count(*) FILTER (status = 'extracted') AS extracted_items, count(*) FILTER (trim(t) <> '') AS extracted_nonempty_items, count(*) FILTER (trim(t) = '') AS extracted_empty_items, count(*) FILTER (status = 'skipped') AS skipped_items, count(*) FILTER (status = 'errored') AS errored_items, count(*) FILTER (trim(t) <> '' AND is_text = 0) AS converted_items FROM k")
def ext_status(spark: SparkSession, d: str) -> DataFrame:
    return E.status_counters(_tried(spark, d))


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), k AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR d.doc_id % 4 = 0 THEN 0 WHEN d.doc_id % 5 = 0 THEN 1 ELSE 2 END AS resumed_at, text, lang FROM documents d LEFT JOIN l USING (doc_id))
SELECT doc_id::VARCHAR AS item_id, resumed_at, md5((CASE WHEN resumed_at > 0 THEN 'kept ' ELSE '' END) || upper(lang) || '|' || (CASE WHEN resumed_at > 1 THEN 'kept ' ELSE '' END) || left(text, 20) || '|new') AS digest FROM k""")
def ext_resume(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents have outputs of the first two stages, some of the first alone, every fourth of another content;
    the last stage changed since, so all have it run."""
    old, new = ([("upper", {}), ("head", {"n": 20}), ("join", {"tail": tail})] for tail in ("old", "new"))
    ids = E.prefix_ids(new)
    hashed = items(spark, d).withColumn("item_id", F.col("doc_id").cast("string")).withColumn("sha256", F.sha2("text", 256))
    kept = F.concat(F.lit("kept "), F.element_at(F.array(F.upper("lang"), F.substring("text", 1, 20), F.lit("x")), F.col("i") + 1))
    content = F.when(F.col("doc_id") % 4 == 0, F.lit("changed since")).otherwise(F.col("sha256"))
    known = hashed.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("i", F.explode(F.expr("if(doc_id % 5 = 0, array(0, 2), array(0, 1, 2))")))
    null = F.lit(None).cast("string")
    output = F.struct(F.col("i").alias("stage_index"), null.alias("extractor_id"), F.lit("extracted").alias("status"), kept.alias("text"), null.alias("producer"), F.lit(None).cast("double").alias("confidence"), null.alias("error_type"), null.alias("error_message"))
    stored = known.select(F.element_at(F.array(*map(F.lit, E.prefix_ids(old))), F.col("i") + 1).alias("prefix_id"), "item_id", content.alias("sha256"), output.alias("output"))
    joined = lambda: F.concat(F.array_join(F.transform("outputs", lambda o: o.text), "|"), F.lit("|new"))
    stages = [E.Stage("upper", lambda: F.upper("lang")), E.Stage("head", lambda: F.substring("text", 1, 20)), E.Stage("join", joined)]
    return E.resume_stages(hashed, stored, ids, stages).select("item_id", "resumed_at", F.md5("text_out").alias("digest"))
