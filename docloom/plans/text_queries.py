"""Text functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _listed(spark: SparkSession, d: str, tokens: Column) -> DataFrame:
    """Counts and digests of token lists: whole lists would only make the comparison slow."""
    return _documents(spark, d).select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, "|")).alias("digest"))


def _listed_sql(tokens: str) -> str:
    return f"SELECT doc_id, len(ts)::BIGINT AS n, md5(array_to_string(ts, '|')) AS digest FROM (SELECT doc_id, {tokens} AS ts FROM documents)"


_WS = r"[x for x in regexp_split_to_array({0}, '\s+') if x <> '']"


@query(_listed_sql(_WS.format("text")))
def tok_ws(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.whitespace_tokens(F.col("text")))


@query(_listed_sql(_WS.format("lower(text)")))
def tok_scan(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.scan_tokens(F.col("text")))


@query(_listed_sql("regexp_extract_all(lower(text), '[a-z0-9]+')"))
def tok_tf(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.term_tokens(F.col("text")))


@query(_listed_sql(r"[y for y in [regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') for x in regexp_split_to_array(text, '\s+')] if y <> '']"))
def tok_fts(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.query_tokens(F.col("text")))


@query(_listed_sql(r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"))
def tok_unicode61(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.folded_tokens(F.col("text")))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(_listed_sql(f"[x for x in {_WS.format('text')} if lower(x) NOT IN ({_STOP})]"))
def stop(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.without_stop_words(T.whitespace_tokens(F.col("text"))))


@query(f"SELECT doc_id, len({_WS.format('text')})::INTEGER AS n FROM documents")
def tokens_n(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n"))


@query(rf"""
WITH t AS (SELECT doc_id, text, {_WS.format('text')} AS ts, string_split(text, '. ') AS ps FROM documents),
u AS (SELECT *, {_WS.format("trim(list_filter(ps, lambda x: x <> '')[1])")} AS ss, trim(list_filter(ps, lambda x: x <> '')[1]) AS s FROM t)
SELECT doc_id, CASE WHEN len(ts) <= 8 THEN text ELSE array_to_string(ts[1:8], ' ') END AS truncated,
  CASE WHEN s IS NULL THEN text WHEN len(ss) > 8 THEN array_to_string(ss[1:8], ' ') ELSE s END AS summary FROM u
""")
def compact(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.truncate_tokens(F.col("text"), 8).alias("truncated"), T.compact_sentence(F.col("text"), 8).alias("summary"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS form FROM documents")
def lexical(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.lexical_form(F.col("text")).alias("form"))


@query(_listed_sql(r"[y for y in [regexp_replace(x, '[^a-z0-9]', '', 'g') for x in regexp_split_to_array(lower(text), '\s+')] if length(y) > 2]"), "norm_words")
def norm_words(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, T.normal_words(F.col("text")))


@query(r"SELECT doc_id, array_to_string([x for x in regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+') if x <> ''], ' ') AS transcript, array_to_string([x for x in regexp_split_to_array(text, '\s+') if x <> ''], ' ') AS collapsed FROM documents")
def norm_transcript(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.normal_transcript(F.col("text")).alias("transcript"), T.collapsed(F.col("text")).alias("collapsed"))


_NEEDLES = ("the", "que", "ung", "idiot")


@query(f"""
WITH p AS (SELECT doc_id, text, list_min([{{'s': strpos(lower(text), t.w) - 1, 'i': t.i, 'n': length(t.w)}} for t in [{', '.join(f"{{'w': '{w}', 'i': {i}}}" for i, w in enumerate(_NEEDLES))}] if strpos(lower(text), t.w) > 0]) AS m FROM documents)
SELECT doc_id, m.s::INTEGER AS span_start, (m.s + m.n)::INTEGER AS span_end,
  CASE WHEN m IS NULL THEN text[:60] ELSE text[greatest(m.s - 30, 0) + 1 : least(m.s + m.n + 30, length(text))] END AS snippet FROM p
""", "first_match_snippet")
def first_match_snippet(spark: SparkSession, d: str) -> DataFrame:
    span = T.first_match(F.col("text"), F.array(*[F.lit(w) for w in _NEEDLES]))
    found = _documents(spark, d).withColumn("m", span)
    return found.select("doc_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), T.snippet(F.col("text"), F.col("m"), 60).alias("snippet"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 - 1 < 0 OR 20 <= doc_id % 5 - 1 THEN text ELSE text[doc_id % 5 : 20] END AS part FROM documents")
def span_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.span_text(F.col("text"), (F.col("doc_id") % 5 - 1).cast("int"), F.lit(20)).alias("part"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '://', '://user:secret@'), '^([A-Za-z][A-Za-z0-9+.\\-]*://)[^/?#]*@', '\\1') AS uri FROM pages")
def redact_uri(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.redact_uri(F.regexp_replace("url", "://", "://user:secret@")).alias("uri"))


@query(r"""
SELECT doc_id, coalesce(trim(regexp_extract(text, '(?im)(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})')), '') AS date,
  coalesce(trim(regexp_extract(text, '(?im)(?:total|amount|sum)[\s:]*[$£€]?\s*[\d,]+\.?\d*')), '') AS total,
  coalesce(trim(regexp_extract(text, '(?im)\d+\s+[A-Za-z\s]+(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr)')), '') AS address FROM documents
""")
def ent_regex(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", *[T.find_entity(F.col("text"), k).alias(k) for k in ("date", "total", "address")])


@query(r"""
WITH s AS (SELECT conv_id, string_agg('Speaker ' || CASE WHEN role = 'user' THEN '0' ELSE '1' END || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, text, [trim(x[11:]) for x in string_split(text, chr(10)) if x LIKE 'Speaker 0:%'] AS ls FROM s)
SELECT conv_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE text END AS said FROM l
""")
def speaker(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("Speaker "), F.when(F.col("role") == "user", "0").otherwise("1"), F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" ")))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n").alias("text"))
    return talks.select("conv_id", T.first_speaker(F.col("text")).alias("said"))


@query(r"SELECT doc_id, array_to_string([x for x in regexp_split_to_array(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '[A-Z][a-z]+,', '', 'g'), '\s+') if x <> ''], ' ') AS text FROM documents", "ent_remove")
def ent_remove(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.without_patterns(F.col("text"), ("[0-9]+", "[A-Z][a-z]+,")).alias("text"))


@query("SELECT item_id, list_distinct(string_split(text, ' ')) IS NOT NULL AS ok, len(string_split(text, ' '))::INTEGER AS n FROM benchmark")
def json_items(spark: SparkSession, d: str) -> DataFrame:
    packed = F.to_json(F.split("text", " "))
    forms = F.when(F.col("item_id") % 3 == 0, packed).when(F.col("item_id") % 3 == 1, F.replace(packed, F.lit('"'), F.lit('\\"'))).otherwise(F.to_json(F.array(packed)))
    items = T.json_items(F.when(F.col("item_id") % 3 == 2, F.regexp_extract(forms, r"^\[(.*)\]$", 1)).otherwise(forms))
    return table(spark, d, "benchmark").select("item_id", items.isNotNull().alias("ok"), F.size(items).alias("n"))
