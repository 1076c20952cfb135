"""The operators of this subpackage as registered queries, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _alignment
from . import collocations as _collocations
from . import decontaminate as _decontaminate
from . import language_id as _language_id
from . import license_rules as _license_rules
from . import license_scan as _license_scan
from . import line_dedup as _line_dedup
from . import mixing as _mixing
from . import ngram_jaccard as _ngram_jaccard
from . import packing as _packing
from . import quality as _quality
from . import topk_search as _topk
from . import toxicity as _toxicity
from . import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_jaccard.ngram_jaccard(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
few AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN few USING (g)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_scan.license_report(_table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    """The scan in SQL without look-around: every word gets a space of its own on both sides, so matches side by side
    share none, and word numbers are counts of spaces, halved."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def doubled(pattern: str) -> str:
        return " (?:" + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "

    rows = ", ".join(f"({i}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(doubled(r.pattern))}, {r.priority}, {str(r.base).lower()})" for i, r in enumerate(_license_rules.rules()))
    return rf"""
WITH r(i, label, k, p, priority, base) AS (VALUES {rows}),
w AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS t FROM documents),
n AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words, ' ' || t || ' ' AS one, ' ' || replace(t, ' ', '  ') || ' ' AS two FROM w),
h AS (SELECT doc_id, r.*, regexp_extract_all(two, p) AS hits, regexp_split_to_array(two, p) AS gaps FROM n JOIN r ON contains(one, k)),
u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM h WHERE len(hits) > 0),
v AS (SELECT *, array_to_string(gaps[1:j], '') || array_to_string(hits[1:j - 1], '') AS before FROM u),
d AS (SELECT doc_id, i, label, priority, base, (length(before) - length(replace(before, ' ', ''))) // 2 AS a, (length(before || hits[j]) - length(replace(before || hits[j], ' ', ''))) // 2 AS b FROM v),
g AS (SELECT d.*, EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.a <= d.a AND e.b >= d.b AND NOT (e.i = d.i AND e.a = d.a)
  AND (e.priority > d.priority OR e.priority = d.priority AND (e.b - e.a > d.b - d.a OR e.b - e.a = d.b - d.a AND e.i < d.i))) AS gone FROM d),
s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS f, max(a) FILTER (base) AS l, max(priority) FILTER (NOT gone) AS best,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (base OR NOT gone)), ',') AS labels FROM g GROUP BY doc_id)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN best IS NULL THEN 0 ELSE least(1, 0.5::DOUBLE + best / 10) END::DOUBLE AS score FROM n LEFT JOIN s USING (doc_id)
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    classifier = _quality.fit(documents, _table(spark, sf_dir, "labels"))
    return _quality.site_quality(documents, classifier, F.col("source"), F.col("lang"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    return _line_dedup.kept_lines(documents, _line_dedup.repeated_lines(documents), digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL))),
k AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.*, k.k IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return _topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v WHERE vec_id % 20 = 0),
c AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, sum(q.x * c.x)::BIGINT AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = _language_id.fit(documents.where(_remainder(3) != 1))
    return _language_id.predict(documents, model, (_remainder(3) == 1).alias("held_out"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = _toxicity.fit(documents, _table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return _toxicity.score(documents, model, (_remainder(5) == 0).alias("held_out"))


def _captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages: each one fetched, then revisited under another spelling of its URL; every seventh page
    has changed its entity tag by then, every eleventh was asked for before it was first fetched."""
    each = F.posexplode(F.expr("filter(array('response', 'revisit', if(page_id % 11 = 0, 'revisit', null)), x -> x is not null)")).alias("k", "kind")
    rows = pages.select("page_id", "url", F.md5("html").alias("digest"), each)
    spelt = F.when(F.col("k") == 1, F.concat(F.regexp_replace("url", "^http://", "https://www."), F.lit("#seen"))).otherwise(F.col("url"))
    tag = F.when((F.col("k") == 1) & (F.col("page_id") % 7 == 0), F.lit('"stale"')).otherwise(F.concat(F.lit('W/"'), F.substring("digest", 1, 8), F.lit('"')))
    date = (F.col("page_id") * 10 + F.when(F.col("k") == 2, -5).otherwise(F.col("k") * 3)).cast("long")
    headers = F.create_map(F.lit("Date"), date.cast("string"), F.lit("Content-Type"), F.concat(F.lit("text/html; v="), F.col("k").cast("string")), F.lit("ETag"), tag)
    return rows.select((F.col("page_id") * 3 + F.col("k")).alias("record_id"), spelt.alias("url"), date.alias("ts"), "kind", tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"), "digest")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _warc.resolve_revisits(_captures(_table(spark, sf_dir, "pages")))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "; ")
    return found.withColumn("headers", line)


OP9_SQL = r"""
WITH k AS (SELECT page_id, url, md5(html) AS digest, unnest(CASE WHEN page_id % 11 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM pages),
c AS (
  SELECT page_id * 3 + k AS record_id, k > 0 AS revisit, digest, k,
    CASE WHEN k = 1 THEN regexp_replace(url, '^http://', 'https://www.') || '#seen' ELSE url END AS u,
    (page_id * 10 + CASE WHEN k = 2 THEN -5 ELSE k * 3 END)::BIGINT AS ts,
    CASE WHEN k = 1 AND page_id % 7 = 0 THEN '"stale"' ELSE 'W/"' || substr(digest, 1, 8) || '"' END AS tag FROM k),
p AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')
    || regexp_replace(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
    list_sort([x for x in string_split(regexp_extract(trim(u), '^[^?#]*\?([^#]*)', 1), '&') if x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)')]) AS q FROM c),
n AS (SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key, regexp_replace(tag, '^W/', '') AS etag FROM p),
m AS (
  SELECT r.*, s.record_id AS response_id, s.ts AS response_ts, s.digest AS sd, s.etag AS se, s.k AS sk,
    row_number() OVER (PARTITION BY r.record_id ORDER BY s.ts DESC, s.record_id DESC) AS i
  FROM n r LEFT JOIN n s ON s.url_key = r.url_key AND NOT s.revisit AND (s.ts < r.ts OR s.ts = r.ts AND s.record_id < r.record_id) WHERE r.revisit)
SELECT record_id, url_key, ts, CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag = se THEN 'resolved' ELSE 'mismatch' END AS status,
  response_id, response_ts, CASE WHEN etag = se THEN sd END AS digest,
  CASE WHEN etag = se THEN 'content-type: text/html; v=' || sk || '; date: ' || ts || '; etag: ' || tag END AS headers
FROM m WHERE i = 1
"""


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (
  SELECT *, 150 * sum(n) OVER () - coalesce(200 * sum(n) OVER o, 0) AS share, 100 * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS per,
    row_number() OVER (ORDER BY n / w, source NULLS LAST) AS i
  FROM s WINDOW o AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(share, i) AS share, arg_min(per, i) AS per FROM c WHERE w * share <= 2 * n * per),
t AS (SELECT source, n, CASE WHEN w * f.share > 2 * n * f.per THEN 2.0 * n ELSE (w * f.share)::DOUBLE / f.per::DOUBLE END::DOUBLE AS target FROM c, f),
b AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n)::BIGINT END AS whole FROM t),
e AS (
  SELECT d.*, n, target, whole, target - whole * n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, target,
  (size * (whole + CASE WHEN upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _alignment.align_tokenizers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _collocations.collocations(_table(spark, sf_dir, "documents"))
    return _collocations.top_collocations(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, g AS phrase, f AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1),
x AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON t.lang = s.lang AND t.m > s.m AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.a >= 80 * s.a),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c ANTI JOIN x USING (lang, phrase)),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * k.a) // (l.f + r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.g = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.g = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_quality_classifier, op4_best_fit_packing, op5_ngram_jaccard, op6_line_dedup, op7_topk_search, op8_language_id, op9_warc_revisits, op10_toxicity, op11_source_mixing, op12_tokenizer_alignment, op13_phrase_collocations, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op5_ngram_jaccard": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_topk_search": OP7_SQL, "op9_warc_revisits": OP9_SQL, "op11_source_mixing": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
