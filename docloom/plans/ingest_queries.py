"""Ingest operators over documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources import web as W
from .registry import query, table

_PATH = "source || '/' || lang || '/file ' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.PDF' ELSE '.bin' END"


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    end = F.when(i % 4 == 0, ".txt").when(i % 4 == 1, ".md").when(i % 4 == 2, ".PDF").otherwise(".bin")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/file "), i, end)
    return table(spark, d, "documents").select("doc_id", i.cast("string").alias("item_id"), path.alias("relpath"), F.concat(F.lit("file://"), "source", F.lit("/"), i % 300).alias("source_uri"), "text", "lang")


@query("SELECT page_id, CASE WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'text/html' END AS media_type FROM pages")
def src_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", I.sniff_media_type(F.col("html").cast("binary")).alias("media_type"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type FROM documents")
def src_media(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", I.media_type_of(F.col("relpath")).alias("media_type"))


@query(f"WITH p AS (SELECT doc_id, {_PATH} || repeat('x', (doc_id % 200)::INTEGER) AS n FROM documents), e AS (SELECT doc_id, n, replace(replace(n, '/', '%2F'), ' ', '%20') AS u FROM p) SELECT doc_id, CASE WHEN length(u) > 180 THEN 'hash-' || sha256(n) ELSE u END AS name FROM e")
def src_name(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", I.storage_name(F.concat("relpath", F.repeat(F.lit("x"), (F.col("doc_id") % 200).cast("int")))).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'title: T ' || doc_id || chr(10) || 'lang: ' || lang END AS head, md5(text) AS body FROM documents")
def front(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: T "), "doc_id", F.lit("\nlang: "), "lang", F.lit("\n---\n\n"), "text")
    made = table(spark, d, "documents").select("doc_id", I.front_matter(F.when(F.col("doc_id") % 2 == 0, head).otherwise(F.col("text"))).alias("f"))
    return made.select("doc_id", "f.head", F.md5("f.body").alias("body"))


_URI = "'file://' || source || '/' || doc_id % 300"
_NEW = f"n AS (SELECT doc_id, {_URI} AS u, text FROM documents), o AS (SELECT DISTINCT {_URI} AS u FROM documents JOIN labels USING (doc_id))"


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents as they arrive, and a catalog of those that bear labels."""
    all_ = files(spark, d)
    return all_, all_.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {_NEW}, f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id::VARCHAR) AS i FROM n) SELECT doc_id::VARCHAR AS item_id, u AS source_uri, sha256(text) AS sha256 FROM f WHERE i = 1 AND u NOT IN (SELECT u FROM o)")
def ingest(spark: SparkSession, d: str) -> DataFrame:
    return I.ingest(*_arrivals(spark, d)).select("item_id", "source_uri", "sha256")


@query(f"WITH {_NEW} SELECT doc_id FROM n WHERE u IN (SELECT u FROM o)")
def j_dup(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(*_arrivals(spark, d)).select("doc_id")


@query("SELECT doc_id, 'text:' || sha256(lang || chr(10) || text) AS uri FROM documents")
def ingest_note(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", I.note_uri(F.col("lang"), F.col("text")).alias("uri"))


@query(f"WITH p AS (SELECT doc_id, {_PATH} AS n FROM documents) SELECT doc_id FROM p WHERE NOT (n LIKE '%.md' OR n LIKE 'src1/%' OR regexp_matches(n, '^.*/de/file .5.*$'))", "ignore")
def ignore(spark: SparkSession, d: str) -> DataFrame:
    return I.not_ignored(files(spark, d), ("*.md", "src1/*", "*/de/file ?5*")).select("doc_id")


@query(f"WITH p AS (SELECT {_PATH} AS n FROM documents) SELECT count(*) AS scanned, count(*) FILTER (n LIKE '%.md') AS ignored, count(*) FILTER (n NOT LIKE '%.md') AS imported FROM p")
def import_tree(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("relpath").rlike(I.glob_regex("*.md"))
    return files(spark, d).agg(F.count("*").alias("scanned"), F.count_if(hit).alias("ignored"), F.count_if(~hit).alias("imported"))


_UUID = "substr(md5(doc_id::VARCHAR), 1, 8) || '-' || substr(md5(doc_id::VARCHAR), 9, 4) || '-' || substr(md5(doc_id::VARCHAR), 13, 4) || '-' || substr(md5(doc_id::VARCHAR), 17, 4) || '-' || substr(md5(doc_id::VARCHAR), 21, 12)"


@query(f"WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'm' || doc_id WHEN 1 THEN {_UUID} END AS item_id FROM documents) SELECT item_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN doc_id - 1000 ELSE doc_id END AS created_at FROM f WHERE item_id IS NOT NULL")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    base = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), "doc_id")).alias("meta_id"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("raw/"), uuid, F.lit("--name.txt"))).otherwise("raw/name.txt").alias("relpath"), F.col("doc_id").alias("created_at"), uuid.alias("uuid"))
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    old = base.join(labelled, "doc_id", "left_semi").select(F.coalesce("meta_id", "uuid").alias("item_id"), (F.col("doc_id") - 1000).alias("created_at"))
    return I.reindex(base, old).select("item_id", "created_at")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['a', lang, source] ELSE ['a', lang] END AS tags, 'side' AS origin, lang FROM documents")
def meta_merge(spark: SparkSession, d: str) -> DataFrame:
    front = F.create_map(F.lit("origin"), F.lit("front"), F.lit("lang"), "lang")
    merged = I.merge_metadata(front, F.create_map(F.lit("origin"), F.lit("side")))
    tags = I.merge_tags(F.array(F.lit("a"), "lang"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array(F.lit("a"))))
    return table(spark, d, "documents").select("doc_id", tags.alias("tags"), merged["origin"].alias("origin"), merged["lang"].alias("lang"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def list_show(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id")


@query("SELECT n_chars AS created_at, lang AS extractor_id, doc_id AS snapshot_id FROM documents ORDER BY n_chars DESC, lang DESC, doc_id DESC LIMIT 1", "snapshots")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return I.latest(table(spark, d, "documents").select(F.col("n_chars").alias("created_at"), F.col("lang").alias("extractor_id"), F.col("doc_id").alias("snapshot_id")))


@query("SELECT doc_id, list_distinct(['en', 'new', lang]) IS NOT NULL AS ok, len(list_distinct(['new', lang]))::INTEGER AS n FROM documents", "hooks")
def hooks(spark: SparkSession, d: str) -> DataFrame:
    tagged = I.run_hooks(table(spark, d, "documents").withColumn("tags", F.array("lang")), [I.add_tags(("new",)), I.add_tags(("new",))])
    return tagged.select("doc_id", F.col("tags").isNotNull().alias("ok"), F.size("tags").alias("n"))


@query("SELECT page_id, len(l)::INTEGER AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT page_id, regexp_extract_all(html, '(?i)[\\s\"''](?:href|src)\\s*=\\s*\"([^\"]*)\"', 1) AS l FROM pages)", "links")
def links(spark: SparkSession, d: str) -> DataFrame:
    found = W.raw_links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


_ENDS = "CASE page_id % 4 WHEN 0 THEN '//' WHEN 1 THEN '/' WHEN 2 THEN '' ELSE '//x' END"


@query(f"""WITH r AS (SELECT page_id, ltrim((url || {_ENDS})[9:], '/') AS p FROM pages WHERE starts_with(url, 'https://') UNION ALL SELECT -1 - page_id, ltrim({_ENDS}, '/') FROM pages)
SELECT page_id, CASE WHEN p = '' THEN 'index.html' WHEN ends_with(p, '/') THEN rtrim(p, '/') || '/index.html' ELSE p END AS path FROM r""")
def crawl_path(spark: SparkSession, d: str) -> DataFrame:
    """URLs that end in one slash, two, or none, and what is nothing but a prefix and such an end."""
    end = F.element_at(F.array(*map(F.lit, ("//", "/", "", "//x"))), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, d, "pages")
    urls = pages.where("url like 'https://%'").select("page_id", F.concat("url", end).alias("url"))
    urls = urls.unionByName(pages.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("https://"), end).alias("url")))
    return urls.select("page_id", W.relative_path(F.col("url"), "https://").alias("path"))


_LINKED = """WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
e AS (SELECT DISTINCT a.u AS a, b.u AS b FROM p a JOIN p b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2) WHERE a.page_id % 5 <> 4),
r(u, d) AS (SELECT u, 0 FROM p WHERE page_id = (SELECT min(page_id) FROM pages) UNION SELECT e.b, d + 1 FROM r JOIN e ON e.a = u)
SELECT u AS url, min(d)::INTEGER AS depth FROM r GROUP BY u"""


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that also link to two others each, but for every fifth one, as stored pages don't link to each other."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    to = F.when(F.col("page_id") % 5 != 4, F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2))
    urls = pages.select(F.col("page_id").alias("to"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("target"))
    links = pages.select("page_id", F.explode(to).alias("to")).join(urls, "to")
    both = links.groupBy("page_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<a href='"), "target", F.lit("#x'>on</a>")))).alias("more"))  # two links each
    return pages.join(both, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))


@query(_LINKED)
def crawl(spark: SparkSession, d: str) -> DataFrame:
    pages = linked_pages(spark, d)
    n, root = pages.agg(F.count("*"), F.min_by("url", "page_id")).first()
    return W.crawl(pages.select("url", "html"), root, "http", n)


_MET = """WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), n AS (SELECT min(page_id) AS root FROM pages),
k AS (SELECT page_id, u, NOT starts_with(u, 'https://') AND page_id <> root AS outside, contains(u, '/de/') AND page_id <> root AS ignored FROM p, n),
l AS (SELECT page_id AS a, unnest([2 * page_id + 1, 2 * page_id + 2]) AS b FROM pages),
r(page_id) AS (SELECT root FROM n UNION SELECT l.b FROM r JOIN k USING (page_id) JOIN l ON l.a = r.page_id WHERE NOT outside AND NOT ignored),
m AS (SELECT DISTINCT r.page_id, k.u, outside, ignored FROM r LEFT JOIN k USING (page_id))
SELECT count(*) AS discovered_items, count(*) FILTER (u IS NOT NULL AND NOT outside AND NOT ignored) AS fetched_items, count(*) FILTER (u IS NOT NULL AND NOT outside AND NOT ignored) AS stored_items,
  count(*) FILTER (outside) AS skipped_outside_prefix_items, count(*) FILTER (ignored AND NOT outside) AS skipped_ignored_items, count(*) FILTER (u IS NULL) AS errored_items FROM m"""


@query(_MET)
def crawl_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link to two others each and to nothing else: pages that there are not are errors, those without https are
    outside, German ones are ignored."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    urls = pages.select(F.col("page_id").alias("to"), F.col("url").alias("target"))
    first = pages.agg(F.min_by("url", "page_id")).first()[0]
    https = lambda c: F.when(F.col(c) == first, F.concat(F.lit("https://"), F.substring_index(F.col(c), "://", -1))).otherwise(F.col(c))
    links = pages.select("page_id", F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("to")).join(urls, "to", "left")
    target = F.coalesce(F.replace("target", F.lit("&"), F.lit("&amp;")), F.concat(F.lit("https://nowhere.example.org/"), F.col("to")))
    more = links.groupBy("page_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<p><a class=x HREF='"), target, F.lit("#x'>on</a>")))).alias("html"))  # two links each
    whole = pages.join(more, "page_id").select(https("url").alias("url"), "html")
    root = "https://" + first.partition("://")[2]
    return W.crawl_counts(W.crawl_log(whole, root, "https://", 1 << 40, ("*/de/*",)))


_RELPATH = f"SELECT doc_id::VARCHAR AS item_id, sha256(text) AS s, {_PATH} AS n FROM documents"


@query("WITH h AS (SELECT sha256(item_id || '|' || s || '|' || n) AS h FROM (" + _RELPATH + ")) SELECT sha256(" + " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4)) + ") AS catalog_hash FROM h")
def sink_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return I.catalog_hash(files(spark, d).withColumn("sha256", F.sha2("text", 256)))
